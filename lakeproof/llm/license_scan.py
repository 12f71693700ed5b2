"""Licence scans: base phrases, and an exact set-similarity join of text blocks with licence templates.

A block is the words from one line feed or sentence end to the next, or, for wrapped text, from one blank line or
sentence end to the next with single line feeds read as spaces; of the latter, which can be long where no sentence
ends, a template's tokens must stand within ``spread`` times its own number of words. The join finds every block whose token set
holds at least ``containment`` of a template's tokens: tokens are ordered by how rare they are over all texts,
a template needs only its ``|t| - ceil(c |t|) + 1`` rarest tokens as a prefix, a block with fewer than
``ceil(c |t|)`` distinct tokens is passed over, and the places of the first shared token in both orders bound what can still be shared.

The templates are a parameter (a bounded list of sentences), so they travel with the tasks. Token frequencies
are counted over all texts, for the templates' tokens.

Edge cases: null is empty; an empty text has no words, no labels and score 0; texts are read whole, however long;
tokens of equal count stand in the order of their bytes, and all templates that match count; repeated rows get equal
results; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases with their labels, words in lower case.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Sentences by which licences are known.
TEMPLATES = {
    "gpl": "This work is licensed under the GNU General Public License version 3",
    "gpl-notice": "This program is free software you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "apache": "Licensed under the Apache License Version 2.0",
    "apache-notice": "Unless required by applicable law or agreed to in writing software distributed under the License is distributed on an AS IS BASIS WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    "cc-by": "Licensed under CC BY NC 4.0",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mit": "Released under the MIT License",
    "mit-notice": "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the Software without restriction",
    "bsd-notice": "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
}
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Ends of blocks. A full stop between word characters, as in "2.0", ends none.
END = re.compile(rb"\n|[.!?](?=\s|$)")
#: Ends of blocks of wrapped text.
PART_END = re.compile(rb"\n[\x20\x09\x0B-\x0D]*\n|[.!?](?=\s|$)")


@dataclass(frozen=True)
class LicenseParams:
    containment: float = 0.8
    #: Width of the windows of wrapped text, in template lengths.
    spread: int = 2


def _tokens(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def _counts(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                total.update(vocabulary.intersection(_tokens(text or b"")))
        yield pa.RecordBatch.from_pydict({"token": list(total), "n": list(total.values())}, schema=pa.schema([("token", pa.binary()), ("n", pa.int64())]))

    return run


class _Index:
    """Templates as token sets in order of rarity, with inverted lists of their prefixes."""

    def __init__(self, templates: dict[str, str], order: dict[bytes, int], params: LicenseParams):
        self.order, self.need, self.sets, self.lists, self.width = order, {}, {}, {}, {}
        for name, text in templates.items():
            self.width[name] = params.spread * len(_tokens(text.encode()))
            held = sorted(set(_tokens(text.encode())), key=order.__getitem__)
            self.sets[name], self.need[name] = frozenset(held), ceil(params.containment * len(held))
            for place, token in enumerate(held[: len(held) - self.need[name] + 1]):
                self.lists.setdefault(token, []).append((name, place))
        self.least = min(self.need.values(), default=0)

    def matches(self, block: list[bytes]) -> dict[str, float]:
        """Templates with the share of their tokens that a block holds, from the containment on.

        A block's tokens that no template has can't be shared; the others stand in the same order as the templates'.
        The first one that a template's prefix has too, at its places on both sides, bounds what can be shared."""
        out: dict[str, float] = {}
        if len(block) < self.least or self.lists.keys().isdisjoint(block):
            return out
        held = sorted(self.order.keys() & block, key=self.order.__getitem__)
        met = set()
        for place, token in enumerate(held):
            if len(held) - place < self.least:  # beyond the block's prefix for any template
                break
            for name, own in self.lists.get(token, ()):
                if name not in met:
                    met.add(name)
                    need, size = self.need[name], len(self.sets[name])
                    if min(size - own, len(held) - place) >= need and (shared := len(self.sets[name].intersection(held))) >= need:
                        out[name] = shared / size
        return out

    def wrapped(self, block: list[bytes]) -> dict[str, float]:
        """As ``matches``, for tokens that stand close together."""
        out: dict[str, float] = {}
        for name in self.matches(block):
            held, width = self.sets[name], self.width[name]
            inside: Counter[bytes] = Counter()
            most = 0
            for i, word in enumerate(block):
                if i >= width and (gone := block[i - width]) in held:
                    inside[gone] -= 1
                    if not inside[gone]:
                        del inside[gone]
                if word in held:
                    inside[word] += 1
                    most = max(most, len(inside))
            if most >= self.need[name]:
                out[name] = most / len(held)
        return out


def _scan(index: _Index, phrases: dict[tuple[bytes, ...], str], schema: pa.Schema):
    joined = {b" " + b" ".join(p) + b" ": label for p, label in phrases.items()}

    def one(text: bytes) -> tuple:
        text = text.lower()
        words = WORD.findall(text)
        line = b" " + b" ".join(words) + b" "
        starts, labels = [], set()
        for phrase, label in joined.items():
            at, last, word = line.find(phrase), 0, 0
            while at >= 0:
                word += line.count(b" ", last, at)
                starts.append(word)
                labels.add(label)
                last, at = at, line.find(phrase, at + 1)
        own, best = set(), 1.0 if starts else 0.0
        if not index.lists.keys().isdisjoint(words):
            found = [index.matches(WORD.findall(block)) for block in END.split(text)]
            found += [index.wrapped(WORD.findall(block)) for block in PART_END.split(text) if b"\n" in block.strip()]
            for name, share in (x for matches in found for x in matches.items()):
                own.add(name.removesuffix("-notice"))
                best = max(best, share)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | own)), best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, params: LicenseParams = LicenseParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: ``n_words, n_base, first_word, last_word, base_labels, labels, score`` (1 where a base phrase
    stands, else the largest share of a matched template's tokens, else 0)."""
    text = docs.select(F.col(text_col).alias("text"))
    vocabulary = frozenset(t for x in templates.values() for t in _tokens(x.encode()))
    counted = text.mapInArrow(_counts(vocabulary), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # at most one row per template token
    known = {bytes(r.token): r.n for r in counted}
    order = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (known.get(t, 0), t)))}
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("id", to_arrow_type(rows.schema["id"].dataType)), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
    split = {tuple(p.encode().split()): label for p, label in phrases.items()}
    out = rows.mapInArrow(_scan(_Index(templates, order, params), split, schema), f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return out.withColumnRenamed("id", id_col)
