"""LM scoring: prediction by partial matching over bytes, and a smoothed word unigram beside it.

Training counts every byte with its context of ``order`` bytes, and every word, over all training rows; counts are
added up in each task before they are shuffled. The trie of contexts is kept as a table: one row per context with
its symbols' counts. Contexts of up to two bytes (at most 2^24 counts) travel with the tasks. Longer ones, and
word counts, are joined: texts are dealt to blocks of about ``block_bytes``, a block asks for the distinct
contexts and words it holds, and is scored with the rows that come back.

A byte's probability is its count among the context's, with one escape count per distinct symbol (method C); after
an escape the shorter context is used without the symbols of the longer one (exclusion), and at last a uniform
choice among what is left of the 256 bytes. Byte 0 ends a text and stands for what is before it.

Edge cases: null is empty; an empty text is one end token and one end byte; without training rows all
probabilities are uniform; ids may repeat or be null; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeproof.llm import words as wd
from lakeproof.llm.tables import cut, held_out, slices

END = np.uint64(0x0E0D0F7E75)
WORDS = 0


@dataclass(frozen=True)
class LmParams:
    order: int = 4
    #: Rows whose crc32 of the id's text is a multiple of this are held out.
    parts: int = 10
    alpha: float = 0.1
    block_bytes: int = 16_000_000


def _grams(texts: list[bytes], order: int, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Context and symbol of every byte and end, packed in 64 bits; with the first text and where texts begin."""
    pad = b"\0" * order
    at, held = 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or held and held + len(texts[i]) > size:
            if i > at:
                data = np.frombuffer(pad + pad.join(texts[at:i]) + b"\0", np.uint8)
                n = np.array([len(t) + 1 for t in texts[at:i]])
                begin = np.concatenate([[0], np.cumsum(n + order - 1)])[:-1]
                where = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                packed = np.zeros(len(data) - order, np.uint64)
                for j in range(order + 1):
                    packed |= data[j : len(data) - order + j].astype(np.uint64) << np.uint64(8 * (order - j))
                yield at, packed[where], np.concatenate([[0], np.cumsum(n)])
            at, held = i, 0
        if i < len(texts):
            held += len(texts[i])


class _Sum:
    """Counts of 64-bit keys, merged now and then."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.held += len(self.parts[-1][0])
        if self.held > 2_000_000:
            self.parts = [self.total()]
            self.held = 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys, at = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in self.parts])).astype(np.int64)


def _tokens(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for at, chunk in wd.chunks(texts, wd.SPACED, lower=True):
        yield at, chunk.hashes(), chunk.first


def _counter(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {WORDS: _Sum(), order: _Sum()}
        ends = 0
        for batch in (part for whole in batches for part in slices(whole, 0)):
            texts = wd.encoded(batch.column(0))
            ends += len(texts)
            for _, hashes, _ in _tokens(texts):
                sums[WORDS].add(hashes)
            for _, packed, _ in _grams(texts, order):
                sums[order].add(packed)
        for kind, own in sums.items():
            keys, n = own.total()
            if kind == WORDS and ends:
                keys, n = np.append(keys, END), np.append(n, ends)
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[i : i + 100_000]), kind, np.int32)), pa.array(keys[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], names=["kind", "key", "n"])

    return run


def _asker(order: int):
    def run(group: pa.Table) -> pa.Table:
        texts = wd.encoded(group.column("text").combine_chunks())
        block = group.column("block")[0].as_py()
        sums = {WORDS: _Sum(), order: _Sum()}
        for _, hashes, _ in _tokens(texts):
            sums[WORDS].add(hashes)
        for _, packed, _ in _grams(texts, order):
            sums[order].add(packed >> np.uint64(8))
        found = {WORDS: np.append(sums[WORDS].total()[0], END)}
        contexts = sums[order].total()[0]
        for k in range(order, 2, -1):
            found[k] = np.unique(contexts & np.uint64((1 << 8 * k) - 1))
        keys = np.concatenate(list(found.values()))
        kinds = np.concatenate([np.full(len(v), k, np.int32) for k, v in found.items()])
        return pa.table({"block": pa.array(np.full(len(keys), block, np.int64)), "kind": pa.array(kinds), "key": pa.array(keys.view(np.int64))})

    return run


class _Level:
    """The contexts of one order with their symbols' counts, sorted: ``keys`` (context and symbol), ``counts``, and by
    context ``contexts, totals, distinct`` and ``excluded``, what the next shorter context counts for the same symbols."""

    def __init__(self, contexts: np.ndarray, sizes: np.ndarray, packed: np.ndarray):
        keys = np.repeat(contexts.astype(np.uint64), sizes) << np.uint64(8) | (packed & 255).astype(np.uint64)
        by = np.argsort(keys)
        self.keys, self.counts = keys[by], packed[by] >> 8
        self.contexts, self.start = np.unique(self.keys >> np.uint64(8), return_index=True)
        self.distinct = np.diff(np.append(self.start, len(self.keys)))
        self.totals = self.sums(self.counts)
        self.excluded = np.zeros(len(self.contexts), np.int64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.start) if len(values) else values


def _find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and whether they hold what was looked for."""
    if not len(where):
        return np.zeros(len(what), np.int64), np.zeros(len(what), bool)
    at = np.minimum(np.searchsorted(where, what), len(where) - 1)
    return at, where[at] == what


class Trie:
    """Contexts by order. A longer context's symbols are among those of its suffix, so that exclusion needs no sets:
    what is left of the suffix is its total and number of symbols, less what ``excluded`` and ``distinct`` say."""

    def __init__(self, levels: list[_Level]):
        self.levels = levels
        for k in range(1, len(levels)):
            own, suffix = levels[k], levels[k - 1]
            if len(own.keys):
                at, known = _find(suffix.keys, own.keys & np.uint64((1 << 8 * k) - 1))
                own.excluded = own.sums(np.where(known, suffix.counts[at], 0))

    def costs(self, packed: np.ndarray) -> np.ndarray:
        """log10 of each symbol's probability after its context."""
        out = np.zeros(len(packed))
        live = np.arange(len(packed))
        seen, excluded = np.zeros(len(packed), np.int64), np.zeros(len(packed), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            if not len(level.keys) or not len(live):
                continue
            own = packed[live] & np.uint64((1 << 8 * (k + 1)) - 1)
            at, known = _find(level.contexts, own >> np.uint64(8))
            place, hit = _find(level.keys, own)
            fresh = np.where(known, level.distinct[at] - seen[live], 0)
            total = level.totals[at] - excluded[live] + fresh
            some = fresh > 0
            out[live[some]] += np.log10(np.where(hit, level.counts[place], fresh)[some] / total[some])
            seen[live[known]], excluded[live[known]] = level.distinct[at[known]], level.excluded[at[known]]
            live = live[~hit]
        out[live] -= np.log10(np.maximum(1, 256 - seen[live]))
        return out


def _lists(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, the lengths of their lists, and the lists end to end."""
    lists = rows.column("held")
    sizes = pc.list_value_length(lists).to_numpy()
    return rows.column("key").to_numpy().view(np.uint64), sizes, pc.list_flatten(lists).to_numpy().astype(np.int64)


def _scorer(order: int, short: list[tuple[np.ndarray, np.ndarray, np.ndarray]], tokens: int, distinct: int, alpha: float):
    def run(key: tuple, group: pa.Table, known: pa.Table) -> pa.Table:
        kinds, keys, n = (known.column(c).to_numpy() for c in ("kind", "key", "n"))
        own = kinds == WORDS
        by = np.argsort(keys[own].view(np.uint64))
        names, counts = keys[own].view(np.uint64)[by], n[own][by]
        levels = [_Level(*x) for x in short]
        for k in range(len(short), order + 1):
            levels.append(_Level(*_lists(known.filter(pa.array(kinds == k)))))
        trie = Trie(levels)
        ids, held = group.column("id").combine_chunks(), group.column("held_out").combine_chunks()
        texts = wd.encoded(group.column("text").combine_chunks())
        base, score = np.zeros(len(texts)), np.zeros(len(texts))
        total, some = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        floor = np.log10(tokens + alpha * (distinct + 1))

        def count(h: np.ndarray) -> np.ndarray:
            if not len(names):
                return np.zeros(len(h), np.int64)
            at = np.minimum(np.searchsorted(names, h), len(names) - 1)
            return np.where(names[at] == h, counts[at], 0)

        end = count(np.array([END]))[0]
        for at, hashes, first in _tokens(texts):
            c = count(hashes)
            logs = np.concatenate([[0.0], np.cumsum(np.log10(c + alpha) - floor)])
            good = np.concatenate([[0], np.cumsum(c > 0)])
            own = slice(at, at + len(first) - 1)
            total[own] = np.diff(first)
            base[own] = logs[first[1:]] - logs[first[:-1]]
            some[own] = good[first[1:]] - good[first[:-1]]
        total += 1
        some += int(end > 0)
        base += np.log10(end + alpha) - floor
        for at, packed, begin in _grams(texts, order):
            found, where = np.unique(packed, return_inverse=True)
            values = trie.costs(found)
            sums = np.concatenate([[0.0], np.cumsum(values[where])])
            score[at : at + len(begin) - 1] = sums[begin[1:]] - sums[begin[:-1]]
        return pa.table({"id": ids, "held_out": held, "n_tokens": total, "n_known": some, "train_tokens": np.full(len(texts), tokens, np.int64), "base_score": base, "score": score})

    return run


def lm_scores(docs: DataFrame, params: LmParams = LmParams(), id_col: str = "doc_id", text_col: str = "text", is_held_out: Column | None = None) -> DataFrame:
    """Per text ``held_out, n_tokens, n_known, train_tokens, base_score`` and ``score``, the log10 probability of its bytes."""
    k = params.order
    out = held_out(F.col(id_col), params.parts) if is_held_out is None else is_held_out
    rows = docs.select(F.col(id_col).alias("id"), out.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    counts = rows.where(~F.col("held_out")).select("text").mapInArrow(_counter(k), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = cut(counts, "counts")
    tokens, distinct = counts.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    grams, contexts = counts.where(F.col("kind") == k).select("key", "n"), []
    for order in range(k, -1, -1):  # a shorter context's counts are the sums of the longer ones'
        if order < k:
            grams = grams.groupBy(F.col("key").bitwiseAND((1 << 8 * (order + 1)) - 1).alias("key")).agg(F.sum("n").alias("n"))
        packed = F.call_function("shiftleft", F.col("n"), F.lit(8)).bitwiseOR(F.col("key").bitwiseAND(255))
        contexts.append(grams.groupBy(F.lit(order).alias("kind"), F.call_function("shiftright", F.col("key"), F.lit(8)).alias("key")).agg(F.collect_list(packed).alias("held")))  # 256 at most
    short = [_lists(own.select("key", "held").toArrow()) for own in reversed(contexts[max(0, k - 2) :])]
    held = F.expr("cast(null as array<long>)")
    model = counts.where(F.col("kind") == WORDS).select("kind", "key", "n", held.alias("held"))
    for own in contexts[: max(0, k - 2)]:
        model = model.unionByName(own.select("kind", "key", F.lit(0).cast("long").alias("n"), "held"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // params.block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    asked = dealt.select("block", "text").groupBy("block").applyInArrow(_asker(k), "block long, kind int, key long")
    known = asked.join(model, ["kind", "key"]).select("block", "kind", "key", "n", "held")
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_scorer(k, short, int(tokens), int(distinct), params.alpha), schema)
    return scored.withColumnRenamed("id", id_col)
