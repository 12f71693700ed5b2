"""Periodic runs: stretches of words that repeat with a period at least four times over.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical), of length
``max(least, times * q)`` at least, that no neighbouring word extends keeping period ``q``.

1. Texts are laid end to end as word numbers, with a number of its own between any two, so that nothing equal spans them.
2. For every power of two ``b`` the blocks that start at multiples of ``b`` are keys (integer sequences) of one
   Aho-Corasick automaton, which is searched across the texts. An occurrence counts where the aligned block ``d`` words before
   it, ``b <= d < 2b``, has the same words: there is one such block for every place. A run of period ``q`` holds an aligned
   block of the largest power of two up to ``q`` and its copy ``q`` words on, since ``(times - 1) * q >= 2b - 1``.
3. Such a pair is extended word by word in both directions, exactly, to the longest stretch of period ``d``, unless it lies in
   a run found before whose period divides ``d``. Stretches found under several periods keep the smallest, which divides the others.

Before step 2 a block is left out where its first or its last word doesn't stand again between ``b`` and ``2b`` words on: no
copy can be there. Words are told apart by 64-bit hashes.

Edge cases: null and empty texts have no words and no runs; texts of any length are read whole, in time about proportional
to length times its logarithm; every row is judged by itself, so repeated rows and null ids give repeated results;
of runs equally periodic the one that starts first, then the one of smallest period, is reported; an empty table gives an
empty result; other columns are passed on, those named as a result are replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.llm import words as wd
from lakeproof.llm.tables import crc, free_name, slices


@dataclass(frozen=True)
class RunParams:
    #: Least length of a run, in words.
    least: int = 6
    #: Least length of a run, in periods.
    times: int = 4
    #: Words of a key at most. Of larger blocks the first words are searched and the extension tells the rest: an automaton
    #: follows a suffix link per period of what it has matched, so whole blocks cost the square of a long constant text.
    key_words: int = 64

    def __post_init__(self) -> None:
        if self.times < 3 or self.least < 1:  # fewer periods need not hold an aligned block and its copy
            raise ValueError("times >= 3 and least >= 1 must hold")


def _again(ids: np.ndarray, keys: np.ndarray, at: np.ndarray, b: int) -> np.ndarray:
    """Whether the word at each place stands again ``b`` to ``2b - 1`` words on. ``keys``: word number and place of all, sorted."""
    n = len(ids)
    low = ids[at] * n + at + b
    found = np.searchsorted(keys, low)
    held = keys[np.minimum(found, n - 1)]
    return (found < n) & (held < low + b) & (held // n == ids[at])


def _seeds(ids: np.ndarray, b: int, size: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of aligned blocks of ``b`` words of which the first ``size`` stand again, and the distance of the copy."""
    import ahocorasick

    keys = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    number = np.full(len(ids) // b + 1, -1, np.int64)
    text = tuple(ids.tolist())
    for p in blocks.tolist():
        key = text[p : p + size]
        number[p // b] = keys.get(key, -1)
        if number[p // b] < 0:
            number[p // b] = p // b
            keys.add_word(key, p // b)
    keys.make_automaton()
    hits = np.fromiter(keys.iter(text), np.dtype((np.int64, 2)))
    if not len(hits):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = hits[:, 0] - size + 1
    block = start // b - 1  # the only aligned one that starts b to 2b - 1 words before
    own = (block >= 0) & (number[np.maximum(block, 0)] == hits[:, 1])  # still by place
    return block[own] * b, start[own] - block[own] * b


def _reach(ids: np.ndarray, i: int, d: int, step: int) -> int:
    """How many places from ``i`` on, forwards (1) or backwards (-1), hold the word that stands ``d`` later."""
    most = len(ids) - d - i if step > 0 else i + 1
    done, size = 0, 32
    while done < most:
        n = min(size, most - done)
        low = i + done if step > 0 else i - done - n + 1
        unlike = np.flatnonzero(ids[low : low + n] != ids[low + d : low + d + n])
        if len(unlike):
            return done + (int(unlike[0]) if step > 0 else n - 1 - int(unlike[-1]))
        done, size = done + n, size * 4
    return done


def _unknown(place: np.ndarray, distance: np.ndarray, size: int, found: dict[tuple[int, int], int]) -> np.ndarray:
    """Which pairs of blocks don't lie in a run whose period divides their distance; the longest stretch of the others is that run."""
    out = np.ones(len(place), bool)
    for (start, length), q in found.items():
        if length > 2 * size:
            low, high = np.searchsorted(place, [start, start + length])
            out[low:high] &= (distance[low:high] % q != 0) | (place[low:high] + distance[low:high] + size > start + length)
    return out


def runs_of(ids: np.ndarray, params: RunParams = RunParams()) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every run in a sequence of numbers (0 to 2**31), by start, then period."""
    n = len(ids)
    if n < params.least:
        return []
    ids = ids.astype(np.int64)
    order = np.argsort(ids, kind="stable")
    keys = ids[order] * n + order
    found: dict[tuple[int, int], int] = {}
    b = 1
    while params.times * b <= n:
        at = np.arange(0, n - 2 * b + 1, b)
        at = at[_again(ids, keys, at, b)]
        size = min(b, params.key_words)
        if size > 1 and len(at):
            at = at[_again(ids, keys, at + size - 1, b)]
        place, distance = _seeds(ids, b, size, at) if len(at) else (at, at)
        new = _unknown(place, distance, size, found)
        place, distance = place[new], distance[new]
        by = np.lexsort((place, distance))
        last, upto = 0, 0
        for p, d in zip(place[by].tolist(), distance[by].tolist()):
            if d == last and p + size <= upto:
                continue  # inside the stretch just extended
            left, right = _reach(ids, p - 1, d, -1) if p else 0, _reach(ids, p, d, 1)
            last, upto = d, p + right
            start, length = p - left, left + right + d
            if length >= max(params.least, params.times * d):
                found[start, length] = min(d, found.get((start, length), d))
        b *= 2
    return sorted((start, length, d) for (start, length), d in found.items())


def _numbered(chunk: wd.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of a chunk's texts with a number of its own behind each, and where each text begins."""
    first = chunk.first
    texts = len(first) - 1
    names, ids = np.unique(chunk.hashes(), return_inverse=True)
    begin = first + np.arange(texts + 1)
    out = np.empty(begin[-1], np.int64)
    own = np.ones(len(out), bool)
    own[begin[1:] - 1] = False
    out[own] = ids
    out[begin[1:] - 1] = len(names) + np.arange(texts)
    return out, begin


#: The columns that :func:`periodic_runs` adds.
ADDED = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed_text string"


def _judge(text: bytes, runs: list[tuple[int, int, int]]) -> tuple:
    words = text.split()
    if runs:
        drop = np.zeros(len(words) + 1, np.int32)
        for start, length, period in runs:
            drop[start + period] += 1
            drop[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(words)
    return len(runs), *best, best[1] * 1000 // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), kept


def _finder(params: RunParams, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, len(names))):
            texts, rows = wd.encoded(batch.column(len(names))), []
            for _, chunk in wd.chunks(texts, wd.SPACED):
                ids, begin = _numbered(chunk)
                own: list[list] = [[] for _ in range(len(begin) - 1)]
                for start, length, period in runs_of(ids, params):
                    i = int(np.searchsorted(begin, start, "right")) - 1
                    own[i].append((start - int(begin[i]), length, period))
                rows += [_judge(texts[len(rows) + i], x) for i, x in enumerate(own)]
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.binary()]
            made = [pa.array(list(x), kind) for x, kind in zip(zip(*rows), kinds)] if rows else [pa.array([], kind) for kind in kinds]
            made[-1] = made[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], names=[*names, *[c.split()[0] for c in ADDED.split(", ")]])

    return run


def periodic_runs(docs: DataFrame, params: RunParams = RunParams(), text_col: str = "text") -> DataFrame:
    """The other columns of ``docs`` with the number of runs, the most periodic run, digests of all runs and of the text
    without what repeats (``collapsed_text``): every word that some run holds after its first period is dropped."""
    added = [c.split()[0] for c in ADDED.split(", ")]
    rest = [c for c in docs.columns if c != text_col and c.lower() not in added]
    spare = free_name(docs, "judged_text")
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text_col).alias(spare))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], ADDED])
    return rows.mapInArrow(_finder(params, rest), schema)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a periodic tail planted in the texts of about a tenth of the rows, by the crc32 ``h`` of their id.

    Where ``h`` is a multiple of 10, word ``i`` from ``a = g % n`` on becomes word ``a + (i - a) % p``, with ``g = h // 10``,
    ``n`` words and ``p = 1 + (n - a) // (3 + g % 8)``. Such texts are their words joined by one space; a null id changes nothing."""
    h, held, start = crc(F.col(id_col)), free_name(docs, "words"), free_name(docs, "tail_start")
    g = F.floor(h / 10)
    n = F.size(held)
    rows = docs.withColumn(held, F.when(h % 10 == 0, F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    rows = rows.withColumn(start, F.when(n > 0, (g % n).cast("int")))
    period = 1 + F.floor((n - F.col(start)) / (3 + g % 8))
    moved = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(held, F.when(i < F.col(start), i).otherwise(F.col(start) + (i - F.col(start)) % period).cast("int") + 1))
    return rows.withColumn(text_col, F.when(F.col(start).isNotNull(), F.array_join(moved, " ")).otherwise(F.col(text_col))).drop(held, start)
