"""Substring dedup: word windows that stand anywhere else too, by FM-indexes over shards of candidate passages.

1. A window's minimiser is the least hash of its 8-word grams, so equal windows have equal minimisers. Runs of
   windows with one minimiser are segments; minimisers of one place only are done with.
2. The other segments are cut out of the texts, equal ones collapsed with their count, and sharded by minimiser:
   all places of a window are in one shard, and the number of shards grows with the words in them.
3. Each shard is indexed (Burrows-Wheeler transform in a wavelet matrix of bit vectors with block ranks) and its
   segments are streamed through backward search. A window whose interval keeps two places over all its words
   is repeated; a segment that has collapsed is repeated as a whole.
4. Repeated places go back to their documents as word ranges.

Words inside a shard are told apart by 32 bits of their hash, compared over whole windows of equal minimiser.

Edge cases: null and empty texts and texts shorter than a window have nothing removed; texts are read whole, however long; ids
are taken as unique: of rows that repeat an id each counts as a document, and all get the ranges of all, as far as they are long; a null id's text is
searched but nothing is removed from it, since its ranges name no row; an empty table gives an empty result; other columns are
passed on, those named as a result are replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeproof.llm import words as wd
from lakeproof.llm.tables import cut, free_name, slices
from lakeproof.llm.workers import serving


@dataclass(frozen=True)
class SubstringParams:
    window: int = 35
    gram: int = 8
    #: Words of distinct segments in a shard, about.
    shard_words: int = 1_000_000

    def __post_init__(self) -> None:
        if not 1 <= self.gram <= self.window <= 64:  # the index sorts by 64 symbols
            raise ValueError("1 <= gram <= window <= 64 must hold")


def _least(g: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every ``n`` neighbours."""
    size = 1
    while size * 2 <= n:
        g = np.minimum(g[:-size], g[size:])
        size *= 2
    return np.minimum(g[: len(g) - (n - size)], g[n - size :]) if n > size else g


def segments(chunk: wd.Chunk, hashes: np.ndarray, p: SubstringParams) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimiser: ``text, start, windows, minimiser, places`` (2 where it may stand twice)."""
    span = p.window - p.gram + 1
    if len(hashes) < p.window:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    g = wd.grams(hashes, p.gram)
    least = _least(g, span)
    text = np.repeat(np.arange(len(chunk.first) - 1), np.diff(chunk.first))[: len(least)]
    inside = np.arange(len(least)) + p.window <= chunk.first[text + 1]
    edge = np.ones(len(least) + 1, bool)
    edge[1:-1] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    at = np.flatnonzero(edge)
    first, size = at[:-1], np.diff(at)
    own = inside[first]
    first, size = first[own], size[own]
    view = np.lib.stride_tricks.sliding_window_view(g, span)
    left = first + view[first].argmin(axis=1) if len(first) else first
    end = first + size - 1
    right = end + span - 1 - view[end][:, ::-1].argmin(axis=1) if len(first) else first
    twice = (size > span) | (left != right)
    return text[first], first - chunk.first[text[first]], size, least[first].view(np.int64), 1 + twice.astype(np.int64)


def _segmenter(p: SubstringParams):
    schema = ("m", "id", "start", "n", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            for at, chunk in wd.chunks(wd.encoded(batch.column(1)), wd.SPACED):
                text, start, size, m, places = segments(chunk, chunk.hashes(), p)
                yield pa.RecordBatch.from_arrays([pa.array(m), batch.column(0).take(pa.array(text + at)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(places.astype(np.int32))], names=schema)

    return run


def _cutter(p: SubstringParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            wanted = batch.column(2).to_pylist()
            ids = batch.column(0)
            for at, chunk in wd.chunks(wd.encoded(batch.column(1)), wd.SPACED):
                short = chunk.hashes().astype(np.uint32)
                row, ms, starts, sizes, held = [], [], [], [], []
                for i in range(len(chunk.first) - 1):
                    for x in wanted[at + i]:
                        a = chunk.first[i] + x["start"]
                        if a + x["n"] + p.window - 1 > chunk.first[i + 1]:
                            continue  # of another text of this id
                        row.append(at + i)
                        ms.append(x["m"])
                        starts.append(x["start"])
                        sizes.append(x["n"])
                        held.append(short[a : a + x["n"] + p.window - 1].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ms, pa.int64()), ids.take(pa.array(row, pa.int64())), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(held, pa.binary())], names=["m", "id", "start", "n", "held"])

    return run


class WaveletMatrix:
    """Rank of symbols in a sequence: one bit vector a level, with counts before every 64 bits."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            packed = np.packbits(np.concatenate([bit.astype(np.uint8), np.zeros(-len(bit) % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int32)
            zeros = int(len(bit) - bit.sum())
            self.levels.append((level, packed, before, zeros))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places of ``symbol`` before ``at``, from its first place in the last level's order."""
        low = np.zeros_like(at)
        for level, packed, before, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            for_at, for_low = (before[x >> 6] + np.bitwise_count(packed[x >> 6] & ((np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64) for x in (at, low))
            at = np.where(one, zeros + for_at, at - for_at)
            low = np.where(one, zeros + for_low, low - for_low)
        return at - low


class FMIndex:
    """Index of sequences that end with symbol 0, sorted by 64 symbols, which is beyond any window searched."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        rank, step = text.astype(np.int64), 1
        while True:
            key = rank * (int(rank.max(initial=0)) + 2)
            key[: max(0, n - step)] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            step *= 2
            if step >= 64:
                break
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = new
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.wavelet = WaveletMatrix(text[order - 1].astype(np.int64), max(1, int(symbols - 1).bit_length()))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of ``symbol`` followed by what the interval stands for."""
        base = self.first[symbol]
        return base + self.wavelet.rank(symbol, low), base + self.wavelet.rank(symbol, high)


def repeated_windows(held: list[np.ndarray], counts: np.ndarray, window: int) -> list[np.ndarray]:
    """For each segment, which of its windows stand in the segments at least twice, ``counts`` being how often each segment stands."""
    sizes = np.array([len(x) for x in held])
    flat = np.concatenate(held)
    names, ids = np.unique(flat, return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(begin[-1], np.int64)
    own = np.ones(len(text), bool)
    own[begin[1:] - 1] = False
    text[own] = ids + 1
    index = FMIndex(text, len(names) + 1)
    out = [np.full(s - window + 1, c > 1) for s, c in zip(sizes, counts)]
    search = np.flatnonzero(counts == 1)
    if not len(search):
        return out
    start = np.concatenate([np.arange(begin[i], begin[i] + sizes[i] - window + 1) for i in search])
    found = np.zeros(len(start), bool)
    for part in np.array_split(np.arange(len(start)), max(1, len(start) // 200_000)):
        at = part
        symbol = text[start[at] + window - 1]
        low, high = index.first[symbol], index.first[symbol + 1]
        for back in range(window - 2, -1, -1):
            keep = high - low > 1
            at, low, high = at[keep], low[keep], high[keep]
            if not len(at):
                break
            low, high = index.extend(text[start[at] + back], low, high)
        found[at[high - low > 1]] = True
    place = 0
    for i in search:
        n = sizes[i] - window + 1
        out[i] = found[place : place + n]
        place += n
    return out


def _searcher(p: SubstringParams):
    """Of each partition, a shard: ``m, h, ranges`` of the segments that hold repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        held = [np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("held")]
        flags = repeated_windows(held, t.column("places").to_numpy(), p.window)
        del held
        rows, ranges = [], []
        for i, f in enumerate(flags):
            if f.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], f.view(np.int8), [0]))))
                rows.append(i)
                ranges.append([{"a": int(a), "b": int(b) + p.window - 1} for a, b in zip(edge[::2], edge[1::2])])
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        take = pa.array(rows, pa.int64())
        for b in pa.table({"m": t.column("m").take(take), "h": t.column("h").take(take), "ranges": pa.array(ranges, kind)}).combine_chunks().to_batches(max_chunksize=10_000):
            yield b

    return run


def repeated_ranges(docs: DataFrame, params: SubstringParams = SubstringParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ranges``: word ranges ``[a, b)`` of the repeated windows of each document that has any."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    runs = cut(texts.mapInArrow(serving("substrings", _segmenter(params)), f"m long, id {kind}, start int, n int, places int"), "runs")
    several = runs.groupBy("m").agg(F.sum("places").alias("places")).where("places > 1")
    wanted = runs.join(several, "m", "left_semi").groupBy("id").agg(F.collect_list(F.struct("m", "start", "n")).alias("runs"))
    pieces = texts.join(wanted, "id").select("id", "text", "runs").mapInArrow(serving("substrings", _cutter(params)), f"m long, id {kind}, start int, n int, held binary")
    pieces = cut(pieces.withColumn("h", F.xxhash64("held")), "pieces")
    # A segment of repeating words is searched like any other and also counts as often as it stands.
    distinct = cut(pieces.groupBy("m", "h").agg(F.first("held").alias("held"), F.count("*").alias("places")), "distinct")
    words = distinct.agg(F.sum(F.octet_length("held"))).first()[0] or 0
    shards = max(1, -(-words // (4 * params.shard_words)))
    found = distinct.select("m", "h", "held", "places").repartition(shards, "m").mapInArrow(serving("substrings", _searcher(params)), "m long, h long, ranges array<struct<a:int,b:int>>")
    hits = pieces.select("m", "h", "id", "start").join(cut(found, "found"), ["m", "h"])
    moved = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b")))
    return hits.select("id", moved.alias("ranges")).groupBy("id").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


_KEPT = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])


def kept_words(text: Column, ranges: Column) -> Column:
    """``n_words, n_removed, kept_text`` (the words outside the ranges, joined by one space) and ``kept_sha256`` of each row.

    Only these two columns are sent to Python; all others stay where they are."""

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, every in columns:
            total, gone, kept, digests = [], [], [], []
            for part in slices(pa.RecordBatch.from_arrays([texts, every], names=["text", "ranges"]), 0):
                for own, drop_ranges in zip(wd.encoded(part.column(0)), part.column(1).to_pylist()):
                    own = own.split()
                    total.append(len(own))
                    if drop_ranges:
                        drop = np.zeros(len(own) + 1, np.int32)
                        for r in drop_ranges:
                            drop[min(r["a"], len(own))] += 1
                            drop[min(r["b"], len(own))] -= 1
                        own = [own[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
                    gone.append(total[-1] - len(own))
                    kept.append(b" ".join(own))
                    digests.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())], fields=list(_KEPT))

    task = serving("substrings", run)
    task.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    # Called non-deterministic so that a filter on what it gives doesn't run it a second time.
    return F.arrow_udf(task, "n_words long, n_removed long, kept_text string, kept_sha256 string").asNondeterministic()(text, ranges)


def remove_repeats(docs: DataFrame, params: SubstringParams = SubstringParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The other columns of ``docs`` with ``n_words, n_removed, kept_text`` (words joined by one space) and ``kept_sha256``."""
    ranges = repeated_ranges(docs, params, id_col, text_col)
    own = ("n_words", "n_removed", "kept_text", "kept_sha256")
    rest = [c for c in docs.columns if c != text_col and c not in own]
    spare = free_name(docs, "ranges")
    rows = docs.join(ranges.select(F.col("id").alias(id_col), F.col("ranges").alias(spare)), id_col, "left")
    held = free_name(docs, "held")
    rows = rows.select(*rest, kept_words(F.col(text_col), F.col(spare)).alias(held))
    return rows.select(*rest, *[F.col(held)[c].alias(c) for c in own])
