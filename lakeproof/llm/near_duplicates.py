"""Near duplicates: bottom-k sketches of word shingles under one hash function.

1. Every document's distinct shingles are hashed; the ``k`` smallest hashes are its sketch. Documents with equal
   sets collapse into a class, represented by the smallest id.
2. Inverted lists: a linked pair shares at least ``t`` retained values (where a set fits its sketch, what the largest
   partner in reach must still retain of it, exactly; otherwise ``overlap``, five standard deviations below the mean of
   shared values at the threshold), so each class is listed only under its ``k - t + 1`` rarest values.
3. Candidates of a list are compared with its most central members first; then what is outside the list's main
   component with eight members inside it; last, whatever is still in different components with everything, where
   bit marks of the shingles that each side shares with any other class of the open lists leave the threshold in reach. Pairs
   that are already connected need no comparison, so large groups cost about their size.
4. The share of the union's bottom-k that both sides hold estimates the similarity and drops pairs five standard
   deviations below the threshold; the rest is confirmed on the full sets.

Edge cases: null and empty texts have no set, are linked with nothing and stay; texts are read whole, however long; a text of
fewer words than a shingle is one shingle; ties at the threshold are links; ids are taken as unique, rows that repeat one are judged
by their own texts; a row without an id gets its group's component but can't be named, represents no group and stays; an empty
table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeproof.llm import words as wd
from lakeproof.llm.graph import components
from lakeproof.llm.tables import cut, slices
from lakeproof.llm.workers import serving


@dataclass(frozen=True)
class NearDuplicateParams:
    shingle: int = 5
    #: Links have ``100 * |A and B| >= percent * |A or B|``.
    percent: int = 75
    k: int = 48
    #: Ids up to this number (8 bytes each) are broadcast to pick texts; more are joined by shuffle.
    broadcast_ids: int = 1_000_000
    #: 64-bit words of the marks that bound what two classes can share in the last step.
    mark_words: int = 64

    @property
    def overlap(self) -> int:
        p = self.percent / 100
        return max(1, int(self.k * p - 5 * (self.k * p * (1 - p)) ** 0.5))


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct 63-bit shingle hashes of each text."""
    for _, chunk in wd.chunks(texts, wd.SPACED, lower=True):
        hashes = chunk.hashes()
        for a, b in zip(chunk.first[:-1], chunk.first[1:]):
            own = hashes[a:b]
            found = wd.grams(own, n) if b - a >= n else np.array([wd.whole(own)]) if b > a else own
            yield np.unique(found >> np.uint64(1))


def _sketcher(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            sizes, keys, sketches = [], [], []
            for held in shingle_sets(wd.encoded(batch.column(1)), n):
                sizes.append(len(held))
                with np.errstate(over="ignore"):
                    keys.append(np.array([wd.mix(held).sum(dtype=np.uint64), np.bitwise_xor.reduce(wd.mix(held ^ np.uint64(0x5BD1E995)))], np.uint64).tobytes() if len(held) else None)
                sketches.append(held[:k].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], names=["id", "n", "key", "sketch"])

    return run


def _full(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            sets = [x.astype(np.int64) for x in shingle_sets(wd.encoded(batch.column(1)), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "held"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, two = x.values.to_numpy(), y.values.to_numpy()
                at = np.searchsorted(two, one)
                at[at == len(two)] = 0
                shared = int((two[at] == one).sum())
                keep.append(100 * shared >= percent * (len(one) + len(two) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


class _Links:
    """Confirms candidate pairs of classes, step by step, and keeps the components of what it has confirmed."""

    def __init__(self, classes: DataFrame, sets: DataFrame, params: NearDuplicateParams):
        self.classes, self.sets, self.params, self.links, self.groups = classes, sets, params, None, None

    def add(self, pairs: DataFrame) -> None:
        """``pairs``: ``x, y``; in any order, with repeats."""
        p, k = self.params.percent / 100, self.params.k
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
        side = lambda s: self.classes.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}"))
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= self.params.percent * F.greatest("n_a", "n_b"))
        union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)
        shared = F.size(F.array_intersect(F.array_intersect("s_a", "s_b"), union))
        floor = p - 5 * (p * (1 - p) / k) ** 0.5
        pairs = pairs.where(shared >= F.floor(floor * F.size(union))).select("a", "b")
        held = lambda s: self.sets.select(F.col("id").alias(s), F.col("held").alias(f"h_{s}"))
        kind = self.classes.schema["rep"].dataType.simpleString()
        found = pairs.join(held("a"), "a").join(held("b"), "b").select("a", "b", "h_a", "h_b").mapInArrow(serving("near", _confirm(self.params.percent)), f"a {kind}, b {kind}")
        self.links = cut(found if self.links is None else found.unionByName(self.links), "links")
        self.groups = cut(components(self.links), "groups")

    def of(self, column: str = "rep") -> DataFrame:
        return self.groups.select(F.col("v").alias(column), "component")


def _listed(classes: DataFrame, params: NearDuplicateParams) -> DataFrame:
    """``value, rep, n, central``: the inverted lists, of two members at least; ``central``: how common a class's values are."""
    values = classes.select("rep", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    counts = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    # A partner of m shingles shares (n + m) p / (100 + p) of them at least and drops m - k; both ends of the m in reach bound it.
    p, n = params.percent, F.col("n")
    most = F.floor(100 * n / p)
    held = F.least(F.ceil(n * p / 100), F.ceil((n + most) * p / (100 + p)) - F.greatest(F.lit(0), most - params.k))
    need = F.when(n <= params.k, held.cast("int")).otherwise(params.overlap)
    shared = values.join(counts, "value").groupBy("rep", "n", "size").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))  # k at most
    # Values of no other class come first in the order and need no list.
    left = F.greatest(F.lit(0), F.size("shared") - need + 1)
    central = F.aggregate("shared", F.lit(0).cast("long"), lambda s, x: s + x["df"])
    return shared.select("rep", "n", central.alias("central"), F.explode(F.slice("shared", 1, left)).alias("x")).select("rep", "n", "central", F.col("x.value").alias("value"))


def _marks(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks = [], []
            for x in batch.column(1):
                held = x.values.to_numpy()
                places = wd.mix(held.view(np.uint64)) % np.uint64(64 * words)
                own = np.zeros(64 * words, np.uint8)
                own[places.astype(np.int64)] = 1
                sizes.append(len(held))
                marks.append(np.packbits(own, bitorder="little").view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.list_(pa.int64()))], names=["rep", "most", "marks"])

    return run


def _shared_marks(sets: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """``rep, most, marks``: how many of a class's shingles some other class of ``rows`` holds too, and a bit for the place of each."""
    held = sets.join(rows.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", F.explode("held").alias("shingle"))
    common = held.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    own = held.join(common, "shingle", "left_semi").groupBy(F.col("id").alias("rep")).agg(F.collect_list("shingle").alias("held"))
    return own.mapInArrow(serving("near", _marks(words)), f"rep {sets.schema['id'].dataType.simpleString()}, most long, marks array<long>")


def near_duplicates(docs: DataFrame, params: NearDuplicateParams = NearDuplicateParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``n_shingles``, ``component_id`` (the smallest id linked with it, directly or not) and ``kept``."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    sketches = cut(texts.mapInArrow(serving("near", _sketcher(params.shingle, params.k)), f"id {kind}, n long, key binary, sketch array<long>"), "sketches")
    classes = cut(sketches.where("n > 0").groupBy("key", "n").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch")), "classes")
    lists = cut(_listed(classes, params), "lists")
    several = lists.groupBy("value").agg(F.count("*").alias("members")).where("members > 1")
    lists = cut(lists.join(several, "value"), "lists-of-two")
    ids = lists.select(F.col("rep").alias("id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= params.broadcast_ids else ids
    sets = cut(texts.join(ids, "id", "left_semi").mapInArrow(serving("near", _full(params.shingle)), f"id {kind}, held array<long>"), "sets")

    links = _Links(classes.select("rep", "n", "sketch"), sets, params)
    # The two most central members of every list against all of it.
    rank = F.row_number().over(W.partitionBy("value").orderBy(F.desc("central"), "rep"))
    heads = lists.select("value", F.col("rep").alias("y"), rank.alias("rank")).where("rank <= 2")
    links.add(lists.join(heads, "value").where("rep != y").select(F.col("rep").alias("x"), "y"))
    for heads_of_main in (8, None):
        rows = lists.join(links.of(), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        sizes = rows.groupBy("value", "component").agg(F.count("*").alias("members"))
        main = sizes.groupBy("value").agg(F.max_by("component", F.struct("members", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        rows = cut(rows.drop("members").join(main, "value"), "open")
        if not rows.head(1):
            break
        if not heads_of_main:  # at most what a class shares with any other of the open lists can be in common
            rows = cut(rows.join(_shared_marks(sets, rows, params.mark_words), "rep"), "open-shared")
        else:
            rows = rows.withColumns({"most": F.col("n"), "marks": F.lit(None).cast("array<long>")})
        rows = rows.where(100 * F.col("most") >= params.percent * F.col("n"))
        side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "most", "marks", "component")]
        apart = rows.where("component != main").select("value", *side("x"))
        against = rows.select("value", "central", "main", *side("y"))
        if heads_of_main:
            rank = F.row_number().over(W.partitionBy("value").orderBy(F.desc("central"), "rep_y"))
            against = against.where("component_y = main").withColumn("rank", rank).where(F.col("rank") <= heads_of_main)
        # A shared shingle sets a bit in both; bits that several shingles of a side share can hide as many.
        bits = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x))
        both = bits(F.zip_with("marks_x", "marks_y", lambda x, y: x.bitwiseAND(y)))
        hidden = F.least(F.col("most_x") - bits(F.col("marks_x")), F.col("most_y") - bits(F.col("marks_y")))
        in_reach = lambda shared: (100 + params.percent) * shared >= params.percent * (F.col("n_x") + F.col("n_y"))
        near = in_reach(F.least("most_x", "most_y")) & F.coalesce(in_reach(both + hidden), F.lit(True))
        links.add(apart.join(against, (apart["value"] == against["value"]) & (F.col("component_x") != F.col("component_y")) & near).select(F.col("rep_x").alias("x"), F.col("rep_y").alias("y")))

    groups = classes.join(links.of(), "rep", "left").select("key", "n", F.coalesce("component", "rep").alias("component"))
    out = sketches.select("id", "n", "key").join(groups, ["key", "n"], "left")
    found = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("id") == found, F.lit(True)).alias("kept"))
