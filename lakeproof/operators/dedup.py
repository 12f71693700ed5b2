"""Near-duplicate rows by bit hashes: similarity join, components, threshold sweep."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeproof.functions.scalars import hamming
from lakeproof.session import ship


def sign_hash(vectors: DataFrame, key: str, vector: str, bits: int = 64) -> DataFrame:
    """``id, words``: the signs of a vector's elements as 64-bit words."""
    words = [
        F.aggregate(F.slice(F.transform(vector, lambda x: (x >= 0).cast("long")), 64 * w + 1, 64), F.lit(0).cast("long"), lambda s, b: F.call_function("shiftleft", s, F.lit(1)).bitwiseOR(b))
        for w in range(bits // 64)
    ]
    return vectors.select(F.col(key).alias("id"), F.array(*words).alias("words"))


#: Rows of a block of the block-wise comparison, at most about.
BLOCK_ROWS = 4_096
#: Rough costs of one comparison of a 64-bit word within a block, one probe of a chunk table and one candidate, in microseconds.
_COSTS = (0.004, 1.0, 1.5)


def chunk_plan(bits: int, threshold: int, chunks: int) -> list[tuple[int, int, int]]:
    """``first bit, width, radius`` of each chunk. Of two hashes within ``threshold`` bits one chunk at least differs in its radius or
    fewer: the radii plus one each sum to ``threshold + 1``. Chunks whose radius would be negative are left out."""
    edges = [bits * i // chunks for i in range(chunks + 1)]
    whole, more = divmod(threshold + 1, chunks)
    return [(a, b - a, whole - 1 + (i < more)) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a and whole - 1 + (i < more) >= 0]


def best_chunks(n: int, bits: int, threshold: int) -> int:
    """How many chunk tables compare ``n`` random hashes at the least cost; 0 where comparing blocks of rows costs less."""
    best, cost = 0, n * n / 2 * (bits / 64) * _COSTS[0]
    for chunks in range(1, min(bits, 2 * threshold + 2) + 1):
        plan = chunk_plan(bits, threshold, chunks)
        if max(w for _, w, _ in plan) > 62:
            continue
        probes = [sum(math.comb(w, k) for k in range(r + 1)) for _, w, r in plan]
        if max(probes) <= 100_000:  # the masks are broadcast
            own = n * sum(probes) * _COSTS[1] + n * n / 2 * sum(p / 2.0**w for p, (_, w, _) in zip(probes, plan)) * _COSTS[2]
            best, cost = (chunks, own) if own < cost else (best, cost)
    return best


def chunk_candidates(hashes: DataFrame, threshold: int, bits: int, chunks: int) -> DataFrame:
    """``a < b`` with their words, some pairs several times: pairs that agree in a chunk up to its radius.

    One table per chunk (all in one, keyed by chunk and value), which every row probes with its own value under all masks of the radius."""
    plan = chunk_plan(bits, threshold, chunks)

    def value(a: int, width: int) -> Column:
        low = F.shiftrightunsigned(F.get("words", F.lit(a // 64)), 64 - (a % 64) - width) if a % 64 + width <= 64 else None
        if low is None:  # the chunk spans two words
            left = 64 - a % 64
            low = F.shiftleft(F.get("words", F.lit(a // 64)), width - left).bitwiseOR(F.shiftrightunsigned(F.get("words", F.lit(a // 64 + 1)), 64 - (width - left)))
        return low.bitwiseAND((1 << width) - 1)

    values = F.array(*[F.struct(F.lit(i).alias("chunk"), value(a, w).alias("value")) for i, (a, w, _) in enumerate(plan)])
    rows = hashes.select("id", "words", F.explode(values).alias("x")).select("id", "words", "x.chunk", "x.value")
    masks = [(i, sum(1 << bit for bit in at)) for i, (_, w, r) in enumerate(plan) for k in range(r + 1) for at in itertools.combinations(range(w), k)]
    masks = hashes.sparkSession.createDataFrame(masks, "chunk int, mask long")
    probes = rows.select(F.col("id").alias("b"), F.col("words").alias("w_b"), "chunk", F.col("value").alias("own")).join(F.broadcast(masks), "chunk").withColumn("value", F.col("own").bitwiseXOR(F.col("mask")))
    return rows.select(F.col("id").alias("a"), F.col("words").alias("w_a"), "chunk", "value").join(probes, ["chunk", "value"]).where("a < b").select("a", "b", "w_a", "w_b")


def _block_pairs(hashes: DataFrame, threshold: int, blocks: int) -> DataFrame:
    """Pairs within ``threshold``: rows are dealt to blocks, and a task compares two blocks, word by word, as arrays."""
    kind = hashes.schema["id"].dataType.simpleString()

    def run(batch: pa.Table) -> pa.Table:
        block, low, high = (batch.column(c).to_numpy() for c in ("block", "low", "high"))
        words = np.array(batch.column("words").to_pylist(), np.int64).reshape(len(block), -1).view(np.uint64)
        ids, one, two = batch.column("id"), np.flatnonzero(block == low), np.flatnonzero(block == high)
        found = []
        for part in np.array_split(one, max(1, len(one) * len(two) // 1_000_000)):
            d = np.zeros((len(part), len(two)), np.int32)
            for w in range(words.shape[1]):
                d += np.bitwise_count(words[part, w][:, None] ^ words[two, w][None, :])
            i, j = np.nonzero(d <= threshold)
            own = (part[i] < two[j]) if low[0] == high[0] else np.ones(len(i), bool)
            found.append((part[i][own], two[j][own], d[i, j][own]))
        a, b, d = (np.concatenate(x) for x in zip(*found))
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "distance": pa.array(d.astype(np.int32))})

    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least(j, F.col("block")).alias("low"), F.greatest(j, F.col("block")).alias("high"))))
    rows = hashes.select("id", "words", block.alias("block")).withColumn("pair", pair).select("id", "words", "block", "pair.low", "pair.high")
    found = rows.groupBy("low", "high").applyInArrow(run, f"a {kind}, b {kind}, distance int")
    return found.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


def hamming_pairs(hashes: DataFrame, threshold: int, bits: int = 64, chunks: int | None = None) -> DataFrame:
    """``a < b, distance``: all pairs within ``threshold`` bits. Null hashes have no pair.

    Either by chunk tables (multi-index hashing) or, where the number of rows or a wide threshold makes those cost more, by comparing blocks
    of rows; ``chunks`` names the number of tables instead of asking the costs, 0 the blocks. Both give the same pairs."""
    hashes = hashes.where("words is not null").select("id", "words")
    n = hashes.count() if not chunks else 0
    chunks = best_chunks(n, bits, threshold) if chunks is None else chunks
    if not chunks:
        return _block_pairs(hashes, threshold, max(1, min(4, n // 256), -(-n // BLOCK_ROWS))).distinct()
    near = chunk_candidates(hashes, threshold, bits, chunks)
    return near.withColumn("distance", hamming(F.col("w_a"), F.col("w_b"))).where(F.col("distance") <= threshold).select("a", "b", "distance").distinct()


def confirmed(pairs: DataFrame, vectors: DataFrame, key: str, vector: str, least: float, operative: int) -> DataFrame:
    """Pairs with their cosine similarity, whether it confirms them and whether they count as duplicates."""
    side = lambda s: vectors.select(F.col(key).alias(s), F.transform(vector, lambda x: x.cast("double")).alias(f"v_{s}"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    cosine = dot("v_a", "v_b") / F.sqrt(dot("v_a", "v_a") * dot("v_b", "v_b"))
    return rows.select("a", "b", "distance", cosine.alias("cosine")).withColumn("passes", F.col("cosine") >= least).withColumn("duplicate", F.col("passes") & (F.col("distance") <= operative))


def _held(df: DataFrame) -> DataFrame:
    """``df`` computed once: written to the checkpoint folder, or cached in a session that has none."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.cache()


#: Edges that one task takes at most to find groups by itself; more go round by round over joins.
LOCAL_EDGES = 1_000_000
#: Edges of a part, in which edges that close a circle are dropped before what is left is one task.
PART_EDGES = 50_000


def _merging(u: pa.ChunkedArray, v: pa.ChunkedArray) -> tuple[pa.Array, list[int], list[bool]]:
    """Sorted ids, the place of the least id that each is linked with, and which edges, taken in their order, linked two groups."""
    ids = pc.unique(pa.chunked_array([*u.chunks, *v.chunks], u.type))
    ids = ids.take(pc.sort_indices(ids))
    root, used = list(range(len(ids))), []
    for x, y in zip(pc.index_in(u, value_set=ids).to_pylist(), pc.index_in(v, value_set=ids).to_pylist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        used.append(x != y)
        if x < y:
            root[y] = x
        else:
            root[x] = y
    for i, r in enumerate(root):  # roots come before what they hold
        root[i] = root[r]
    return ids, root, used


def _local_components(edges: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``component`` of the ends of edges, the edges of each ``by`` in one task."""
    ship(edges.sparkSession)
    kinds, names = dict(edges.dtypes), list(by)

    def run(part: pa.Table) -> pa.Table:
        ids, root, _ = _merging(part.column("a"), part.column("b"))
        own = [pa.repeat(part.column(c)[0], len(ids)) for c in names]
        return pa.table([*own, ids, ids.take(pa.array(root, pa.int64()))], names=[*names, "id", "least"])

    fields = [*[f"`{c}` {kinds[c]}" for c in by], f"id {kinds['a']}", f"least {kinds['a']}"]
    return edges.withColumn("_all", F.lit(0)).groupBy(*(by or ["_all"])).applyInArrow(run, ", ".join(fields))


def _thinned(edges: DataFrame, parts: int) -> DataFrame:
    """Edges (``a, b, distance``) between groups ``ra`` and ``rb`` without those that close a circle of nearer ones, looked for in each of so many parts.

    A part has a minimum spanning forest of its own edges; that of all of them is among these."""
    ship(edges.sparkSession)
    kinds, names = dict(edges.dtypes), ["a", "b", "distance", "ra", "rb"]

    def run(part: pa.Table) -> pa.Table:
        part = part.select(names).sort_by("distance")
        return part.filter(pa.array(_merging(part.column("ra"), part.column("rb"))[2], pa.bool_()))

    return edges.select(*names, F.pmod(F.xxhash64("ra", "rb"), F.lit(parts)).alias("part")).groupBy("part").applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def components(vertices: DataFrame, edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``id, component`` (least id reachable) of every vertex, per value of ``by``. The ends of edges are vertices.

    Up to ``LOCAL_EDGES`` edges of a value of ``by`` are merged in one task; where there are more, labels spread and jump to a fix point."""
    edges = _held(edges.select(*by, "a", "b").where("a != b").distinct())
    most = edges.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (most or 0) <= LOCAL_EDGES:
        found = _local_components(edges, by)
        return vertices.select(*by, "id").join(found, [*by, "id"], "left").select(*by, "id", F.coalesce("least", "id").alias("component"))
    both = edges.select(*by, F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(*by, F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    both = _held(both)  # every step reads the edges
    labels = vertices.select(*by, "id", F.col("id").alias("component"))
    while True:
        spread = both.join(labels.withColumnRenamed("id", "v"), [*by, "v"]).groupBy(*by, F.col("u").alias("id")).agg(F.min("component").alias("least"))
        near = labels.join(spread, [*by, "id"], "left").select(*by, "id", F.least("component", "least").alias("component"), F.col("component").alias("old"))
        jump = near.select(*by, F.col("id").alias("component"), F.col("component").alias("root"))
        new = near.join(jump, [*by, "component"], "left").select(*by, "id", F.coalesce("root", "component").alias("component"), "old")
        new = _held(new)
        labels, changed = new.drop("old"), new.where("component != old").head(1)
        if not changed:
            return labels


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their place from 1 in an order over all of them: ranges of the order are numbered apart, then moved by what lies before."""
    ranged = _held(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = parts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per partition
    placed = ranged.withColumn("_place", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_before", "_place")


def numbered_counts(rows: DataFrame, by: str, value: str) -> DataFrame:
    """``by, value, _upto``: every distinct value of each group with how many rows of the group have it or a lower one. Running sums are taken
    over ranges of the values and moved by what lies before, so that no group is one task."""
    equal = rows.groupBy(by, value).agg(F.count("*").alias("_n")).repartitionByRange(by, value).withColumn("_part", F.spark_partition_id())
    equal = _held(equal)
    parts = equal.groupBy(by, "_part").agg(F.sum("_n").alias("_s"))
    before = parts.select(by, "_part", (F.sum("_s").over(W.partitionBy(by).orderBy("_part")) - F.col("_s")).alias("_before"))  # a row per group and range
    inside = F.sum("_n").over(W.partitionBy(by, "_part").orderBy(value))
    return equal.withColumn("_in", inside).join(F.broadcast(before), [by, "_part"]).select(by, value, (F.col("_in") + F.col("_before")).alias("_upto"))


def group_numbers(labels: DataFrame) -> DataFrame:
    """``id, group_id, size`` of ``id, component``: groups of one too, the largest first, then by their least id."""
    groups = labels.groupBy("component").agg(F.count("*").alias("size"))
    named = numbered(groups, [F.desc("size"), F.col("component")], "_g").select("component", "size", F.format_string("G%05d", "_g").alias("group_id"))
    return labels.join(named, "component").select("id", "group_id", "size")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The ``a, b, distance`` of a minimum spanning forest: groups at every threshold are those of the forest's edges up to it.

    Edges are thinned in parts of ``PART_EDGES``, of four times as many where this doesn't halve them (a part of few edges among many rows
    has no circles), and of ``LOCAL_EDGES`` at most. Up to ``LOCAL_EDGES`` that are left are one task, more are
    merged in rounds: each component takes its least edge (by distance, then ends, so that no circle closes) and what touches
    is merged; rounds grow with the logarithm of the largest component, edges inside a component are dropped."""
    live = _held(edges.select("a", "b", "distance", F.col("a").alias("ra"), F.col("b").alias("rb")).where("a != b").distinct())
    forest = live.select("a", "b", "distance").limit(0)
    while True:
        n, size = live.count(), PART_EDGES
        while n > size:
            live, before = _held(_thinned(live, -(-n // size))), n
            if 2 * (n := live.count()) > before:
                if 4 * size > LOCAL_EDGES:
                    break
                size *= 4
        if n <= LOCAL_EDGES:
            return forest.unionByName(_thinned(live, 1).select("a", "b", "distance"))
        ends = live.select(F.explode(F.array("ra", "rb")).alias("root"), F.struct("distance", "a", "b", "ra", "rb").alias("edge"))
        picked = _held(ends.groupBy("root").agg(F.min("edge").alias("edge")).select("edge.*").distinct())
        forest = forest.unionByName(picked.select("a", "b", "distance"))
        roots = picked.select(F.explode(F.array("ra", "rb")).alias("id")).distinct()
        labels = _held(components(roots, picked.select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
        for end in ("ra", "rb"):
            live = live.join(labels.withColumnRenamed("id", end), end).drop(end).withColumnRenamed("component", end)
        live = _held(live.where("ra != rb").groupBy("ra", "rb").agg(F.min(F.struct("distance", "a", "b")).alias("edge")).select("edge.*", "ra", "rb"))


def sweep(vertices: DataFrame, edges: DataFrame, thresholds: list[int], exact: DataFrame | None = None) -> DataFrame:
    """Groups at every threshold: ``threshold, links, groups, multi, in_multi, largest``.

    Edges are thinned to a spanning forest once; components of all thresholds come from its edges. ``exact`` (``a, b``) links at any threshold.
    Edges may have a column ``links``, how many links they stand for; without ends they only count."""
    t = vertices.sparkSession.createDataFrame([(x,) for x in thresholds], "threshold int")
    edges = _held(edges.select("a", "b", "distance", F.col("links") if "links" in edges.columns else F.lit(1).cast("long").alias("links")))
    every = edges.select("a", "b", "distance")
    every = every if exact is None else every.unionByName(exact.select("a", "b", F.lit(min(thresholds)).cast(edges.schema["distance"].dataType).alias("distance")))
    linked = _held(spanning_forest(every).join(F.broadcast(t), F.col("distance") <= F.col("threshold")).select("threshold", "a", "b"))  # a short list
    touched = linked.select("threshold", F.explode(F.array("a", "b")).alias("id")).distinct()
    groups = components(touched, linked, ("threshold",)).groupBy("threshold", "component").agg(F.count("*").alias("size"))
    many = groups.groupBy("threshold").agg(F.count("*").alias("multi"), F.sum("size").alias("in_multi"), F.max("size").alias("largest"))
    links = edges.groupBy("distance").agg(F.sum("links").alias("n")).join(F.broadcast(t), F.col("distance") <= F.col("threshold")).groupBy("threshold").agg(F.sum("n").alias("links"))
    total = vertices.agg(F.count("*").alias("total"))
    out = t.join(many, "threshold", "left").join(links, "threshold", "left").crossJoin(F.broadcast(total))  # one row
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("threshold", none("links").alias("links"), (F.col("total") - none("in_multi") + none("multi")).alias("groups"), none("multi").alias("multi"), none("in_multi").alias("in_multi"), F.when(F.col("total") > 0, F.coalesce("largest", F.lit(1))).otherwise(0).cast("long").alias("largest"))
