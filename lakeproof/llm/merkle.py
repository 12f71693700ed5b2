"""Merkle manifest of a dataset: one tree over the rows of each source, one over the sources, and a proof for every row.

``H`` is the lowercase hex SHA-256 of its inputs joined, digests as hex text. A leaf is ``H`` of a row's fields. Leaves of a
source stand in order; while several nodes remain, every ``arity`` neighbours (the last run may be shorter) become their
``H``. What remains is the source's subroot; the subroots in order of their source give the root likewise.

1. Leaves are ordered over ranges of (source, key, leaf), never a source in one task, and numbered from counts of the ranges.
2. Levels are built one by one, each an aggregation of runs of neighbours: the node table, a row per run with its digests,
   written in the shared folder. The tree over sources is one more tree of the same table.
3. Each leaf explodes the coordinates of its siblings, from its index and the size of its source: (tree, level, run) at every
   level up to the root. They are joined with the node table, ordered by level and concatenated (the proof) or folded (the
   root as the leaf's holder finds it).

A run at level l is wanted by ``arity ** (l + 1)`` leaves. The upper levels, ``broadcast_runs`` runs at most, are broadcast, so that no key
of the shuffled join is wanted by more than about rows / ``broadcast_runs`` times ``arity`` rows.

Edge cases: a null field counts as ``-``, an empty one as ``0:``; texts are hashed whole; a null source is a source of its own, the
first; null keys come first and are never tampered with; rows of one key stand in order of their leaves, and equal rows, whose
leaves are equal, in any order (each has its own place and proof); a table of one row has that leaf as root and an empty
proof; an empty table gives an empty result; other columns play no part and are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeproof.llm.tables import crc, cut

#: The tree over the sources; sources are numbered from 0.
_TOP = -1


@dataclass(frozen=True)
class MerkleParams:
    arity: int = 3
    #: Runs of nodes (about 150 bytes each) that are broadcast at most.
    broadcast_runs: int = 60_000
    #: Sources whose size and number (about 60 bytes each, with their name) are broadcast at most: the largest ones.
    broadcast_sources: int = 20_000


def field(value: Column) -> Column:
    """A field as it goes into a leaf: UTF-8 byte count, colon, value; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """``H`` as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _placed(rows: DataFrame, order: list[str], name: str, to: str) -> DataFrame:
    """``rows``, written, with their place from 0 in ``order`` (nulls first): ranges are sorted apart and moved by what lies before."""
    order = [F.col(c).asc_nulls_first() for c in order]
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)  # that id's two halves
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row per range
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranged.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(to, F.col("_before") + row).drop("_part", "_at", "_before")


def _powers(arity: int) -> list[int]:
    return [arity**i for i in range(63) if arity**i < 2**62]


def _levels(nodes: DataFrame, most: int, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The node table by level (``tree, level, run, digests``) and ``tree, subroot``, of ``tree, i, n, d``: leaf ``i`` of ``n``, ``most`` in a tree at most."""
    levels, roots = [], []
    while True:
        roots.append(nodes.where("n = 1").select("tree", F.col("d").alias("subroot")))
        if most <= 1:
            return levels, reduce(DataFrame.unionByName, roots)
        runs = nodes.where("n > 1").groupBy("tree", F.floor(F.col("i") / arity).alias("run")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "d"))).alias("held"))
        runs = cut(runs.select("tree", F.lit(len(levels)).alias("level"), "run", "n", F.col("held.d").alias("digests")), "nodes")
        levels.append(runs.drop("n"))
        nodes = runs.select("tree", F.col("run").alias("i"), F.ceil(F.col("n") / arity).alias("n"), digest(F.array_join(F.transform("digests", hexed), "")).alias("d"))
        most = -(-most // arity)


def _indexed(placed: DataFrame, sources: DataFrame, n_sources: int, most: int) -> DataFrame:
    """Leaves with the number of their source (``tree``), their place in it (``i``) and its size (``n``).

    Of many sources the ``most`` largest are broadcast; each of the others has few rows, which meet in a shuffle join."""
    named, own = sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))
    if n_sources <= most:
        out = placed.join(F.broadcast(named), own)
    else:
        large = cut(named.orderBy(F.desc("n"), "first").limit(most), "large-sources")
        marked = placed.join(F.broadcast(large), own, "left")
        rest, few = marked.where("tree is null").drop(*named.columns), named.join(F.broadcast(large.select("tree")), "tree", "left_anti")
        out = marked.where("tree is not null").unionByName(rest.join(few, own).select(marked.columns))
    return out.select("tree", (F.col("place") - F.col("first")).alias("i"), "n", "key", "leaf", "held")


def _path(top_depth: int, arity: int) -> Column:
    """Coordinates of a leaf's siblings, from itself to the root: ``tree, level, run``, its own ``spot`` in that run, and their ``place``."""
    powers = F.array(*[F.lit(x) for x in _powers(arity)])
    depth = F.size(F.filter(powers, lambda p: p < F.col("n"))).cast("int")
    above = lambda levels: F.when(levels > 0, F.sequence(F.lit(0), levels - 1)).otherwise(F.expr("cast(array() as array<int>)"))

    def steps(tree: Column, at: Column, levels: Column, shift: Column) -> Column:
        up = lambda l: F.floor(at / F.get(powers, l))
        return F.transform(above(levels), lambda l: F.struct(tree.cast("long").alias("tree"), l.alias("level"), up(l + 1).alias("run"), (up(l) % arity).cast("int").alias("spot"), (l + shift).alias("place")))

    return F.concat(steps(F.col("tree"), F.col("i"), depth, F.lit(0)), steps(F.lit(_TOP), F.col("tree"), F.lit(top_depth), depth))


def manifest(leaves: DataFrame, params: MerkleParams = MerkleParams()) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` of ``source, key, leaf, held``.

    ``leaf``: the row's digest (32 bytes); ``held``: the digest of the row as its holder has it, null where that is the leaf itself."""
    arity = params.arity
    hashed = cut(leaves.select("source", "key", "leaf", "held"), "hashed")  # ranges are found by a pass of their own, which would hash the texts again
    placed = _placed(hashed, ["source", "key", "leaf"], "leaves", "place")
    sources = _placed(placed.groupBy("source").agg(F.count("*").alias("n"), F.min("place").alias("first")), ["first"], "sources", "tree")
    n_sources, most = sources.agg(F.count("*"), F.max("n")).first()
    indexed = cut(_indexed(placed, sources, n_sources, params.broadcast_sources), "indexed")
    levels, subroots = _levels(indexed.select("tree", "i", "n", F.col("leaf").alias("d")), most or 0, arity)
    over = subroots.select(F.lit(_TOP).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(n_sources).alias("n"), F.col("subroot").alias("d"))
    top, roots = _levels(over, n_sources, arity)
    root = roots.first()  # one digest
    root = F.lit(root.subroot.hex() if root else None).cast("string")

    # From the root down, levels are broadcast as long as they fit; those below join by shuffle.
    left, upper, lower, low = params.broadcast_runs, [], [], {True: len(top), False: len(levels)}
    for of_top, level, runs in [*[(True, l, x) for l, x in reversed([*enumerate(top)])], *[(False, l, x) for l, x in reversed([*enumerate(levels)])]]:
        left -= runs.count()
        (upper if left >= 0 else lower).append(runs)
        if left >= 0:
            low[of_top] = level
    steps = indexed.select(F.col("tree").alias("t"), F.col("i").alias("leaf_at"), F.explode(_path(len(top), arity)).alias("x")).select("t", "leaf_at", "x.*")
    high = F.col("level") >= F.when(F.col("tree") == _TOP, low[True]).otherwise(low[False])
    joined = lambda own, runs: own.join(runs, ["tree", "level", "run"])
    empty = levels[0] if levels else top[0] if top else indexed.select("tree", F.lit(0).alias("level"), F.col("i").alias("run"), F.array("leaf").alias("digests"))
    found = joined(steps.where(high), F.broadcast(reduce(DataFrame.unionByName, upper, empty.limit(0))))
    if lower:
        found = found.unionByName(joined(steps.where(~high), reduce(DataFrame.unionByName, lower)))
    beside = lambda digests: F.aggregate(digests, F.lit(b""), lambda s, x: F.concat(s, x))
    step = F.struct("place", beside(F.slice("digests", F.lit(1), F.col("spot"))).alias("left"), beside(F.slice("digests", F.col("spot") + 2, F.lit(arity))).alias("right"))
    subroot = F.when((F.col("tree") == _TOP) & (F.col("level") == 0), F.get("digests", F.col("spot")))
    paths = found.select("t", "leaf_at", step.alias("step"), subroot.alias("own")).groupBy("t", "leaf_at").agg(F.sort_array(F.collect_list("step")).alias("steps"), F.max("own").alias("own"))

    rows = indexed.join(paths, (F.col("tree") == F.col("t")) & (F.col("i") == F.col("leaf_at")), "left")
    steps = F.coalesce("steps", F.array().cast(paths.schema["steps"].dataType))
    proof = F.array_join(F.transform(steps, lambda x: hexed(F.concat(x["left"], x["right"]))), "")
    folded = F.aggregate(steps, hexed(F.coalesce("held", "leaf")), lambda s, x: F.sha2(F.concat(hexed(x["left"]), s, hexed(x["right"])).cast("binary"), 256))
    out = rows.select("key", hexed(F.col("leaf")).alias("leaf"), F.coalesce(hexed(F.col("own")), root).alias("subroot"), root.alias("root"), F.sha2(proof.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def dataset_manifest(docs: DataFrame, params: MerkleParams = MerkleParams()) -> DataFrame:
    """The manifest of a documents table by its five columns, and what a holder finds whose texts have lost their line feeds
    in the rows whose key has an even crc32."""
    leaf = lambda text: digest(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text))
    tampered = F.when(crc(F.col("doc_id")) % 2 == 0, leaf(F.translate("text", "\n", "")))
    rows = docs.select("source", F.col("doc_id").alias("key"), leaf(F.col("text")).alias("leaf"), tampered.alias("held"))
    return manifest(rows, params).withColumnRenamed("key", "doc_id")
