"""Sharding by balanced label propagation.

Nodes have sizes and belong to link groups (here: documents of equal text). Labels start at random; in every
round a join brings each group the weights of its members' shards, members ask for the heaviest with room, and
requests are granted while the shard's quota lasts: whole groups at a time, members singly where a group is large against a
shard. Then sizes are made even exactly: what lies beyond a shard's share of the total, and all nodes without
links, is laid out in one order and cut at the shards' remaining room, so a shard's size differs from the share by
less than two rows. Running sums are taken in three levels: over blocks of buckets, over buckets and inside them.
What is summed up per group comes back by a broadcast for the few groups of many members, by a shuffle for the others.

Edge cases: null texts count as empty ones, size 1; empty and null ids are values like others; rows of equal text
are one group, even if it fills several shards; fewer rows than shards leave shards empty; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeproof.llm.tables import cut


@dataclass(frozen=True)
class ShardParams:
    shards: int = 16
    rounds: int = 16
    #: Rows of a bucket of the running sums, about.
    bucket_rows: int = 5_000
    #: Groups of more than 1 in this many of all rows, fewer than this many groups, are never shuffled to one task.
    hot_groups: int = 10_000
    #: A group beyond this share of a shard moves member by member.
    large: float = 0.05
    #: A shard takes no more links from this share of its room.
    full: float = 0.97


def _chance(*of) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 40)) / F.lit(float(1 << 40))


def with_groups(rows: DataFrame, groups: DataFrame, least: int) -> DataFrame:
    """``rows`` with the columns of ``groups``, a row of ``grp, members, ...`` for every group of theirs; the groups of
    ``least`` members or more, few by the choice of ``least``, are broadcast."""
    columns = [c for c in groups.columns if c != "grp"]
    hot = groups.where(F.col("members") >= least)
    flagged = rows.join(F.broadcast(hot), "grp", "left")
    few = flagged.where(F.col("members").isNull()).drop(*columns).join(groups.where(F.col("members") < least), "grp")
    return flagged.where(F.col("members").isNotNull()).unionByName(few)


def propagate(nodes: DataFrame, share: float, params: ShardParams, least: int) -> DataFrame:
    """``nodes`` (``id, grp, size, members, own_size``: of its group) with a ``label`` each."""
    state = cut(nodes.withColumn("label", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(params.shards)).cast("int")), "labels")
    for turn in range(params.rounds):
        load = {r.label: r.s for r in state.groupBy("label").agg(F.sum("size").alias("s")).collect()}  # a row per shard
        full = [s for s, x in load.items() if x >= params.full * share]
        # Members in full shards stay; the others ask for their heaviest shard that has room.
        weights = state.groupBy("grp", "members", "label").agg(F.sum("size").alias("w"))
        open_ = F.when(~F.col("label").isin(full), F.struct("w", "label"))
        wish = weights.groupBy("grp", "members").agg(F.max(open_)["label"].alias("wish"))
        asked = cut(with_groups(state.drop("members"), wish, least).withColumn("wish", F.when(F.col("label").isin(full), F.col("label")).otherwise(F.coalesce("wish", "label"))), "asked")
        demand = {r.wish: r.s for r in asked.where("wish != label").groupBy("wish").agg(F.sum("size").alias("s")).collect()}
        grant = {s: min(1.0, max(0.0, share - load.get(s, 0)) / d) for s, d in demand.items() if d}
        if not any(g > 1e-3 for g in grant.values()):
            break
        rate = F.element_at(F.create_map(*[x for s, g in grant.items() for x in (F.lit(s), F.lit(g))]), F.col("wish"))
        draw = F.when(F.col("own_size") > params.large * share, _chance("id", F.lit(turn))).otherwise(_chance("grp", F.lit(turn)))
        moves = (F.col("wish") != F.col("label")) & (draw < F.coalesce(rate, F.lit(0.0)))
        state = cut(asked.withColumn("label", F.when(moves, F.col("wish")).otherwise(F.col("label"))).drop("wish"), "labels")
    return state


def running(rows: DataFrame, by: list[str], bucket: Column, block: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over what stands before in (block, bucket, order), per ``by``; a bucket is in one block."""
    rows = rows.withColumns({"_b": bucket, "_o": block})
    sum_before = lambda x, parts, by_: F.coalesce(F.sum(x).over(W.partitionBy(*parts).orderBy(*by_).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy(*by, "_o", "_b").agg(F.sum(value).alias("_s"))
    blocks = sums.groupBy(*by, "_o").agg(F.sum("_s").alias("_s")).select(*by, "_o", sum_before("_s", by, ["_o"]).alias("_far"))
    sums = sums.select(*by, "_o", "_b", sum_before("_s", [*by, "_o"], ["_b"]).alias("_near")).join(blocks, [*by, "_o"])
    sums = sums.select(*by, "_b", (F.col("_far") + F.col("_near")).alias("_before"))
    rows = rows.drop("_o").withColumn("_inside", sum_before(value, [*by, "_b"], order))
    return rows.join(sums, [*by, "_b"]).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_b", "_before", "_inside")


def shard_documents(docs: DataFrame, params: ShardParams = ShardParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``size, text_crc32, law, shard, slot`` (from 0 in each shard, without gaps) and ``grown_shard`` (null)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("grp"), F.monotonically_increasing_id().alias("row")
    )
    rows = cut(rows, "sizes")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = total / params.shards
    groups = rows.groupBy("grp").agg(F.count("*").alias("members"), F.sum("size").alias("own_size"))
    least = max(2, n // params.hot_groups + 1)
    rows = cut(with_groups(rows, groups, least), "grouped")
    buckets = max(1, -(-n // params.bucket_rows))
    width = max(1, int(buckets**0.5))  # buckets of a block, and about as many blocks
    linked = propagate(rows.where("members > 1"), share, params, least)
    # Groups stand together; a large one is spread over buckets of its own.
    spread = F.floor(F.col("members") / params.bucket_rows)
    first = F.pmod("grp", F.lit(buckets))
    place = F.struct(first, F.when(spread > 0, F.pmod(F.xxhash64("id"), spread) + 1).otherwise(0))
    linked = running(linked, ["label"], place, F.floor(first / width), ["grp", "id", "row"], F.col("size"), "upto")
    linked = cut(linked.withColumn("fits", F.col("upto") + F.col("size") <= share), "linked")
    settled = linked.where("fits")
    load = {r.label: r.s for r in settled.groupBy("label").agg(F.sum("size").alias("s")).collect()}  # a row per shard
    room, ends = 0.0, []
    for s in range(params.shards):
        room += share - load.get(s, 0)
        ends.append(room)
    columns = ["id", "size", "crc", "grp", "row", "members"]
    pool = rows.where("members = 1").select(columns).unionByName(linked.where("not fits").select(columns))
    # Linked rows without room come first, group by group, so that they meet again where there is room.
    single, first = F.when(F.col("members") > 1, 0).otherwise(1), F.pmod(F.when(F.col("members") > 1, F.col("grp")).otherwise(F.xxhash64("id")), F.lit(buckets))
    place = F.struct(single, first, F.when(spread > 0, F.pmod(F.xxhash64("id"), spread) + 1).otherwise(0))
    pool = running(pool.withColumn("all", F.lit(0)), ["all"], place, F.struct(single, F.floor(first / width)), ["grp", "id", "row"], F.col("size"), "upto")
    middle = F.col("upto") + F.col("size") / 2
    target = F.aggregate(F.array(*map(F.lit, ends[:-1])), F.lit(0), lambda s, x: s + (middle >= x).cast("int"))
    out = settled.select("id", "size", "crc", "row", F.col("label").alias("shard")).unionByName(pool.select("id", "size", "crc", "row", target.alias("shard")))
    first = F.pmod(F.xxhash64("id", "row"), F.lit(buckets))
    out = running(cut(out, "shards"), ["shard"], first, F.floor(first / width), ["id", "row"], F.lit(1), "slot")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
