"""Quarantine, leakage-safe and naive splits, and the rules that they must keep."""

from __future__ import annotations

import itertools
from collections import Counter
from fractions import Fraction
from functools import reduce
from math import lcm

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from lakeproof.functions.scalars import text_number
from lakeproof.operators.dedup import numbered

FRACTIONS = {"train": 0.70, "validation": 0.15, "test": 0.15}
#: Kinds of groups (size and mix of classes, about 100 bytes each) that are broadcast at most.
BROADCAST_RUNS = 50_000


def quarantined(rows: DataFrame, key: str, label: str, group: str, status: str | None = None) -> DataFrame:
    """Rows that no split may have, with the first reason: undecodable, then in a group of several labels."""
    crossed = rows.groupBy(group).agg(F.count_distinct(label).alias("labels")).where("labels > 1").select(group, F.lit(True).alias("_cross"))
    out = rows.join(crossed, group, "left")
    bad = F.when(F.col(status) != "ok", F.concat(F.lit("undecodable:"), F.col(status))) if status else F.lit(None).cast("string")
    return out.withColumn("reason", F.coalesce(bad, F.when(F.col("_cross"), "cross_label_group"))).where("reason is not null").select(key, label, group, "reason")


def _class_places(rows: DataFrame, label: str, order: list) -> DataFrame:
    """``rows`` with ``_r``, their place from 1 within their class, and ``_n``, its size: numbered over ranges, so that no class is one task."""
    classes = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))  # a row per class
    classes = classes.withColumn("_before", F.sum("_n").over(W.orderBy("_label")) - F.col("_n"))
    placed = numbered(rows, [F.col(label), *order], "_at")
    return placed.join(F.broadcast(classes), F.col(label).eqNullSafe(F.col("_label"))).withColumn("_r", F.col("_at") - F.col("_before")).drop("_label", "_before", "_at")


def naive_split(rows: DataFrame, key: str, label: str, seed: int = 42, fractions: dict[str, float] = FRACTIONS) -> DataFrame:
    """Per class, rows in a seeded order: the first shares (rounded half to even) to train and validation, the rest to test."""
    order = text_number(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    ranked = _class_places(rows.select(key, label, order.alias("_o")), label, [F.col("_o"), F.col(key)])
    train, val = F.bround(F.col("_n") * fractions["train"]), F.bround(F.col("_n") * fractions["validation"])
    return ranked.select(key, label, F.when(F.col("_r") <= train, "train").when(F.col("_r") <= train + val, "validation").otherwise("test").alias("split"))


def share_runs(runs: list[tuple[int, object, list[tuple[object, int]], int]], fractions: dict[str, float] = FRACTIONS) -> list[list[tuple[int, list[str]]]]:
    """Where the groups of each run go: ``(from, pattern)`` segments, group ``i`` of a segment going to ``pattern[(i - from) % len(pattern)]``.

    A run is ``size, dominant class, rows by class, number of groups`` of groups that are alike; runs are filled in order. Each group
    goes to the split that lacks most rows of its dominant class, among equals to the one that lacks most rows of all classes, then to the
    greatest name. Groups of a run change all splits' lacks alike, so once every split has had one in turn the turns repeat."""
    shares = {s: Fraction(str(f)) for s, f in fractions.items()}
    unit = lcm(*[f.denominator for f in shares.values()])
    totals: Counter = Counter()
    for _, _, counts, groups in runs:
        for c, n in counts:
            totals[c] += n * groups
    quota = {s: {c: int(f * unit) * n for c, n in totals.items()} for s, f in shares.items()}
    whole = {s: sum(q.values()) for s, q in quota.items()}
    filled, all_filled = {s: Counter() for s in shares}, Counter()
    out = []
    for size, dominant, counts, groups in runs:
        own, taken = dict(counts)[dominant], Counter()
        lack = lambda s: (quota[s][dominant] - unit * (filled[s][dominant] + own * taken[s]), whole[s] - unit * (all_filled[s] + size * taken[s]), s)  # noqa: E731, B023
        segments, done = [], 0
        while done < groups:
            turn = []
            for _ in range(min(len(shares), groups - done)):
                turn.append(max(shares, key=lack))
                taken[turn[-1]] += 1
            if len(set(turn)) == len(shares):  # all in turn: so it goes on to the end
                full, rest = divmod(groups - done, len(turn))
                for i, s in enumerate(turn):
                    taken[s] += full - 1 + (i < rest)
                segments.append((done, turn))
                break
            segments += [(done + i, [s]) for i, s in enumerate(turn)]
            done += len(turn)
            first, second = sorted(shares, key=lack)[:-3:-1]
            ahead = min((lack(first)[0] - lack(second)[0]) // (unit * own) - 1, groups - done)
            if ahead > 0:  # as long as it lacks more than any other
                segments.append((done, [first]))
                taken[first] += ahead
                done += ahead
        for s, n in taken.items():
            all_filled[s] += n * size
            for c, k in counts:
                filled[s][c] += n * k
        out.append(segments)
    return out


def group_split(rows: DataFrame, key: str, label: str, group: str, seed: int = 42, fractions: dict[str, float] = FRACTIONS) -> DataFrame:
    """Whole groups to splits so that classes keep their shares: the largest groups first, those of one size class by class and in a
    seeded order, by the rule of :func:`share_runs`.

    The rule asks for one sequence over all groups, but groups of one size and the same rows by class are alike: only how many there are is
    gathered (a row per size and mix of classes; there are fewer sizes than the root of twice the rows). Each group then finds its
    split by its place in its run. Rows of a null group belong to none and are left out; a null class is a class."""
    counts = rows.where(F.col(group).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    mix = F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), "n")))  # of one group: a few classes
    groups = counts.groupBy(F.col(group).alias("_g")).agg(F.max_by(F.struct(F.col(label).alias("label")), F.struct("n", -F.col("first"))).alias("dominant"), F.sum("n").alias("size"), mix.alias("mix"))
    jitter = text_number(F.concat(F.col("_g").cast("string"), F.lit(f":{seed}")))
    placed = numbered(groups.withColumn("_jitter", jitter), [F.desc("size"), F.col("dominant"), F.col("mix"), F.col("_jitter"), F.col("_g")], "_at")
    runs = groups.groupBy("size", "dominant", "mix").agg(F.count("*").alias("n")).orderBy(F.desc("size"), "dominant", "mix").collect()
    plans = share_runs([(r["size"], r.dominant.label, [(x.label, x.n) for x in r.mix], r.n) for r in runs], fractions)
    before = itertools.accumulate([r.n for r in runs], initial=0)
    kind = groups.schema
    made = rows.sparkSession.createDataFrame(
        [(r["size"], r.dominant, r.mix, b, plan) for r, b, plan in zip(runs, before, plans)],
        StructType([kind["size"], kind["dominant"], kind["mix"]]).add("_before", LongType()).add("_plan", ArrayType(StructType().add("a", LongType()).add("turns", ArrayType(StringType())))),
    )
    at = F.col("_at") - 1 - F.col("_before")
    segment = F.element_at(F.filter("_plan", lambda x: x["a"] <= at), -1)
    split = F.get(segment["turns"], ((at - segment["a"]) % F.size(segment["turns"])).cast("int"))
    found = placed.join(F.broadcast(made) if len(runs) <= BROADCAST_RUNS else made, ["size", "dominant", "mix"]).select(F.col("_g").alias(group), split.alias("split"))
    return rows.join(found, group).select(key, label, group, "split")


def distribution(split: DataFrame, label: str) -> DataFrame:
    n = F.count("*")
    return split.groupBy("split", label).agg(n.alias("n")).withColumn("fraction", F.round(F.col("n") / F.sum("n").over(W.partitionBy(label)), 4))


def crossing_pairs(split: DataFrame, rows: DataFrame, key: str, group: str) -> DataFrame:
    """``n``: pairs of different keys of one group whose splits differ, counted from the sizes of groups without forming a pair.

    ``split`` may hold a key several times, each time counts; a null group has no pairs."""
    held = split.select(key, "split").join(rows.select(key, F.col(group).alias("_g")), key).where("_g is not null")
    square = lambda c: F.col(c).cast("decimal(19,0)") * F.col(c).cast("decimal(19,0)")

    def unlike(by: str) -> DataFrame:
        sizes = held.groupBy(by, "split").agg(F.count("*").alias("_k")).groupBy(by).agg(F.sum("_k").alias("_n"), F.sum(square("_k")).alias("_same"))
        return sizes.agg(F.coalesce(F.sum(square("_n") - F.col("_same")), F.lit(0)).alias("n"))

    each = unlike("_g").unionByName(unlike(key).select((-F.col("n")).alias("n")))
    return each.agg((F.sum("n") / 2).cast("long").alias("n"))


def violations(split: DataFrame, rows: DataFrame, quarantine: DataFrame, key: str, label: str, group: str, digest: str, pairs: DataFrame | None = None, every_pair: bool = False, tolerance: float = 0.02) -> DataFrame:
    """``rule, n``: rows that break each rule; a sound split has 0 everywhere (share rules count splits or classes).

    Rule ``pairs`` counts those of ``pairs`` that cross, or with ``every_pair`` all within groups."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
    twice = lambda c: split.join(rows.select(key, F.col(digest).alias("_digest")), key).groupBy(c).agg(F.count_distinct("split").alias("s")).where("s > 1")
    every = split.select(key).unionByName(quarantine.select(key))
    shares = split.groupBy("split").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))
    target = F.element_at(F.create_map(*[x for s, f in FRACTIONS.items() for x in (F.lit(s), F.lit(f))]), F.col("split"))
    classes = split.groupBy(label, "split").agg(F.count("*").alias("n")).withColumn("want", F.sum("n").over(W.partitionBy(label)) * target)
    out = [
        one(split.groupBy(key).agg(F.count_distinct("split").alias("s")).where("s > 1"), "disjoint"),
        one(rows.select(key).join(every, key, "left_anti").unionByName(every.join(rows, key, "left_anti")), "complete"),
        one(split.join(quarantine, key, "left_semi"), "quarantine"),
        one(split.groupBy("split").agg(F.count_distinct(label).alias("c")).crossJoin(F.broadcast(split.agg(F.count_distinct(label).alias("k")))).where("c < k"), "classes"),
        one(twice(group), "groups"),
        one(twice("_digest"), "digests"),
        one(shares.where(F.abs(F.col("share") - target) >= tolerance), "shares"),
        one(classes.where(F.abs(F.col("n") - F.col("want")) > F.greatest(F.lit(6.0), 0.25 * F.col("want"))), "class_shares"),
    ]
    if pairs is not None:
        side = lambda s: split.select(F.col(key).alias(s), F.col("split").alias(f"split_{s}"))
        out.append(one(pairs.join(side("a"), "a").join(side("b"), "b").where("split_a != split_b"), "pairs"))
    elif every_pair:
        out.append(crossing_pairs(split, rows, key, group).select(F.lit("pairs").alias("rule"), "n"))
    return reduce(DataFrame.unionByName, out)
