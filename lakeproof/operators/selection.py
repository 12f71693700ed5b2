"""Picking rows: weights, samples, extremes, pages, early stopping and parity cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeproof.functions.scalars import next_lcg, text_number


def class_histogram(rows: DataFrame, label: str, classes: int) -> DataFrame:
    """Rows of every class 0 to ``classes - 1``, 0 where there is none, with the balanced weight N / (K max(n, 1))."""
    own = rows.groupBy(F.col(label).cast("int").alias("cls")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias("cls"))
    out = every.join(own, "cls", "left").select("cls", F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("weight", F.sum("n").over(W.partitionBy()) / (classes * F.greatest("n", F.lit(1))))


def sample(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """``k`` rows without replacement, by a seeded hash of their key."""
    return rows.orderBy(text_number(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(k)


def extremes(rows: DataFrame, value: str, key: str, k: int = 3) -> DataFrame:
    """The ``k`` smallest and ``k`` largest rows."""
    low = rows.orderBy(value, key).limit(k).withColumn("end", F.lit("low"))
    return low.unionByName(rows.orderBy(F.desc(value), key).limit(k).withColumn("end", F.lit("high")))


def distinct_errors(rows: DataFrame, k: int = 4) -> DataFrame:
    """The most confident errors of different (truth, prediction) pairs."""
    first = F.row_number().over(W.partitionBy("y_true", "y_pred").orderBy(F.desc("conf"), "test_index"))
    return rows.where("y_true != y_pred").withColumn("_r", first).where("_r = 1").orderBy(F.desc("conf"), "test_index").limit(k).drop("_r")


def pages(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Rows with ``page`` and ``place``, for lists short enough to be looked at."""
    at = F.row_number().over(W.orderBy(*order)) - 1
    return rows.withColumn("_at", at).withColumns({"page": F.floor(F.col("_at") / size), "place": F.col("_at") % size}).drop("_at")


def pair_samples(pairs: DataFrame, operative: int) -> DataFrame:
    """The closest pair, and the farthest within the operative distance."""
    near = pairs.orderBy("distance", "a", "b").limit(1).withColumn("kind", F.lit("closest"))
    return near.unionByName(pairs.where(F.col("distance") <= operative).orderBy(F.desc("distance"), "a", "b").limit(1).withColumn("kind", F.lit("farthest")))


def training_progress(epochs: DataFrame, by: str, epoch: str, score: str, patience: int = 8) -> DataFrame:
    """Best score so far, epochs since it rose, and whether patience has run out."""
    w = W.partitionBy(by).orderBy(epoch).rowsBetween(W.unboundedPreceding, 0)
    out = epochs.withColumn("best", F.max(score).over(w))
    before = F.max(score).over(W.partitionBy(by).orderBy(epoch).rowsBetween(W.unboundedPreceding, -1))
    out = out.withColumn("_rise", F.when(before.isNull() | (F.col(score) > before), F.col(epoch)))
    out = out.withColumn("waited", F.col(epoch) - F.max("_rise").over(w))
    return out.withColumn("stop", F.col("waited") >= patience).drop("_rise")


def parity_cases(cases: DataFrame, case: str, steps: int) -> DataFrame:
    """Each case's numbers from the generator, from seed 1000 + 7919 i: ``case, step, value`` in [0, 1)."""
    seed = (F.lit(1000) + 7919 * F.col(case)).cast("long")
    chain = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(seed), lambda s, _: F.array_append(s, next_lcg(F.element_at(s, -1))))
    rows = cases.select(F.col(case).alias("case"), F.posexplode(chain).alias("step", "state")).where("step > 0")
    return rows.select("case", "step", (F.col("state") / F.lit(2147483648.0)).alias("value"))


def open_runs(runs: DataFrame, by: tuple[str, ...], finished: Column) -> DataFrame:
    """Combinations of the values of ``by`` that ``runs`` has, of which no group meets ``finished`` (an aggregate). The values of a column are few."""
    grid = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [runs.select(c).where(F.col(c).isNotNull()).distinct() for c in by])
    return grid.join(runs.groupBy(*by).agg(finished.alias("_done")).where("_done").select(*by), list(by), "left_anti")


def declared_totals(found: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Counts found and declared per key, and their difference; null where nothing is declared."""
    own = found.groupBy(key).agg(F.count("*").alias("found"))
    return own.join(declared, key, "left").withColumn("delta", F.col("found") - F.col("declared"))


def device_facts(lines: DataFrame, text: str = "value") -> DataFrame:
    """Memory in GB, cores and battery degrees from the text of device reports; null where a report lacks them."""
    t = F.col(text)
    number = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")).try_cast("double")
    heat = number(r"temperature: ?(-?[0-9.]+)")
    return lines.select("*", F.round(number(r"MemTotal: *([0-9]+) kB") / 1024 / 1024, 2).alias("mem_total_gb"), F.regexp_count(t, F.lit(r"processor\s*:")).alias("cores"), F.when(F.abs(heat) > 1000, heat / 1000).otherwise(heat).alias("degrees"))
