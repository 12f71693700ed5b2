"""Classifier metrics over ``test_index, y_true, probs``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeproof.functions.hashing import digits_of, text_numbers
from lakeproof.functions.scalars import argmax, safe_ratio
from lakeproof.operators.dedup import _held, numbered
from lakeproof.session import ship


def judged(preds: DataFrame) -> DataFrame:
    """``preds`` with ``conf``, ``y_pred`` and ``correct``."""
    return preds.withColumns({"conf": F.array_max("probs"), "y_pred": argmax(F.col("probs"))}).withColumn("correct", (F.col("y_pred") == F.col("y_true")).cast("int"))


def confusion(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))


def per_class(cm: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``cls, support, tp, fp, fn, precision, recall, f1`` from confusion counts; 0 where a denominator is."""
    sides = cm.select(*by, F.explode(F.array(F.struct(F.col("y_true").alias("cls"), F.lit(1).alias("t"), (F.col("y_pred") != F.col("y_true")).alias("off")), F.struct(F.col("y_pred").alias("cls"), F.lit(0).alias("t"), (F.col("y_pred") != F.col("y_true")).alias("off")))).alias("s"), "n")
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    t, off = F.col("s.t") == 1, F.col("s.off")
    out = sides.groupBy(*by, F.col("s.cls").alias("cls")).agg(count(t).alias("support"), count(t & ~off).alias("tp"), count(~t & off).alias("fp"), count(t & off).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": safe_ratio(tp, tp + fp), "recall": safe_ratio(tp, tp + fn), "f1": safe_ratio(2 * tp, 2 * tp + fp + fn)})


def headline(cm: DataFrame, by: tuple[str, ...] = (), average: str = "present") -> DataFrame:
    """Accuracy, macro averages (over classes present in the truth, or all), balanced accuracy and multiclass MCC."""
    rows = per_class(cm, by)
    kept = rows.where("support > 0") if average == "present" else rows
    macro = kept.groupBy(*by).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    rows = rows.withColumn("called", F.col("tp") + F.col("fp"))
    sums = rows.groupBy(*by).agg(F.sum("support").alias("n"), F.sum("tp").alias("c"), F.sum(F.col("support") * F.col("called")).alias("tp_"), F.sum(F.col("called") * F.col("called")).alias("pp"), F.sum(F.col("support") * F.col("support")).alias("tt"))
    sums = sums.withColumn("accuracy", safe_ratio(F.col("c"), F.col("n")))
    n = F.col("n").cast("double")
    mcc = safe_ratio(F.col("c") * n - F.col("tp_"), F.sqrt(n * n - F.col("pp")) * F.sqrt(n * n - F.col("tt")))
    sums = sums.select(*by, "n", "accuracy", mcc.alias("mcc"))
    out = sums.join(macro, list(by)) if by else sums.crossJoin(F.broadcast(macro))  # one row each
    return out.withColumn("balanced_accuracy", F.col("macro_recall"))


def auroc(preds: DataFrame, classes: int) -> DataFrame:
    """One-vs-rest AUROC per class by average ranks; null where a class has no positive or no negative."""
    long = preds.select("y_true", F.posexplode("probs").alias("cls", "p"))
    equal = long.groupBy("cls", "p").agg(F.count("*").alias("n"), F.count_if(F.col("y_true") == F.col("cls")).alias("pos"))
    # Ranks in two levels, over ranges of p and inside them, so that no task has to sort a whole class.
    equal = equal.withColumn("range", F.floor(F.greatest(F.least(F.col("p"), F.lit(1.0)), F.lit(0.0)) * 4096))
    ranges = equal.groupBy("cls", "range").agg(F.sum("n").alias("n"))
    first = F.coalesce(F.sum("n").over(W.partitionBy("cls").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("cls", "range").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = equal.withColumn("inside", inside).join(ranges.select("cls", "range", first.alias("first")), ["cls", "range"])
    rank = F.col("first") + F.col("inside") + (F.col("n") + 1) / 2.0
    sums = ranked.groupBy("cls").agg(F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"), F.sum(F.col("pos") * rank).alias("s"))
    return sums.where(F.col("cls") < classes).select("cls", "pos", "neg", F.try_divide(F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2.0, (F.col("pos") * F.col("neg")).cast("double")).alias("auroc"))


def reliability(rows: DataFrame, bins: int = 15) -> DataFrame:
    """Equal-width bins (lo, hi] of confidence, the first closed; empty bins with nulls."""
    at = F.greatest(F.ceil(F.col("conf") * bins), F.lit(1)).cast("int")
    own = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("confidence"), F.avg("correct").alias("accuracy"))
    every = rows.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(own, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "confidence", "accuracy")


def calibration(rows: DataFrame, bins: int = 15) -> DataFrame:
    """ECE, MCE, NLL and Brier score in one row."""
    table = reliability(rows, bins).where("n > 0").withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))
    first = table.agg(F.sum(F.col("n") * F.col("gap")).alias("s"), F.sum("n").alias("n"), F.max("gap").alias("mce")).select((F.col("s") / F.col("n")).alias("ece"), "mce")
    own = F.get("probs", F.col("y_true"))
    brier = F.aggregate(F.transform("probs", lambda p, i: F.pow(p - F.when(i == F.col("y_true"), 1.0).otherwise(0.0), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    second = rows.agg(F.avg(-F.ln(F.greatest(F.least(own, F.lit(1.0)), F.lit(1e-12)))).alias("nll"), F.avg(brier).alias("brier"))
    return first.crossJoin(F.broadcast(second))  # one row each


#: Rows of a piece that Spark gathers, and pieces that a task holds at once (4 bytes a row).
PIECE, PIECES = 65_536, 64
#: Groups of draws, which tasks share.
DRAW_GROUPS = 128


def drawn_counts(rows: DataFrame, columns: tuple[str, ...], draws: int) -> DataFrame:
    """``draw, *columns, n``: how often rows with these values are drawn when a resample draws as many rows as there are, with replacement.

    The row drawn is the first 32 bits of the MD5 of ``draw:i`` modulo the number of rows, in the order of ``test_index``. Rows are numbered over
    ranges and become arrays of the number of their values, in pieces; tasks take groups of draws and count in the pieces, at most
    ``PIECES`` at once (more rows make more tasks, which hash again). Draws never become rows."""
    ship(rows.sparkSession)
    rows = _held(rows.select("test_index", *columns))  # counted, summed up and numbered
    n = rows.count()
    kinds = _held(rows.groupBy(*columns).agg(F.count("*").alias("_n")).withColumn("cell", F.row_number().over(W.orderBy(*columns)) - 1))  # a row per combination of classes
    same = lambda: [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns]
    placed = numbered(rows, [F.col("test_index")], "at").alias("l").join(F.broadcast(kinds.alias("r")), same()).select((F.col("at") - 1).alias("at"), "cell")
    pieces = placed.groupBy(F.floor(F.col("at") / PIECE).alias("piece")).agg(F.collect_list(F.struct("at", "cell")).alias("held"))
    size = -(-draws // DRAW_GROUPS)
    groups = rows.sparkSession.range(-(-draws // size)).withColumnRenamed("id", "group")
    held = pieces.select("piece", F.floor(F.col("piece") / PIECES).alias("block"), F.transform("held", lambda x: x["at"]).alias("at"), F.transform("held", lambda x: x["cell"]).alias("cell")).crossJoin(F.broadcast(groups))
    counts = held.groupBy("group", "block").applyInArrow(_counter(n, draws, size, PIECE * PIECES), "draw long, cell int, n long")
    return counts.groupBy("draw", "cell").agg(F.sum("n").alias("n")).join(F.broadcast(kinds.drop("_n")), "cell").select("draw", *columns, "n")


def _counter(n: int, draws: int, size: int, block_rows: int):
    """Counts of a group of draws in one block of rows."""

    def run(part: pa.Table) -> pa.Table:
        first = part.column("block")[0].as_py() * block_rows
        held = np.zeros(min(block_rows, n - first), np.int32)
        for at, cell in zip(part.column("at"), part.column("cell")):
            held[at.values.to_numpy() - first] = cell.values.to_numpy()
        group, cells = part.column("group")[0].as_py(), int(held.max()) + 1
        own = range(group * size, min((group + 1) * size, draws))
        counts = np.zeros((len(own), cells), np.int64)
        low = 0
        while low < n:
            high = min(low + 32_768, n, 10 ** len(str(low)))  # as many digits
            tail = digits_of(low, high)
            for k, d in enumerate(own):
                spots = text_numbers(f"{d}:", tail).astype(np.int64) % n - first
                if len(held) < n:
                    spots = spots[(spots >= 0) & (spots < len(held))]
                counts[k] += np.bincount(held[spots], minlength=cells)
            low = high
        k, c = np.nonzero(counts)
        return pa.table({"draw": pa.array(k + own.start, pa.int64()), "cell": pa.array(c, pa.int32()), "n": counts[k, c]})

    return run


def bootstrap(rows: DataFrame, draws: int) -> DataFrame:
    """Per resample ``draw``: headline metrics. ``rows`` has ``test_index, y_true, y_pred``."""
    return headline(_held(drawn_counts(rows, ("y_true", "y_pred"), draws)), ("draw",))  # read twice, a row per draw and kind


def paired_differences(rows: DataFrame, a: str, b: str, draws: int) -> DataFrame:
    """``draw, diff``: accuracy by ``a`` less that by ``b``, on the same rows drawn."""
    counts = drawn_counts(rows, ("y_true", a, b), draws)
    right = lambda p: F.sum(F.when(F.col(p) == F.col("y_true"), F.col("n")).otherwise(0)).cast("double") / F.sum("n")
    return counts.groupBy("draw").agg((right(a) - right(b)).alias("diff"))


def interval(values: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    q = F.percentile(column, F.array(F.lit(tail), F.lit(1 - tail)))
    return values.agg(F.avg(column).alias("mean"), q.alias("q")).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
