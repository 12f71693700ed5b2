"""Temperature, risk-coverage curves and abstention policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.functions.scalars import logits_of, softmax


def risk_coverage(rows: DataFrame, points: int = 200) -> DataFrame:
    """``step, threshold, coverage, n_kept, risk``: rows of ``conf`` at or above each threshold; no risk where none is kept.

    A row counts towards every threshold up to its own last one, so the rows are aggregated once and summed downwards."""
    last = F.floor(F.col("conf") * (points - 1)).cast("int")
    # Guard against the product's rounding: the threshold itself decides.
    last = F.when((last + 1) / F.lit(float(points - 1)) <= F.col("conf"), last + 1).when(last / F.lit(float(points - 1)) > F.col("conf"), last - 1).otherwise(last)
    own = rows.groupBy(last.alias("last")).agg(F.count("*").alias("k"), F.sum(1 - F.col("correct")).alias("bad"))
    steps = rows.sparkSession.range(points).select(F.col("id").cast("int").alias("step"))
    sums = steps.join(F.broadcast(own), F.col("last") >= F.col("step"), "left").groupBy("step").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_kept"), F.sum("bad").alias("bad"))  # at most ``points`` rows each
    total = rows.agg(F.count("*").alias("n"))
    return sums.crossJoin(F.broadcast(total)).select("step", (F.col("step") / F.lit(float(points - 1))).alias("threshold"), (F.col("n_kept") / F.col("n")).alias("coverage"), "n_kept", F.try_divide(F.col("bad").cast("double"), F.col("n_kept").cast("double")).alias("risk"))


def pick_threshold(curve: DataFrame, target: float = 0.05, floor: float = 0.70) -> DataFrame:
    """The lowest threshold within risk and coverage; else the least risk at the coverage floor; else none (0)."""
    ok = (F.col("coverage") >= floor) & F.col("risk").isNotNull()
    good = F.min(F.when(ok & (F.col("risk") <= target), F.col("threshold")))
    least = F.min(F.when(ok, F.struct("risk", "threshold")))
    return curve.agg(good.alias("good"), least.alias("least")).select(
        F.coalesce("good", F.col("least.threshold"), F.lit(0.0)).alias("threshold"), F.when(F.col("good").isNotNull(), "feasible").when(F.col("least").isNotNull(), "least_risk").otherwise("disabled").alias("mode")
    )


def selective(rows: DataFrame, threshold: float) -> DataFrame:
    """Coverage, answered and abstained rows and accuracies at a threshold (at or above answers)."""
    kept = F.col("conf") >= threshold
    return rows.agg(
        F.avg(kept.cast("int")).alias("coverage"),
        F.count_if(kept).alias("n_answered"),
        F.count_if(~kept).alias("n_abstained"),
        F.avg(F.when(kept, F.col("correct"))).alias("selective_accuracy"),
        F.avg(F.when(kept, 1 - F.col("correct"))).alias("selective_risk"),
        F.avg(F.when(~kept, F.col("correct"))).alias("abstained_accuracy"),
    )


def temperature_nll(preds: DataFrame, low: float = 0.05, high: float = 10.0, points: int = 400) -> DataFrame:
    """Mean NLL at every temperature of a logarithmic grid: ``step, temperature, nll``."""
    step = (F.log(F.lit(high)) - F.log(F.lit(low))) / (points - 1)
    rows = preds.select("y_true", logits_of(F.col("probs")).alias("z")).select("y_true", "z", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("step"))
    rows = rows.withColumn("temperature", F.exp(F.log(F.lit(low)) + F.col("step") * step))
    p = F.get(softmax(F.col("z"), F.col("temperature")), F.col("y_true"))
    return rows.groupBy("step", "temperature").agg(F.avg(-F.ln(F.greatest(p, F.lit(1e-12)))).alias("nll"))


def fit_temperature(preds: DataFrame, rounds: int = 4, points: int = 50) -> float:
    """The temperature of least NLL, by nested grids around the best point so far; one aggregate a round."""
    low, high, best = 0.05, 10.0, 1.0
    for _ in range(rounds):
        best = temperature_nll(preds, low, high, points).agg(F.min_by("temperature", F.struct("nll", "temperature")).alias("t")).first().t
        if best is None:
            return 1.0
        ratio = (high / low) ** (1 / (points - 1))
        low, high = best / ratio, best * ratio
    return float(best)
