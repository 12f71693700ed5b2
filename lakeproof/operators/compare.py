"""Comparing models: paired tests, multiplicity, seed spread, ranks, parity and robustness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeproof.functions.scalars import safe_ratio


def paired(rows: DataFrame, name: str = "model", by: tuple[str, ...] = ("seed", "test_index")) -> DataFrame:
    """Every two models on the same seed and row: ``model_a, model_b, correct_a, correct_b``."""
    side = lambda s: rows.select(*by, F.col(name).alias(f"model_{s}"), F.col("correct").alias(f"correct_{s}"))
    return side("a").join(side("b"), list(by)).where("model_a < model_b")


def alignment(a: DataFrame, b: DataFrame, key: str = "test_index", label: str = "y_true") -> DataFrame:
    """What keeps two sets of predictions from being paired, in one row: ``only_a, only_b, unlike_labels, repeated``.

    A null label is unlike any label but a null one; a null key is counted as on one side only."""
    side = lambda df, s: df.groupBy(key).agg(F.count("*").alias(f"n_{s}"), F.first(label).alias(f"y_{s}"))
    rows = side(a, "a").join(side(b, "b"), key, "full")
    none = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    both = F.col("n_a").isNotNull() & F.col("n_b").isNotNull()
    return rows.agg(
        none(F.col("n_b").isNull()).alias("only_a"),
        none(F.col("n_a").isNull()).alias("only_b"),
        none(both & ~F.col("y_a").eqNullSafe(F.col("y_b"))).alias("unlike_labels"),
        none((F.coalesce("n_a", F.lit(0)) > 1) | (F.coalesce("n_b", F.lit(0)) > 1)).alias("repeated"),
    )


def require_aligned(a: DataFrame, b: DataFrame, key: str = "test_index", label: str = "y_true", what: str = "predictions") -> None:
    """Refuse to pair sets of predictions that aren't of the same rows and labels."""
    found = alignment(a, b, key, label).first()
    if any(found):
        raise ValueError(f"{what} can't be paired: {found.only_a} rows on one side only, {found.only_b} on the other, {found.unlike_labels} with unlike labels, {found.repeated} repeated")


def require_digest(one: str | None, two: str | None, what: str = "models") -> None:
    """Refuse to compare results of unlike artefacts; a missing digest is unlike any."""
    if not one or not two or one.lower() != two.lower():
        raise ValueError(f"results are of unlike {what}: {one} and {two}")


def paired_outcomes(rows: DataFrame, outcomes: str = "outcomes") -> DataFrame:
    """As :func:`paired`, of rows that hold their outcomes as an array of ``model, seed, correct``: no join, a row per pair of models and seed."""
    other = lambda x: F.transform(F.filter(outcomes, lambda y: (y["seed"] == x["seed"]) & (y["model"] > x["model"])), lambda y: F.struct(x["seed"].alias("seed"), x["model"].alias("model_a"), y["model"].alias("model_b"), x["correct"].alias("correct_a"), y["correct"].alias("correct_b")))
    return rows.select(F.explode(F.flatten(F.transform(outcomes, other))).alias("pair")).select("pair.*")


def binomial_two_sided(b: Column, c: Column) -> Column:
    """Exact two-sided sign test: min(1, 2 P(X <= min(b, c))) for b + c fair draws; 1 without draws."""
    n, k = (b + c).cast("int"), F.least(b, c).cast("int")
    ln_fact = lambda m: F.aggregate(F.when(m < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(m, F.lit(1)))), F.lit(0.0), lambda s, i: s + F.ln(i))
    term = lambda i: F.exp(ln_fact(n) - ln_fact(i) - ln_fact(n - i) - n * F.ln(F.lit(2.0)))
    total = F.aggregate(F.transform(F.sequence(F.lit(0), k), term), F.lit(0.0), lambda s, x: s + x)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def mcnemar(pairs: DataFrame, by: tuple[str, ...] = ("model_a", "model_b", "seed")) -> DataFrame:
    """Discordant counts, exact p, and chi-square with continuity where b + c is 25 or more."""
    a, b = F.col("correct_a") == 1, F.col("correct_b") == 1
    out = pairs.groupBy(*by).agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"), F.count_if(a & b).alias("both_right"), F.count_if(~a & ~b).alias("both_wrong"))
    d = (F.col("b") + F.col("c")).cast("double")
    chi = F.when(d >= 25, F.pow(F.abs(F.col("b") - F.col("c")) - 1.0, F.lit(2.0)) / d)
    return out.withColumns({"p_value": binomial_two_sided(F.col("b"), F.col("c")), "chi2": chi})


def holm(tests: DataFrame, p: str = "p_value", order: tuple[str, ...] = ()) -> DataFrame:
    """Holm-adjusted p-values: (m - i) p in ascending order, capped at 1, with a running maximum; tests are few."""
    w = W.orderBy(p, *order)
    m = F.count("*").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    out = tests.withColumn("_step", step).withColumn("p_holm", F.max("_step").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_step")
    return out.withColumn("significant", F.col("p_holm") < 0.05)


def spread(scores: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """Mean, sample deviation (null for one row), least, largest and range in points."""
    return scores.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("largest")).withColumn("range_points", 100 * (F.col("largest") - F.col("least")))


def seed_ranks(scores: DataFrame, name: str = "model", value: str = "macro_f1") -> DataFrame:
    """Rank of every model within its seed and by mean over seeds, with the gap in points to the next mean."""
    within = F.row_number().over(W.partitionBy("seed").orderBy(F.desc(value), name))
    means = scores.groupBy(name).agg(F.avg(value).alias("mean"))
    w = W.orderBy(F.desc("mean"), name)  # a row per model
    means = means.withColumns({"overall": F.row_number().over(w), "gap_points": 100 * (F.col("mean") - F.lead("mean").over(w))})
    return scores.withColumn("rank", within).join(means, name).select(name, "seed", value, "rank", "overall", "gap_points")


def inflation(scores: DataFrame, value: str = "macro_f1") -> DataFrame:
    """How much better the naive split looks, per model and seed that both splits have, in points."""
    side = lambda s: scores.where(F.col("split") == s).select("model", "seed", F.col(value).alias(s))
    return side("primary").join(side("naive"), ["model", "seed"]).withColumn("inflation_points", 100 * (F.col("naive") - F.col("primary")))


def parity(a: DataFrame, b: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Agreement of two variants on the same rows, deviations of their probabilities and whether the worst is tolerable."""
    rows = a.select("test_index", F.col("probs").alias("p"), F.col("y_pred").alias("u")).join(b.select("test_index", F.col("probs").alias("q"), F.col("y_pred").alias("v")), "test_index")
    rows = rows.select("u", "v", F.explode(F.zip_with("p", "q", lambda x, y: F.abs(x - y))).alias("d"), F.size("p").alias("k"))
    return rows.agg(
        F.sum(F.when(F.col("u") == F.col("v"), 1.0 / F.col("k")).otherwise(0.0)).alias("agree"), F.sum(1.0 / F.col("k")).alias("n"), F.max("d").alias("max_deviation"), F.avg("d").alias("mean_deviation"), F.percentile("d", F.lit(0.99)).alias("p99_deviation")
    ).select(F.round("n").cast("long").alias("n"), safe_ratio(F.col("agree"), F.col("n"), None).alias("agreement"), "max_deviation", "mean_deviation", "p99_deviation", (F.col("max_deviation") <= tolerance).alias("within"))


def transitions(a: DataFrame, b: DataFrame) -> DataFrame:
    rows = a.select("test_index", F.col("y_pred").alias("from_class")).join(b.select("test_index", F.col("y_pred").alias("to_class")), "test_index")
    return rows.where("from_class != to_class").groupBy("from_class", "to_class").agg(F.count("*").alias("n"))


def degradation(base: DataFrame, variant: DataFrame, f1_points: float = 1.5, recall_points: float = 5.0) -> DataFrame:
    """Macro-F1 drop, the class of the worst recall drop, and whether either is material; from per-class tables."""
    rows = base.select("cls", F.col("f1").alias("f1_a"), F.col("recall").alias("r_a")).join(variant.select("cls", F.col("f1").alias("f1_b"), F.col("recall").alias("r_b")), "cls")
    drop = 100 * (F.col("r_a") - F.col("r_b"))
    out = rows.agg((100 * (F.avg("f1_a") - F.avg("f1_b"))).alias("f1_drop"), F.max(F.struct(drop.alias("drop"), (-F.col("cls")).alias("c"))).alias("worst"))
    return out.select("f1_drop", (-F.col("worst.c")).alias("worst_class"), F.col("worst.drop").alias("recall_drop"), ((F.col("f1_drop") > f1_points) | (F.col("worst.drop") > recall_points)).alias("material"))


def severity_deltas(conditions: DataFrame, base: str = "clean", values: tuple[str, ...] = ("accuracy", "macro_f1", "confidence")) -> DataFrame:
    """Every condition's loss against the clean one, in points."""
    clean = conditions.where(F.col("condition") == base).select(*[F.col(v).alias(f"_{v}") for v in values])
    return conditions.where(F.col("condition") != base).crossJoin(F.broadcast(clean)).select("condition", "severity", *[(100 * (F.col(f"_{v}") - F.col(v))).alias(f"{v}_drop") for v in values])


def tracking(conditions: DataFrame) -> DataFrame:
    """Correlation of accuracy and mean confidence over conditions; null for fewer than three or without spread."""
    r = F.when((F.count("*") > 2) & (F.stddev_pop("accuracy") > 0) & (F.stddev_pop("confidence") > 0), F.corr("accuracy", "confidence"))
    return conditions.agg(F.count("*").alias("n"), r.alias("r"))
