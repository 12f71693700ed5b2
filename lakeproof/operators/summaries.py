"""Summaries of metrics, subsets, policies, pairs, groups, splits and listings.

All are aggregates of a few rows a key; nothing is gathered per group but what a report lists by its nature, and that
is a bounded number of rows (conditions, classes) or cut to the first ``k`` where the report is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeproof.functions.scalars import text_number
from lakeproof.operators import metrics


def keyed_calibration(rows: DataFrame, by: tuple[str, ...], bins: int = 15) -> DataFrame:
    """ECE, MCE, NLL and Brier score per key."""
    at = F.greatest(F.ceil(F.col("conf") * bins), F.lit(1)).cast("int")
    table = rows.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("conf") - F.avg("correct")).alias("gap"))
    first = table.groupBy(*by).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))
    own = F.get("probs", F.col("y_true"))
    brier = F.aggregate(F.transform("probs", lambda p, i: F.pow(p - F.when(i == F.col("y_true"), 1.0).otherwise(0.0), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    return first.join(rows.groupBy(*by).agg(F.avg(-F.ln(F.greatest(F.least(own, F.lit(1.0)), F.lit(1e-12)))).alias("nll"), F.avg(brier).alias("brier")), list(by))


def metric_summary(rows: DataFrame, by: str, run: str) -> DataFrame:
    """Mean, deviation and range over runs of ten metrics and of every class's F1, one row per ``by`` and metric."""
    keys = (by, run)
    cm = metrics.confusion(rows, keys)
    wide = metrics.headline(cm, keys).join(keyed_calibration(rows, keys), list(keys))
    names = ["accuracy", "mcc", "macro_precision", "macro_recall", "macro_f1", "balanced_accuracy", "ece", "mce", "nll", "brier"]
    long = wide.unpivot([*keys], names, "metric", "value")
    per = metrics.per_class(cm, keys).where("support > 0").select(*keys, F.concat(F.lit("f1_"), F.col("cls").cast("string")).alias("metric"), F.col("f1").alias("value"))
    return long.unionByName(per).groupBy(by, "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("least"), F.max("value").alias("largest"))


def subset_summaries(rows: DataFrame, subsets: dict[str, Column], values: list[str], flags: list[str] = ()) -> DataFrame:
    """Mean, median and quartiles of each value, and the share of each flag, over named subsets that may overlap."""
    marked = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in subsets.items()])
    rows = rows.withColumn("subset", F.explode(F.filter(marked, lambda x: x.isNotNull())))
    long = rows.unpivot(["subset"], [*values], "key", "value") if not flags else rows.select("subset", *[F.col(v).cast("double").alias(v) for v in values], *[F.col(f).cast("double").alias(f) for f in flags]).unpivot(["subset"], [*values, *flags], "key", "value")
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return long.groupBy("subset", "key").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), q.alias("q")).select("subset", "key", "n", "mean", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))


def policy_rollup(conditions: DataFrame, name: Column, risk: float, coverage: float) -> DataFrame:
    """How many conditions break the risk or the coverage bound, and which: a row per bound. Conditions are few."""
    rules = {"risk": F.col("risk") > risk, "coverage": F.col("coverage") < coverage}
    parts = [conditions.agg(F.count("*").alias("n"), F.count_if(cond).alias("violations"), F.array_join(F.array_sort(F.collect_list(F.when(cond, name))), ",").alias("names")).withColumn("rule", F.lit(rule)) for rule, cond in rules.items()]
    return reduce(DataFrame.unionByName, parts)


def counterfactual(before: DataFrame, after: DataFrame, usable: Column, threshold: float) -> DataFrame:
    """Over the usable rows: how many keep their prediction, and accuracy, confidence and coverage on either side."""
    side = lambda df, s: df.select("test_index", *[F.col(c).alias(f"{c}_{s}") for c in ("y_pred", "correct", "conf")])
    rows = side(before, "a").join(side(after, "b"), "test_index").where(usable)
    ends = [x for s in "ab" for x in (F.avg(f"correct_{s}").alias(f"accuracy_{s}"), F.avg(f"conf_{s}").alias(f"confidence_{s}"), F.avg((F.col(f"conf_{s}") >= threshold).cast("int")).alias(f"coverage_{s}"))]
    return rows.agg(F.count("*").alias("n"), F.avg((F.col("y_pred_a") == F.col("y_pred_b")).cast("int")).alias("survival"), *ends)


def pair_extremes(pairs: DataFrame, operative: int) -> DataFrame:
    """Least and largest distance and similarity of confirmed pairs, and how many lie within the operative distance."""
    return pairs.agg(F.count("*").alias("n"), F.min("distance").alias("least_distance"), F.max("distance").alias("largest_distance"), F.min("cosine").alias("least_cosine"), F.max("cosine").alias("largest_cosine"), F.count_if(F.col("distance") <= operative).alias("operative"))


def split_contents(split: DataFrame, rows: DataFrame, key: str, label: str, content: str) -> DataFrame:
    """Rows, bytes and a digest per split and class. The digest adds up numbers of the members: order doesn't matter."""
    held = split.select(key, label, "split").join(rows.select(key, F.octet_length(F.coalesce(content, F.lit(""))).alias("_b")), key)
    return held.groupBy("split", label).agg(F.count("*").alias("n"), F.sum("_b").cast("long").alias("bytes"), F.sum(text_number(F.col(key).cast("string"))).alias("digest"))


def split_report(split: DataFrame, rows: DataFrame, key: str, label: str, group: str) -> DataFrame:
    """Rows, share, classes and distinct groups per split."""
    held = split.select(key, label, "split").join(rows.select(key, group), key)
    out = held.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct(label).alias("classes"), F.count_distinct(group).alias("groups"))
    return out.withColumn("fraction", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 4))  # a row per split


def histograms(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """``field, value, n`` for several optional fields; null is a value like others."""
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), own.cast("string").alias("value")) for name, own in fields.items()])
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def cross_label(clusters: DataFrame) -> DataFrame:
    """One row for every cluster whose members have several labels."""
    return clusters.where("cross_label").groupBy("cluster_id").agg(F.max("group_size").alias("group_size"), F.max("labels").alias("labels"))


def group_sizes(members: DataFrame, group: str) -> DataFrame:
    """``size, groups, share``: how many groups have each size, and the percent of all members in them."""
    sizes = members.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))
    inside = F.col("size") * F.col("groups")
    return sizes.withColumn("share", F.round(100.0 * inside / F.sum(inside).over(W.partitionBy()), 3))  # a row per size


def expected_adjacency(pairs: DataFrame, rows: DataFrame, key: str, label: str, near: int = 15) -> DataFrame:
    """Adjacent pairs within classes against what random placement would give (pairs times 2 over the class's size), and the first gaps."""
    side = lambda s: rows.select(F.col(key).alias(s), F.col(label).alias(f"l_{s}"))
    own = pairs.join(side("a"), "a").join(side("b"), "b").where("l_a = l_b").select(F.col("l_a").alias(label), F.abs(F.col("a") - F.col("b")).alias("gap"))
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    counts = own.groupBy(label).agg(F.count("*").alias("n"), F.count_if(F.col("gap") == 1).alias("adjacent"))
    total = counts.join(sizes, label).agg(F.sum("n").alias("n_pairs"), F.sum("adjacent").alias("adjacent"), F.sum(2.0 * F.col("n") / F.col("_n")).alias("expected"))
    gaps = own.orderBy("gap").limit(near).agg(F.array_join(F.transform(F.array_sort(F.collect_list("gap")), lambda x: x.cast("string")), ",").alias("gaps"))  # the first ``near``
    return total.withColumn("ratio", F.try_divide(F.col("adjacent").cast("double"), F.col("expected"))).crossJoin(F.broadcast(gaps))  # one row each


def shapes(rows: DataFrame, width: Column, height: Column, names: dict[str, str], name: Column) -> list[Column]:
    """Aspect ratio (null without height), megapixels and the normalised class name ("" where unknown)."""
    known = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), name)
    return [F.round(F.try_divide(width.cast("double"), height.cast("double")), 6).alias("aspect_ratio"), F.round(width.cast("double") * height / 1e6, 4).alias("megapixels"), F.coalesce(known, F.lit("")).alias("normalised")]


def class_of_index(index: Column, order: list[str]) -> Column:
    """The class name at an index; null outside of the list."""
    return F.when(index >= 0, F.get(F.array(*map(F.lit, order)), index))


def listing(folders: DataFrame, body: str) -> DataFrame:
    """Files of JSON listings: ``filename, size, sha256`` with the size from either place and the hash in lower case."""
    kind = "array<struct<filename string, size long, content_details struct<size long, sha256_hash string>>>"
    rows = folders.select(*[c for c in folders.columns if c != body], F.explode(F.from_json(body, kind)).alias("f"))
    return rows.select(*[c for c in rows.columns if c != "f"], "f.filename", F.coalesce("f.size", "f.content_details.size").alias("size"), F.lower("f.content_details.sha256_hash").alias("sha256"))


def digest_check(recorded: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """How many recorded files are there with the digest recorded, with another one, and not at all."""
    rows = recorded.select(key, F.col(digest).alias("_r")).join(actual.select(key, F.col(digest).alias("_a")), key, "left")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("_a") == F.col("_r")).alias("equal"), F.count_if(F.col("_a") != F.col("_r")).alias("differ"), F.count_if(F.col("_a").isNull()).alias("missing"))


def name_rules(rows: DataFrame, path: Column, extension: str, derived: str) -> DataFrame:
    """Names without the extension, and names that hold a token of derived files, counted."""
    return rows.agg(F.count_if(~path.rlike(rf"(?i)\.{extension}$")).alias("wrong_extension"), F.count_if(path.rlike(rf"(?i)(^|[^a-z])({derived})([^a-z]|$)")).alias("derived"))


def class_losses(base: DataFrame, variant: DataFrame) -> DataFrame:
    """Of the class that loses most recall: the drop, the share of its rows that keep their prediction, and where the others go.

    Both sides have ``test_index, y_true, y_pred``; of equal drops the least class is taken."""
    rows = base.select("test_index", "y_true", F.col("y_pred").alias("p")).join(variant.select("test_index", F.col("y_pred").alias("q")), "test_index")
    hit = lambda c: F.avg((F.col(c) == F.col("y_true")).cast("int"))
    per = rows.groupBy("y_true").agg((100 * (hit("p") - hit("q"))).alias("recall_drop"), F.avg((F.col("p") == F.col("q")).cast("int")).alias("retained"))
    worst = per.agg(F.max(F.struct(F.round("recall_drop", 9).alias("recall_drop"), (-F.col("y_true")).alias("c"), "retained")).alias("w")).select((-F.col("w.c")).alias("y_true"), "w.recall_drop", "w.retained")
    moved = rows.where("p != q").groupBy("y_true", F.col("q").alias("destination")).agg(F.count("*").alias("n"))
    return F.broadcast(worst).join(moved, "y_true", "left")  # one row


def macro_auroc(scores: DataFrame) -> DataFrame:
    """The mean over the classes that have an AUROC."""
    return scores.agg(F.count("auroc").alias("classes"), F.avg("auroc").alias("macro_auroc"))


def rule_counts(split: DataFrame, rows: DataFrame, quarantine: DataFrame, key: str, label: str, group: str) -> DataFrame:
    """The split rules and all crossing pairs of groups, counted on any split, sound or not; see :func:`lakeproof.operators.splits.violations`."""
    from lakeproof.operators import splits

    return splits.violations(split, rows, quarantine, key, label, group, group, every_pair=True)


def confidence_changes(rows: DataFrame, by: tuple[str, ...], base: Column, bins: int = 15) -> DataFrame:
    """Change of ECE and of mean confidence against the base condition, to five places."""
    own = keyed_calibration(rows, by, bins).join(rows.groupBy(*by).agg(F.avg("conf").alias("confidence")), list(by))
    clean = own.where(base).select(F.col("ece").alias("_e"), F.col("confidence").alias("_c"))
    out = own.where(~base).crossJoin(F.broadcast(clean))  # one row
    return out.select(*by, F.round(F.col("ece") - F.col("_e"), 5).alias("ece_change"), F.round(F.col("confidence") - F.col("_c"), 5).alias("confidence_change"))
