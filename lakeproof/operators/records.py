"""Manifests, provenance, class statistics and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeproof.operators.dedup import numbered


def manifest(files: DataFrame, path: str, content: str) -> DataFrame:
    """Path parts (first step = class, name, lower-case extension), size, SHA-256, aspect and sharpness-style banding of a content column."""
    p = F.col(path)
    name = F.element_at(F.split(p, "/"), -1)
    body = F.coalesce(F.col(content), F.lit(""))
    size = F.octet_length(body).cast("long")
    return files.select(
        p.alias("relative_path"),
        F.when(F.instr(p, "/") > 0, F.element_at(F.split(p, "/"), 1)).otherwise("").alias("class_folder"),
        name.alias("filename"),
        F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1)).alias("extension"),
        F.sha2(body.cast("binary"), 256).alias("sha256"),
        size.alias("size_bytes"),
        F.when(size < 1000, "small").when(size < 3000, "medium").otherwise("large").alias("band"),
        F.when(size > 0, "ok").otherwise("verify_failed:empty").alias("status"),
    )


def exact_clusters(rows: DataFrame, digest: str, label: str, member: str) -> DataFrame:
    """Members of digests that occur more than once, numbered in digest order, with their labels."""
    sizes = rows.where(F.col(digest).isNotNull() & (F.col(digest) != "")).groupBy(digest).agg(F.count("*").alias("group_size"), F.array_join(F.array_sort(F.collect_set(label)), "|").alias("labels"), F.count_distinct(label).alias("n_labels")).where("group_size > 1")
    sizes = numbered(sizes, [F.col(digest)], "cluster")
    out = rows.select(digest, F.col(member), F.col(label)).join(sizes, digest)
    return out.select(F.format_string("EX%04d", "cluster").alias("cluster_id"), digest, member, label, "group_size", "labels", (F.col("n_labels") > 1).alias("cross_label"))


def class_distribution(rows: DataFrame, label: str) -> DataFrame:
    """Count, share in percent and imbalance (largest over smallest class) per class."""
    every = W.partitionBy()  # a row per class
    out = rows.groupBy(label).agg(F.count("*").alias("n"))
    return out.withColumns({"percent": F.round(100.0 * F.col("n") / F.sum("n").over(every), 3), "imbalance": F.round(F.max("n").over(every) / F.min("n").over(every), 3)})


def class_medians(rows: DataFrame, label: str, value: str, key: str) -> DataFrame:
    """Exact median, distinct values and the most common value (the first seen by ``key`` among equals) with its share."""
    counts = rows.groupBy(label, value).agg(F.count("*").alias("k"), F.min(key).alias("first"))
    mode = counts.groupBy(label).agg(F.max_by(F.struct(value, "k"), F.struct("k", -F.col("first"))).alias("m"), F.count("*").alias("n_values"))
    out = rows.groupBy(label).agg(F.count("*").alias("n"), F.median(value).alias("median")).join(mode, label)
    return out.select(label, "n", "median", "n_values", F.col(f"m.{value}").alias("mode"), F.round(F.col("m.k") / F.col("n"), 3).alias("mode_share"))


def version_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Every key of either version: only_old, only_new, changed or identical."""
    a, b = old.select(key, F.col(digest).alias("old_digest")), new.select(key, F.col(digest).alias("new_digest"))
    status = F.when(F.col("new_digest").isNull(), "only_old").when(F.col("old_digest").isNull(), "only_new").when(F.col("old_digest") != F.col("new_digest"), "changed").otherwise("identical")
    return a.join(b, key, "full_outer").select(key, status.alias("status"), "old_digest", "new_digest")


def one_sided(old: DataFrame, new: DataFrame, digest: str) -> DataFrame:
    """Digests of one version only, whatever they are called there."""
    a, b = old.select(digest).distinct(), new.select(digest).distinct()
    return a.join(b, digest, "left_anti").withColumn("side", F.lit("old")).unionByName(b.join(a, digest, "left_anti").withColumn("side", F.lit("new")))


def provenance(local: DataFrame, official: DataFrame, key: str, digest: str) -> DataFrame:
    """Local rows by how the official list knows them, and official rows that are missing."""
    off = official.select(key, F.col(digest).alias("_d"))
    hashes = official.select(F.col(digest).alias("_h")).distinct()
    rows = local.join(off, key, "left").join(hashes, F.col(digest) == F.col("_h"), "left")
    status = F.when(F.col("_d") == F.col(digest), "match").when(F.col("_d").isNotNull(), "hash_differs").when(F.col("_h").isNotNull(), "moved").otherwise("unlisted")
    return rows.select(key, status.alias("status")).unionByName(official.join(local, key, "left_anti").select(key, F.lit("missing").alias("status")))


def missing_numbers(rows: DataFrame, number: str, by: str) -> DataFrame:
    """Gaps in each group's numbers as ranges ``first_missing`` to ``last_missing``."""
    own = rows.where(F.col(number).isNotNull()).select(by, number).distinct()
    follow = own.withColumn("next", F.lead(number).over(W.partitionBy(by).orderBy(number)))
    return follow.where(F.col("next") > F.col(number) + 1).select(by, (F.col(number) + 1).alias("first_missing"), (F.col("next") - 1).alias("last_missing"), (F.col("next") - F.col(number) - 1).alias("n_missing"))


def adjacency(pairs: DataFrame, a: str, b: str, near: int = 5) -> DataFrame:
    """How often paired rows have neighbouring numbers."""
    gap = F.abs(F.col(a) - F.col(b))
    return pairs.agg(F.count("*").alias("n_pairs"), F.count_if(gap == 1).alias("adjacent"), F.count_if(gap <= near).alias("within"), F.min(gap).alias("least_gap"))


def top_counts(rows: DataFrame, value: str, k: int, key: str) -> DataFrame:
    """The ``k`` most common values, the first seen among equals first."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(k).select(value, "n")


def cross_counts(rows: DataFrame, row: str, column: Column, values: list) -> DataFrame:
    """A count of every value of ``column`` per ``row``, zero where there is none."""
    return rows.groupBy(row).agg(*[F.count_if(column == v).alias(f"n_{v}") for v in values])


def exemplars(rows: DataFrame, by: str, order: Column, key: str) -> DataFrame:
    """One row per class: the least by ``order``."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(order, key))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def folder_paths(folders: DataFrame, key: str, parent: str, name: str, depth: int = 50) -> DataFrame:
    """Joined names from the root to every folder; a folder in a cycle or under an unknown parent starts its own path.

    Folders deeper than ``depth`` steps are an error."""
    todo = folders.select(F.col(key).alias("id"), F.col(parent).alias("up"), F.col(name).cast("string").alias("path"), F.array(F.col(key)).alias("seen"))
    above = folders.select(F.col(key).alias("up"), F.col(parent).alias("_next"), F.col(name).cast("string").alias("_name"))
    for _ in range(depth):
        joined = todo.join(above, "up", "left")
        step = F.col("_name").isNotNull() & ~F.array_contains("seen", F.col("up"))
        todo = joined.select("id", F.when(step, F.col("_next")).alias("up"), F.when(step, F.concat_ws("/", "_name", "path")).otherwise(F.col("path")).alias("path"), F.when(step, F.array_append("seen", F.col("up"))).otherwise(F.col("seen")).alias("seen"))
        todo = todo.checkpoint() if todo.sparkSession.sparkContext.getCheckpointDir() else todo
        if not todo.where("up is not null").head(1):
            break
    else:
        raise ValueError(f"folders are nested deeper than {depth} steps, the depth given")
    return todo.select("id", "path")


def latency(rows: DataFrame, model: str, repeat: str, value: str) -> DataFrame:
    """Percentiles per model and repeat, and pooled over repeats (null repeat), in one pass of grouping sets."""
    rows = rows.select(F.col(model).alias("model"), F.col(repeat).alias("repeat"), F.col(value).cast("double").alias("v"))
    out = rows.groupingSets([["model", "repeat"], ["model"]], "model", "repeat")
    q = F.percentile("v", F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)]))
    out = out.agg(F.count("*").alias("n"), q.alias("q"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.min("v").alias("least"), F.max("v").alias("largest"))
    return out.select("model", "repeat", "n", *[F.col("q")[i].alias(a) for i, a in enumerate(("median", "p90", "p95", "p99"))], "mean", "sd", "least", "largest")
