"""Registered queries of stored arrays, archives, the report of figures from fifteen documents, intervals and refusals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.operators import compare, fieldlog, resampling
from lakeproof.plans import catalog as c
from lakeproof.plans.fixtures import FIELD_SQL, GAINS, field_lines, preds, preds_sql, table
from lakeproof.plans.stored import _folder
from lakeproof.sources import arrays, files

query, rounded = c.query, c._rounded


@query(f"""WITH {preds_sql()} SELECT test_index, any_value(y_true)::INT AS y_true, round(sum(p), 6) AS total, round(max(p), 6) AS top, round(sum(p * c), 6) AS weighted FROM p GROUP BY 1""")
def stored_predictions(spark, sf_dir):
    """Predictions written as compressed arrays and read again, by ranges of rows and chosen members."""
    arrays.register(spark)
    at = _folder(spark)
    rows = preds(spark, sf_dir).select("test_index", F.col("y_true").cast("int").alias("y_true"), "probs")
    rows.write.format("npy").option("rows", 200).mode("append").save(at)
    back = spark.read.format("npy").option("rows", 60).option("columns", "probs,test_index,y_true").load(at)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return rounded(back.select("test_index", "y_true", total(F.col("probs")).alias("total"), F.array_max("probs").alias("top"), total(F.transform("probs", lambda p, i: p * i)).alias("weighted")))


def _archive(spark, sf_dir) -> str:
    """Documents as members ``source/lang/id.txt`` of archives."""
    arrays.register(spark)
    at = _folder(spark)
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("member"), F.col("text").cast("binary").alias("content"))
    rows.repartition(4, "member").write.format("zipped").mode("append").save(at)
    return at


@query("""SELECT source || '/' || lang AS directory, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS size_bytes FROM documents GROUP BY 1""")
def archive_directories(spark, sf_dir):
    rows = spark.read.format("zipped").option("content", False).option("members", 100).load(_archive(spark, sf_dir))
    return rows.groupBy("directory").agg(F.count("*").alias("n"), F.sum("size").alias("size_bytes"))


@query(
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN doc_id % 17 = 0 THEN 'unlisted' WHEN octet_length(encode(text)) = 0 THEN 'empty' WHEN doc_id % 13 = 0 THEN 'hash_differs' ELSE 'ok' END AS status FROM documents
UNION ALL SELECT 'missing' FROM documents WHERE doc_id % 19 = 0) GROUP BY 1"""
)
def archive_verification(spark, sf_dir):
    """Members of archives against a list of digests with planted faults."""
    found = spark.read.format("zipped").load(_archive(spark, sf_dir)).select(F.col("member").alias("relative_path"), "content")
    d = table(spark, sf_dir, "documents")
    path = lambda end: F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(end)))
    listed = d.where("doc_id % 17 != 0").select(path(".txt").alias("relative_path"), F.sha2(F.concat("text", F.when(F.col("doc_id") % 13 == 0, "!").otherwise("")).cast("binary"), 256).alias("sha256"))
    gone = d.where("doc_id % 19 = 0").select(path(".gone").alias("relative_path"), F.lit("0").alias("sha256"))
    return files.verified(found, listed.unionByName(gone)).groupBy("status").agg(F.count("*").alias("n"))


def _counted(name: str):
    """A document of counts by status of another query."""
    return lambda spark, sf_dir: c.QUERIES[name](spark, sf_dir).groupBy("status").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("counts"))


def _whole(name: str):
    """A one-row query as a document."""
    return lambda spark, sf_dir: c.QUERIES[name](spark, sf_dir)


def _duplicates(spark, sf_dir):
    g = c.exact_duplicate_clusters(spark, sf_dir)
    return g.agg(F.count_distinct("cluster_id").alias("groups"), F.count("*").alias("rows"), F.coalesce(F.max("group_size"), F.lit(0)).alias("largest"), F.struct(F.lit(64).alias("screen"), F.lit(32).alias("operative")).alias("thresholds"))


def _classes(spark, sf_dir):
    return c.class_distribution(spark, sf_dir).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "n")))).alias("class_counts"), F.struct(F.max("imbalance").alias("max_over_min")).alias("imbalance"))


def _split(spark, sf_dir):
    s = c.naive_split(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))
    return s.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", F.struct("n").alias("v"))))).alias("parts"), F.lit(42).alias("seed"))


def _runs(spark, sf_dir):
    return spark.createDataFrame([(sorted(GAINS),)], "models array<string>").crossJoin(F.broadcast(table(spark, sf_dir, "embeddings").agg(F.count("*").alias("test_rows"))))  # one row


#: Documents by source, None where the source is missing. Each gives one row.
_DOCUMENTS = {
    "benchmark": _runs,
    "duplicates": _duplicates,
    "sequence_adjacency": None,
    "version_diff": _counted("version_diff"),
    "provenance": _counted("provenance_check"),
    "bias": _classes,
    "split": _split,
    "calibration": _whole("calibration_summary"),
    "robustness": _whole("confidence_tracks_accuracy"),
    "export": None,
    "parity": _whole("parity_summary"),
    "attention": None,
    "device_benchmark": _whole("material_degradation"),
    "device_parity": _whole("abstention_policy"),
    "device_inventory": None,
}

_SQL = lambda name: f"({c.ORACLE[name]})"
#: ``source, path, section, name`` of the figures, each with its SQL (JSON text, or NULL).
_PLACES = [
    ("benchmark", "$.models", "benchmark", "models", "'" + "[" + ",".join(f'"{m}"' for m in sorted(GAINS)) + "]" + "'"),
    ("benchmark", "$.test_rows", "benchmark", "test_rows", "(SELECT count(*)::VARCHAR FROM embeddings)"),
    ("benchmark", "$.multiseed.seeds", "benchmark", "seeds", "NULL"),
    ("duplicates", "$.groups", "dataset", "exact_duplicate_groups", f"(SELECT count(DISTINCT cluster_id)::VARCHAR FROM {_SQL('exact_duplicate_clusters')})"),
    ("duplicates", "$.largest", "dataset", "largest_group_size", f"(SELECT coalesce(max(group_size), 0)::VARCHAR FROM {_SQL('exact_duplicate_clusters')})"),
    ("duplicates", "$.thresholds.operative", "dataset", "operative_threshold", "'32'"),
    ("duplicates", "$.thresholds", "dataset", "thresholds", """'{"operative":32,"screen":64}'"""),
    ("sequence_adjacency", "$.operative.pairs", "dataset", "adjacent_pairs_total", "NULL"),
    ("version_diff", "$.counts.only_new", "dataset", "only_in_new", f"(SELECT nullif(count(*), 0)::VARCHAR FROM {_SQL('version_diff')} WHERE status = 'only_new')"),
    ("version_diff", "$.counts.changed", "dataset", "content_changed", f"(SELECT nullif(count(*), 0)::VARCHAR FROM {_SQL('version_diff')} WHERE status = 'changed')"),
    ("provenance", "$.counts.match", "dataset", "matched", f"(SELECT nullif(count(*), 0)::VARCHAR FROM {_SQL('provenance_check')} WHERE status = 'match')"),
    ("provenance", "$.counts.missing", "dataset", "absent", f"(SELECT nullif(count(*), 0)::VARCHAR FROM {_SQL('provenance_check')} WHERE status = 'missing')"),
    ("bias", "$.class_counts.en", "dataset", "english", "(SELECT nullif(count(*), 0)::VARCHAR FROM documents WHERE lang = 'en')"),
    ("bias", "$.exif.distinct_models", "dataset", "capture_devices", "NULL"),
    ("split", "$.parts.train.n", "split", "train", f"(SELECT count(*)::VARCHAR FROM {_SQL('naive_split')} WHERE split = 'train')"),
    ("split", "$.parts.test.n", "split", "test", f"(SELECT count(*)::VARCHAR FROM {_SQL('naive_split')} WHERE split = 'test')"),
    ("split", "$.seed", "split", "seed", "'42'"),
    ("calibration", "$.ece", "calibration", "ece", f"(SELECT ece::VARCHAR FROM {_SQL('calibration_summary')})"),
    ("calibration", "$.nll", "calibration", "nll", f"(SELECT nll::VARCHAR FROM {_SQL('calibration_summary')})"),
    ("robustness", "$.n", "robustness", "conditions", f"(SELECT n::VARCHAR FROM {_SQL('confidence_tracks_accuracy')})"),
    ("robustness", "$.r", "robustness", "correlation", f"(SELECT r::VARCHAR FROM {_SQL('confidence_tracks_accuracy')})"),
    ("export", "$.sizes", "export", "sizes", "NULL"),
    ("parity", "$.agreement", "export", "agreement", f"(SELECT agreement::VARCHAR FROM {_SQL('parity_summary')})"),
    ("parity", "$.within", "export", "within", f"(SELECT within::VARCHAR FROM {_SQL('parity_summary')})"),
    ("attention", "$.mass", "attention", "mass_on_object", "NULL"),
    ("device_benchmark", "$.material", "device", "material", f"(SELECT material::VARCHAR FROM {_SQL('material_degradation')})"),
    ("device_parity", "$.mode", "device", "policy", f"""(SELECT '"' || mode || '"' FROM {_SQL('abstention_policy')})"""),
    ("device_inventory", "$.devices", "device", "devices", "NULL"),
]


@query("\nUNION ALL ".join(f"SELECT '{section}' AS section, '{name}' AS name, {value} AS value, '{source}' AS source, '{path}' AS path, {value} IS NOT NULL AS found" for source, path, section, name, value in _PLACES))
def frozen_figures(spark, sf_dir):
    """Figures of nine sections picked from fifteen documents, four of them missing, each with where it comes from."""
    each = [f(spark, sf_dir).select(F.lit(name).alias("source"), F.to_json(F.struct("*")).alias("body")) for name, f in _DOCUMENTS.items() if f]
    return files.frozen(reduce(DataFrame.unionByName, each), [p[:4] for p in _PLACES])


@query()
def bootstrap_metrics(spark, sf_dir):
    """Intervals of accuracy, balanced accuracy and macro-F1 over 2,000 draws; the draws are numpy's, so no SQL can repeat them."""
    return rounded(resampling.bootstrap_intervals(c._top(spark, sf_dir)))


@query()
def paired_bootstrap_metrics(spark, sf_dir):
    """Differences of two models on the same draws, in points, and whether they may be none."""
    a, b = c._top(spark, sf_dir, 1.8), c._top(spark, sf_dir, 1.6)
    compare.require_aligned(a, b)
    rows = a.select("test_index", "y_true", F.col("y_pred").alias("a")).join(b.select("test_index", F.col("y_pred").alias("b")), "test_index")
    return rounded(resampling.paired_intervals(rows, "a", "b"))


@query("""SELECT count(*) FILTER (vec_id % 31 = 0 AND vec_id % 37 <> 0) AS only_a, count(*) FILTER (vec_id % 37 = 0 AND vec_id % 31 <> 0) AS only_b, count(*) FILTER (vec_id % 31 <> 0 AND vec_id % 37 <> 0 AND vec_id % 41 = 0) AS unlike_labels, count(*) FILTER (vec_id % 43 = 0 AND vec_id % 37 <> 0) AS repeated FROM embeddings""")
def alignment_faults(spark, sf_dir):
    """Two sets of predictions with planted gaps, wrong labels and repeats."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("test_index"), F.col("label").alias("y_true"))
    a = rows.where("test_index % 37 != 0")
    b = rows.where("test_index % 31 != 0").withColumn("y_true", F.when(F.col("test_index") % 41 == 0, F.col("y_true") + 1).otherwise(F.col("y_true")))
    return compare.alignment(a.unionByName(a.where("test_index % 43 = 0")), b)


def _field(spark, sf_dir):
    return fieldlog.parse(field_lines(spark, sf_dir)).where("reason is null")


@query(
    f"""WITH {FIELD_SQL}, m AS (SELECT unnest([{{'k': 'confidence', 'v': confidence}}, {{'k': 'entropy', 'v': entropy}}, {{'k': 'inference', 'v': inference}}, {{'k': 'end_to_end', 'v': value}}]) AS x FROM fc), l AS (SELECT x.k AS measure, list_sort(list(x.v)) AS v FROM m WHERE x.v IS NOT NULL GROUP BY 1)
SELECT measure, len(v) AS n, round(list_median(v), 6) AS median, round(list_avg(v), 6) AS mean, round(v[least(len(v) - 1, floor(0.9::DOUBLE * len(v)))::INT + 1], 6) AS p90, round(v[least(len(v) - 1, floor(0.95::DOUBLE * len(v)))::INT + 1], 6) AS p95, round(v[1], 6) AS least, round(v[-1], 6) AS largest, round(list_stddev_pop(v), 6) AS sd FROM l"""
)
def field_measures(spark, sf_dir):
    return rounded(fieldlog.field_measures(_field(spark, sf_dir)))


@query(
    f"""WITH {FIELD_SQL}, t AS (SELECT *, verdict IN ('correct', 'incorrect', 'unsure') AS annotated FROM fc), x AS (SELECT 'label_free' AS tier, unnest([{{'f': 'delegate', 'v': delegate}}, {{'f': 'variant', 'v': variant}}, {{'f': 'thermal_status', 'v': NULL}}, {{'f': 'background', 'v': background}}, {{'f': 'attached', 'v': NULL}}]) AS x FROM t
UNION ALL SELECT 'annotated', unnest([{{'f': 'verdict', 'v': verdict}}, {{'f': 'expertise', 'v': expertise}}]) FROM t WHERE annotated UNION ALL SELECT 'incorrect', {{'f': 'claimed_true_class', 'v': claimed}} FROM t WHERE verdict = 'incorrect' UNION ALL SELECT 'expert', {{'f': 'role', 'v': role}} FROM t WHERE verified)
SELECT tier, x.f AS field, x.v AS value, count(*) AS n FROM x GROUP BY 1, 2, 3"""
)
def field_counts(spark, sf_dir):
    return fieldlog.field_counts(_field(spark, sf_dir))


@query(
    f"""WITH {FIELD_SQL} SELECT (SELECT count(*) FROM fa) AS records, count(*) AS consented, (SELECT count(*) FROM fa) - count(*) AS excluded, round(avg(abstained::INT), 6) AS abstention_rate, count(*) FILTER (verdict IN ('correct', 'incorrect', 'unsure')) AS annotated,
round(count(*) FILTER (verdict = 'correct') / nullif(count(*) FILTER (verdict IN ('correct', 'incorrect')), 0)::DOUBLE, 6) AS agreement, count(*) FILTER (verified) AS expert_verified, round(count(*) FILTER (verified AND top BETWEEN 0 AND 9 AND 'c' || top = expert_class) / nullif(count(*) FILTER (verified), 0)::DOUBLE, 6) AS expert_accuracy FROM fc"""
)
def field_rates(spark, sf_dir):
    return rounded(fieldlog.field_rates(_field(spark, sf_dir)))
