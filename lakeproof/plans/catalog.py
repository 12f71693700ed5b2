"""Registered queries of the library's own operators, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.functions import scalars as fn
from lakeproof.operators import compare, dedup, fieldlog, images, metrics, policy, records, selection, splits
from lakeproof.plans.fixtures import CLASSES, GAINS, RELEASES_SQL, SEEDS, journal_images, journal_lines, many_preds, preds, preds_sql, releases, table
from lakeproof.sources import files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def _documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.withColumn("path", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".TXT"))).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))


@query(
    """SELECT 'EX' || lpad(CAST(c AS VARCHAR), 4, '0') AS cluster_id, sha, doc_id, source, n AS group_size, labels, k > 1 AS cross_label
FROM (SELECT sha, n, labels, k, row_number() OVER (ORDER BY sha) AS c FROM (SELECT sha256(text) AS sha, count(*) AS n, string_agg(DISTINCT source, '|' ORDER BY source) AS labels, count(DISTINCT source) AS k FROM documents GROUP BY 1 HAVING count(*) > 1))
JOIN (SELECT sha256(text) AS sha, doc_id, source FROM documents) USING (sha)"""
)
def exact_duplicate_clusters(spark, sf_dir):
    return records.exact_clusters(_documents(spark, sf_dir), "sha", "source", "doc_id")


@query(
    """SELECT source || '/' || doc_id || '.TXT' AS relative_path, source AS class_folder, doc_id || '.TXT' AS filename, '.txt' AS extension, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size_bytes,
CASE WHEN octet_length(encode(text)) < 1000 THEN 'small' WHEN octet_length(encode(text)) < 3000 THEN 'medium' ELSE 'large' END AS band, CASE WHEN octet_length(encode(text)) > 0 THEN 'ok' ELSE 'verify_failed:empty' END AS status FROM documents"""
)
def document_manifest(spark, sf_dir):
    return records.manifest(_documents(spark, sf_dir), "path", "text")


@query("""SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 3)::DOUBLE AS percent, round(max(count(*)) OVER () / min(count(*)) OVER (), 3)::DOUBLE AS imbalance FROM documents GROUP BY lang""")
def class_distribution(spark, sf_dir):
    return records.class_distribution(table(spark, sf_dir, "documents"), "lang")


@query(
    """WITH c AS (SELECT lang, n_chars, count(*) AS k, min(doc_id) AS first FROM documents GROUP BY 1, 2),
m AS (SELECT lang, count(*) OVER (PARTITION BY lang) AS n_values, n_chars AS mode, k, row_number() OVER (PARTITION BY lang ORDER BY k DESC, first) AS r FROM c)
SELECT d.lang, d.n, d.median, m.n_values, m.mode, round(m.k / d.n, 3)::DOUBLE AS mode_share FROM (SELECT lang, count(*) AS n, median(n_chars::DOUBLE) AS median FROM documents GROUP BY 1) d JOIN m ON m.lang = d.lang AND m.r = 1"""
)
def class_quality_medians(spark, sf_dir):
    return records.class_medians(table(spark, sf_dir, "documents"), "lang", "n_chars", "doc_id")


@query("""SELECT event_type, count(*) FILTER (user_id % 4 = 0) AS n_0, count(*) FILTER (user_id % 4 = 1) AS n_1, count(*) FILTER (user_id % 4 = 2) AS n_2, count(*) FILTER (user_id % 4 = 3) AS n_3 FROM events GROUP BY 1""")
def device_by_class(spark, sf_dir):
    return records.cross_counts(table(spark, sf_dir, "events"), "event_type", F.col("user_id") % 4, [0, 1, 2, 3])


@query("""SELECT n_chars, n FROM (SELECT n_chars, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 6)""")
def top_sizes(spark, sf_dir):
    return records.top_counts(table(spark, sf_dir, "documents"), "n_chars", 6, "doc_id")


@query(
    """WITH o AS (SELECT DISTINCT source, doc_id AS x FROM documents), g AS (SELECT source, x, lead(x) OVER (PARTITION BY source ORDER BY x) AS y FROM o)
SELECT source, x + 1 AS first_missing, y - 1 AS last_missing, y - x - 1 AS n_missing FROM g WHERE y > x + 1"""
)
def missing_sequence_numbers(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("source", fn.trailing_number(F.col("path")).alias("number"))
    return records.missing_numbers(rows, "number", "source")


@query(f"""WITH {RELEASES_SQL} SELECT path, CASE WHEN new.sha IS NULL THEN 'only_old' WHEN old.sha IS NULL THEN 'only_new' WHEN old.sha <> new.sha THEN 'changed' ELSE 'identical' END AS status, old.sha AS old_digest, new.sha AS new_digest FROM old FULL JOIN new USING (path)""")
def version_diff(spark, sf_dir):
    return records.version_diff(*releases(spark, sf_dir), "path", "sha")


@query(f"""WITH {RELEASES_SQL} SELECT DISTINCT sha, 'old' AS side FROM old WHERE sha NOT IN (SELECT sha FROM new) UNION ALL SELECT DISTINCT sha, 'new' FROM new WHERE sha NOT IN (SELECT sha FROM old)""")
def version_hash_diff(spark, sf_dir):
    return records.one_sided(*releases(spark, sf_dir), "sha")


@query(
    f"""WITH {RELEASES_SQL} SELECT n.path, CASE WHEN o.sha = n.sha THEN 'match' WHEN o.sha IS NOT NULL THEN 'hash_differs' WHEN n.sha IN (SELECT sha FROM old) THEN 'moved' ELSE 'unlisted' END AS status FROM new n LEFT JOIN old o USING (path)
UNION ALL SELECT path, 'missing' FROM old WHERE path NOT IN (SELECT path FROM new)"""
)
def provenance_check(spark, sf_dir):
    official, local = releases(spark, sf_dir)
    return records.provenance(local, official, "path", "sha")


_HAMMING = """h AS (SELECT a.vec_id AS a, b.vec_id AS b, len(list_filter(range(1, 65), lambda i: (a.embedding[i] >= 0) <> (b.embedding[i] >= 0)))::INT AS distance, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"""


def _pairs(spark, sf_dir, threshold=20):
    return dedup.hamming_pairs(dedup.sign_hash(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), threshold)


@query(f"""WITH {_HAMMING} SELECT a, b, distance FROM h WHERE distance <= 20""")
def hamming_candidates(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f"""WITH {_HAMMING} SELECT a, b, distance, round(cosine, 6) AS cosine, cosine >= 0.6 AS passes, cosine >= 0.6 AND distance <= 18 AS duplicate FROM h WHERE distance <= 20""")
def confirmed_pairs(spark, sf_dir):
    return _rounded(dedup.confirmed(_pairs(spark, sf_dir), table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.6, 18))


@query(f"""WITH {_HAMMING} SELECT count(*) AS n_pairs, count(*) FILTER (b - a = 1) AS adjacent, count(*) FILTER (b - a <= 5) AS within, min(b - a) AS least_gap FROM h WHERE distance <= 20""")
def sequence_adjacency(spark, sf_dir):
    return records.adjacency(_pairs(spark, sf_dir), "a", "b")


_REACH = f"""WITH RECURSIVE {_HAMMING}, e AS (SELECT a, b FROM h WHERE distance <= 18 UNION SELECT b, a FROM h WHERE distance <= 18),
r AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a)"""


@query(f"""{_REACH} SELECT id, min(other) AS component FROM r GROUP BY id""")
def duplicate_components(spark, sf_dir):
    every = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return dedup.components(every, _pairs(spark, sf_dir, 18))


@query(
    f"""WITH RECURSIVE {_HAMMING}, t AS (SELECT unnest([14, 16, 18]) AS threshold), e AS (SELECT threshold, a, b FROM h, t WHERE distance <= threshold UNION SELECT threshold, b, a FROM h, t WHERE distance <= threshold),
r AS (SELECT threshold, vec_id AS id, vec_id AS other FROM embeddings, t UNION SELECT r.threshold, r.id, e.b FROM r JOIN e ON r.other = e.a AND r.threshold = e.threshold),
c AS (SELECT threshold, id, min(other) AS c FROM r GROUP BY 1, 2), g AS (SELECT threshold, c, count(*) AS size FROM c GROUP BY 1, 2)
SELECT threshold::INT AS threshold, (SELECT count(*) FROM h WHERE distance <= g.threshold) AS links, count(*) AS groups, count(*) FILTER (size > 1) AS multi, sum(CASE WHEN size > 1 THEN size ELSE 0 END)::BIGINT AS in_multi, max(size) AS largest FROM g GROUP BY g.threshold"""
)
def threshold_sensitivity(spark, sf_dir):
    every = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return dedup.sweep(every, _pairs(spark, sf_dir, 18), [14, 16, 18])


_NAIVE = """s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY ('0x' || substr(md5(doc_id || ':42'), 1, 8))::BIGINT, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents),
naive AS (SELECT doc_id, lang, CASE WHEN r <= round_even(n * 0.70::DOUBLE, 0) THEN 'train' WHEN r <= round_even(n * 0.70::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'validation' ELSE 'test' END AS split FROM s)"""


@query(f"""WITH {_NAIVE} SELECT doc_id, lang, split FROM naive""")
def naive_split(spark, sf_dir):
    return splits.naive_split(table(spark, sf_dir, "documents"), "doc_id", "lang")


@query(f"""WITH {_NAIVE} SELECT split, lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 4)::DOUBLE AS fraction FROM naive GROUP BY 1, 2""")
def split_distribution(spark, sf_dir):
    return splits.distribution(naive_split(spark, sf_dir), "lang")


@query("""SELECT doc_id, lang, sha, 'cross_label_group' AS reason FROM (SELECT doc_id, lang, sha256(text) AS sha FROM documents) WHERE sha IN (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1)""")
def quarantine(spark, sf_dir):
    return splits.quarantined(_documents(spark, sf_dir), "doc_id", "lang", "sha")


@query(
    """WITH RECURSIVE d AS (SELECT doc_id, lang, sha256(text) AS sha FROM documents), ok AS (SELECT * FROM d WHERE sha NOT IN (SELECT sha FROM d GROUP BY 1 HAVING count(DISTINCT lang) > 1)),
tc AS (SELECT lang, count(*) AS n FROM ok GROUP BY 1), g AS (SELECT sha, any_value(lang) AS lang, count(*) AS size FROM ok GROUP BY 1),
o AS (SELECT sha, size, g.lang, n, row_number() OVER (ORDER BY size DESC, g.lang, ('0x' || substr(md5(sha || ':42'), 1, 8))::BIGINT, sha) AS k FROM g JOIN tc USING (lang)),
f AS (SELECT 0::BIGINT AS k, '' AS best, MAP {}::MAP(VARCHAR, BIGINT) AS held, (SELECT sum(n) FROM tc)::BIGINT AS every
UNION ALL SELECT k, best, map_concat(held, MAP {best || lang: coalesce(held[best || lang], 0) + size, best: coalesce(held[best], 0) + size}), every FROM (
SELECT o.k, f.held, f.every, o.lang, o.size, list_reverse(list_sort([{'d': 14 * n - 20 * coalesce(held['train' || o.lang], 0), 't': 14 * every - 20 * coalesce(held['train'], 0), 's': 'train'}, {'d': 3 * n - 20 * coalesce(held['validation' || o.lang], 0), 't': 3 * every - 20 * coalesce(held['validation'], 0), 's': 'validation'}, {'d': 3 * n - 20 * coalesce(held['test' || o.lang], 0), 't': 3 * every - 20 * coalesce(held['test'], 0), 's': 'test'}]))[1].s AS best FROM f JOIN o ON o.k = f.k + 1))
SELECT doc_id, ok.lang, sha, best AS split FROM ok JOIN o USING (sha) JOIN f USING (k)"""
)
def split_primary(spark, sf_dir):
    d = _documents(spark, sf_dir)
    bad = splits.quarantined(d, "doc_id", "lang", "sha")
    return splits.group_split(d.join(bad, "doc_id", "left_anti"), "doc_id", "lang", "sha")


@query("""SELECT unnest(['disjoint', 'complete', 'quarantine', 'classes', 'groups', 'digests', 'shares', 'class_shares']) AS rule, 0::BIGINT AS n""")
def split_violations(spark, sf_dir):
    d = _documents(spark, sf_dir)
    bad = splits.quarantined(d, "doc_id", "lang", "sha")
    return splits.violations(split_primary(spark, sf_dir), d, bad, "doc_id", "lang", "sha", "sha")


@query(f"""WITH {_NAIVE} SELECT count(*) AS crossing FROM (SELECT sha256(text) AS sha FROM documents JOIN naive USING (doc_id) GROUP BY 1 HAVING count(DISTINCT split) > 1)""")
def naive_leakage(spark, sf_dir):
    d = naive_split(spark, sf_dir).join(_documents(spark, sf_dir).select("doc_id", "sha"), "doc_id")
    return d.groupBy("sha").agg(F.count_distinct("split").alias("s")).where("s > 1").agg(F.count("*").alias("crossing"))


def _top(spark, sf_dir, gain=1.6, seed=42):
    return metrics.judged(preds(spark, sf_dir, gain, seed))


@query(f"""WITH {preds_sql()} SELECT y_true, y_pred::INT AS y_pred, count(*) AS n FROM top GROUP BY 1, 2""")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_top(spark, sf_dir))


_PRF = """cls{0} AS (SELECT c AS cls, count(*) FILTER (y_true = c) AS support, count(*) FILTER (y_true = c AND y_pred = c) AS tp, count(*) FILTER (y_true <> c AND y_pred = c) AS fp, count(*) FILTER (y_true = c AND y_pred <> c) AS fn FROM top{0}, (SELECT unnest(range(10)) AS c) GROUP BY c),
prf{0} AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS prec, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS rec, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM cls{0} WHERE support + fp > 0)"""


@query(f"""WITH {preds_sql()}, {_PRF.format("")} SELECT cls::INT AS cls, support, tp, fp, fn, round(prec, 6) AS "precision", round(rec, 6) AS recall, round(f1, 6) AS f1 FROM prf""")
def per_class_prf(spark, sf_dir):
    return _rounded(metrics.per_class(metrics.confusion(_top(spark, sf_dir)))).withColumn("cls", F.col("cls").cast("int"))


@query(
    f"""WITH {preds_sql()}, {_PRF.format("")}, s AS (SELECT sum(support)::DOUBLE AS n, sum(tp)::DOUBLE AS c, sum(support * (tp + fp))::DOUBLE AS tp_, sum((tp + fp) * (tp + fp))::DOUBLE AS pp, sum(support * support)::DOUBLE AS tt FROM prf)
SELECT n::BIGINT AS n, round(c / n, 6) AS accuracy, round((c * n - tp_) / (sqrt(n * n - pp) * sqrt(n * n - tt)), 6) AS mcc, (SELECT round(avg(prec), 6) FROM prf WHERE support > 0) AS macro_precision, (SELECT round(avg(rec), 6) FROM prf WHERE support > 0) AS macro_recall,
(SELECT round(avg(f1), 6) FROM prf WHERE support > 0) AS macro_f1, (SELECT round(avg(rec), 6) FROM prf WHERE support > 0) AS balanced_accuracy FROM s"""
)
def headline_metrics(spark, sf_dir):
    return _rounded(metrics.headline(metrics.confusion(_top(spark, sf_dir))))


@query(
    f"""WITH {preds_sql()}, r AS (SELECT c, y_true, rank() OVER (PARTITION BY c ORDER BY p) + (count(*) OVER (PARTITION BY c, p) - 1) / 2.0::DOUBLE AS r FROM p),
s AS (SELECT c, count(*) FILTER (y_true = c) AS pos, count(*) FILTER (y_true <> c) AS neg, sum(CASE WHEN y_true = c THEN r ELSE 0 END) AS s FROM r GROUP BY c)
SELECT c::INT AS cls, pos, neg, round((s - pos * (pos + 1) / 2.0) / nullif(pos * neg, 0), 6)::DOUBLE AS auroc FROM s"""
)
def auroc_ovr(spark, sf_dir):
    return _rounded(metrics.auroc(preds(spark, sf_dir), CLASSES))


_BINS = "b AS (SELECT greatest(ceil(conf * 15), 1)::INT AS bin, count(*) AS n, avg(conf) AS confidence, avg(correct) AS accuracy FROM top GROUP BY 1)"


@query(f"""WITH {preds_sql()}, {_BINS} SELECT x.bin::INT AS bin, coalesce(n, 0) AS n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM (SELECT unnest(range(1, 16)) AS bin) x LEFT JOIN b USING (bin)""")
def reliability_bins(spark, sf_dir):
    return _rounded(metrics.reliability(_top(spark, sf_dir)))


@query(
    f"""WITH {preds_sql()}, {_BINS} SELECT (SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 6) FROM b) AS ece, (SELECT round(max(abs(confidence - accuracy)), 6) FROM b) AS mce,
(SELECT round(avg(-ln(greatest(least(p, 1), 1e-12))), 6) FROM p WHERE c = y_true) AS nll, (SELECT round(sum(power(p - (c = y_true)::INT, 2)) / count(DISTINCT test_index), 6) FROM p) AS brier"""
)
def calibration_summary(spark, sf_dir):
    return _rounded(metrics.calibration(_top(spark, sf_dir)))


_CURVE = """curve AS (SELECT s AS step, s / 199.0::DOUBLE AS threshold, count(*) FILTER (conf >= s / 199.0::DOUBLE) / count(*)::DOUBLE AS coverage, count(*) FILTER (conf >= s / 199.0::DOUBLE) AS n_kept, count(*) FILTER (conf >= s / 199.0::DOUBLE AND correct = 0) / nullif(count(*) FILTER (conf >= s / 199.0::DOUBLE), 0)::DOUBLE AS risk
FROM top, (SELECT unnest(range(200)) AS s) GROUP BY s)"""


@query(f"""WITH {preds_sql()}, {_CURVE} SELECT step::INT AS step, round(threshold, 6) AS threshold, round(coverage, 6) AS coverage, n_kept, round(risk, 6) AS risk FROM curve""")
def risk_coverage(spark, sf_dir):
    return _rounded(policy.risk_coverage(_top(spark, sf_dir)))


@query(
    f"""WITH {preds_sql(2.5)}, {_CURVE}, k AS (SELECT * FROM curve WHERE coverage >= 0.7 AND risk IS NOT NULL), g AS (SELECT min(threshold) FILTER (risk <= 0.25) AS good, min({{'risk': risk, 'threshold': threshold}}) AS least FROM k)
SELECT round(coalesce(good, least.threshold, 0), 6) AS threshold, CASE WHEN good IS NOT NULL THEN 'feasible' WHEN least IS NOT NULL THEN 'least_risk' ELSE 'disabled' END AS mode FROM g"""
)
def abstention_policy(spark, sf_dir):
    return _rounded(policy.pick_threshold(policy.risk_coverage(_top(spark, sf_dir, 2.5)), 0.25, 0.7))


@query(
    f"""WITH {preds_sql()} SELECT round(avg((conf >= 0.5)::INT), 6) AS coverage, count(*) FILTER (conf >= 0.5) AS n_answered, count(*) FILTER (conf < 0.5) AS n_abstained, round(avg(correct) FILTER (conf >= 0.5), 6) AS selective_accuracy,
round(avg(1 - correct) FILTER (conf >= 0.5), 6) AS selective_risk, round(avg(correct) FILTER (conf < 0.5), 6) AS abstained_accuracy FROM top"""
)
def selective_metrics(spark, sf_dir):
    return _rounded(policy.selective(_top(spark, sf_dir), 0.5))


@query(
    f"""WITH {preds_sql()}, t AS (SELECT s AS step, exp(ln(0.05) + s * (ln(10.0) - ln(0.05)) / 39) AS temperature FROM (SELECT unnest(range(40)) AS s)), l AS (SELECT step, temperature, test_index, y_true, c, ln(greatest(least(p, 1), 1e-12)) AS z FROM p, t),
m AS (SELECT *, exp((z - max(z) OVER (PARTITION BY step, test_index)) / temperature) AS ez FROM l), q AS (SELECT step, temperature, c, y_true, ez / sum(ez) OVER (PARTITION BY step, test_index) AS q FROM m)
SELECT step::INT AS step, round(temperature, 6) AS temperature, round(avg(-ln(greatest(q, 1e-12))), 6) AS nll FROM q WHERE c = y_true GROUP BY 1, 2"""
)
def temperature_grid(spark, sf_dir):
    return _rounded(policy.temperature_nll(preds(spark, sf_dir), points=40))


@query(ORACLE["temperature_grid"].replace("range(40)", "range(400)").replace("/ 39)", "/ 399)"))
def temperature_grid_full(spark, sf_dir):
    return _rounded(policy.temperature_nll(preds(spark, sf_dir), points=400))


def _nested(name, grid):
    """CTEs that pick the temperature of least NLL from a grid."""
    return f"""l{name} AS (SELECT t, test_index, least(ln(sum(exp((z - m) / t))) - max(CASE WHEN c = y_true THEN (z - m) / t END), -ln(1e-12)) AS v FROM b, ({grid}) GROUP BY 1, 2),
k{name} AS (SELECT arg_min(t, v) AS best FROM (SELECT t, avg(v) AS v FROM l{name} GROUP BY 1))"""


_FINER = "SELECT exp(ln(best) + (s - 50) * {1}::DOUBLE * (ln(10.0) - ln(0.05)) / 399) AS t FROM k{0}, (SELECT unnest(range(101)) AS s)"


@query(
    f"""WITH {preds_sql()}, b AS (SELECT test_index, y_true, c, z, max(z) OVER (PARTITION BY test_index) AS m FROM (SELECT *, ln(greatest(least(p, 1), 1e-12)) AS z FROM p) q),
{_nested(1, "SELECT exp(ln(0.05) + s * (ln(10.0) - ln(0.05)) / 399) AS t FROM (SELECT unnest(range(400)) AS s)")}, {_nested(2, _FINER.format(1, 0.02))}, {_nested(3, _FINER.format(2, 0.0004))} SELECT round(best, 4) AS temperature FROM k3"""
)
def temperature_fit(spark, sf_dir):
    return spark.createDataFrame([(round(policy.fit_temperature(preds(spark, sf_dir)), 4),)], "temperature double")


_DRAWS = """k AS (SELECT *, row_number() OVER (ORDER BY test_index) - 1 AS spot, count(*) OVER () AS n FROM {top}),
g AS (SELECT d, ('0x' || substr(md5(d || ':' || i), 1, 8))::BIGINT % (SELECT count(*) FROM k) AS spot FROM (SELECT unnest(range(20)) AS d), (SELECT unnest(range((SELECT count(*) FROM k))) AS i)),
o AS (SELECT d, k.* FROM g JOIN k USING (spot))"""
_DRAW_F1 = """f AS (SELECT d, c, 2 * count(*) FILTER (y_true = c AND {0} = c) / nullif(count(*) FILTER (y_true = c) + count(*) FILTER ({0} = c), 0)::DOUBLE AS f1, count(*) FILTER (y_true = c) AS s FROM o, (SELECT unnest(range(10)) AS c) GROUP BY 1, 2)"""


@query(f"""WITH {preds_sql()}, {_DRAWS.format(top="top")}, {_DRAW_F1.format("y_pred")}, v AS (SELECT d, avg(coalesce(f1, 0)) AS f1 FROM f WHERE s > 0 GROUP BY d) SELECT round(avg(f1), 6) AS mean, round(quantile_cont(f1, 0.025), 6) AS low, round(quantile_cont(f1, 0.975), 6) AS high FROM v""")
def bootstrap_ci(spark, sf_dir):
    return _bootstrap_ci(spark, sf_dir, 20)


@query(ORACLE["bootstrap_ci"].replace("range(20)", "range(2000)"))
def bootstrap_ci_full(spark, sf_dir):
    return _bootstrap_ci(spark, sf_dir, 2000)


def _bootstrap_ci(spark, sf_dir, draws):
    return _rounded(metrics.interval(metrics.bootstrap(_top(spark, sf_dir), draws), "macro_f1"))


@query(
    f"""WITH {preds_sql(1.8, 42, "a")}, {preds_sql(1.6, 42, "b")}, both_ AS (SELECT a.test_index, a.correct AS ca, b.correct AS cb FROM topa a JOIN topb b USING (test_index)), {_DRAWS.format(top="both_")}, v AS (SELECT d, avg(ca) - avg(cb) AS diff FROM o GROUP BY d)
SELECT round(avg(diff), 6) AS mean, round(quantile_cont(diff, 0.025), 6) AS low, round(quantile_cont(diff, 0.975), 6) AS high, round(avg((diff > 0)::INT), 6) AS positive FROM v"""
)
def paired_bootstrap(spark, sf_dir):
    return _paired_bootstrap(spark, sf_dir, 20)


@query(ORACLE["paired_bootstrap"].replace("range(20)", "range(2000)"))
def paired_bootstrap_full(spark, sf_dir):
    return _paired_bootstrap(spark, sf_dir, 2000)


def _paired_bootstrap(spark, sf_dir, draws):
    a, b = _top(spark, sf_dir, 1.8), _top(spark, sf_dir, 1.6)
    rows = a.select("test_index", F.col("y_true"), "y_pred").join(b.select("test_index", F.col("y_pred").alias("other")), "test_index")
    both = dedup._held(metrics.paired_differences(rows, "y_pred", "other", draws))
    out = metrics.interval(both, "diff").crossJoin(F.broadcast(both.agg(F.avg((F.col("diff") > 0).cast("int")).alias("positive"))))  # one row each
    return _rounded(out)


def _models(spark, sf_dir):
    rows = many_preds(spark, sf_dir, [((m, s), g, s) for m, g in GAINS.items() for s in SEEDS], ("model", "seed"))
    return metrics.judged(rows)


_MODELS = ",\n".join(preds_sql(g, s, f"_{m}_{s}") for m, g in GAINS.items() for s in SEEDS) + ",\nm AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, {s} AS seed, * FROM top_{m}_{s}" for m in GAINS for s in SEEDS) + ")"
_SCORES = """sc AS (SELECT model, seed, avg(coalesce(f1, 0)) AS macro_f1 FROM (SELECT model, seed, c, 2 * count(*) FILTER (y_true = c AND y_pred = c) / nullif(count(*) FILTER (y_true = c) + count(*) FILTER (y_pred = c), 0)::DOUBLE AS f1, count(*) FILTER (y_true = c) AS s FROM m, (SELECT unnest(range(10)) AS c) GROUP BY 1, 2, 3) WHERE s > 0 GROUP BY 1, 2)"""


def _scores(spark, sf_dir):
    return metrics.headline(metrics.confusion(_models(spark, sf_dir), ("model", "seed")), ("model", "seed"))


@query(
    f"""WITH {_MODELS}, t AS (SELECT a.model AS model_a, b.model AS model_b, a.seed, count(*) FILTER (a.correct = 1 AND b.correct = 0) AS b, count(*) FILTER (a.correct = 0 AND b.correct = 1) AS c, count(*) FILTER (a.correct = 1 AND b.correct = 1) AS both_right, count(*) FILTER (a.correct = 0 AND b.correct = 0) AS both_wrong
FROM m a JOIN m b ON a.seed = b.seed AND a.test_index = b.test_index AND a.model < b.model GROUP BY 1, 2, 3),
p AS (SELECT *, CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END AS p_value FROM t),
h AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p_value, model_a, model_b, seed) + 1) * p_value) AS step FROM p)
SELECT model_a, model_b, seed, b, c, both_right, both_wrong, round(p_value, 6)::DOUBLE AS p_value, CASE WHEN b + c >= 25 THEN round(power(abs(b - c) - 1.0, 2) / (b + c), 6) END::DOUBLE AS chi2, round(max(step) OVER w, 6)::DOUBLE AS p_holm, max(step) OVER w < 0.05 AS significant FROM h
WINDOW w AS (ORDER BY p_value, model_a, model_b, seed ROWS UNBOUNDED PRECEDING)"""
)
def mcnemar_holm(spark, sf_dir):
    outcomes = _models(spark, sf_dir).groupBy("test_index").agg(F.collect_list(F.struct("model", "seed", "correct")).alias("outcomes"))  # one of each run
    tests = compare.mcnemar(compare.paired_outcomes(outcomes))
    return _rounded(compare.holm(tests, order=("model_a", "model_b", "seed")))


@query(f"""WITH {_MODELS}, {_SCORES} SELECT model, count(*) AS n, round(avg(macro_f1), 6) AS mean, round(stddev_samp(macro_f1), 6) AS sd, round(min(macro_f1), 6) AS least, round(max(macro_f1), 6) AS largest, round(100 * (max(macro_f1) - min(macro_f1)), 6) AS range_points FROM sc GROUP BY 1""")
def seed_spread(spark, sf_dir):
    return _rounded(compare.spread(_scores(spark, sf_dir), ("model",), "macro_f1"))


@query(
    f"""WITH {_MODELS}, {_SCORES}, mm AS (SELECT model, avg(macro_f1) AS mean FROM sc GROUP BY 1), o AS (SELECT model, row_number() OVER (ORDER BY mean DESC, model)::INT AS overall, 100 * (mean - lead(mean) OVER (ORDER BY mean DESC, model)) AS gap_points FROM mm)
SELECT model, seed, round(macro_f1, 6) AS macro_f1, row_number() OVER (PARTITION BY seed ORDER BY macro_f1 DESC, model)::INT AS rank, overall, round(gap_points, 6) AS gap_points FROM sc JOIN o USING (model)"""
)
def rank_by_seed(spark, sf_dir):
    return _rounded(compare.seed_ranks(_scores(spark, sf_dir)))


@query(
    f"""WITH {_MODELS}, {_SCORES}, s AS (SELECT CASE model WHEN 'large' THEN 'naive' ELSE 'primary' END AS split, seed, macro_f1 FROM sc WHERE model IN ('large', 'medium'))
SELECT 'net' AS model, a.seed, round(a.macro_f1, 6) AS "primary", round(b.macro_f1, 6) AS naive, round(100 * (b.macro_f1 - a.macro_f1), 6) AS inflation_points FROM s a JOIN s b ON a.seed = b.seed AND a.split = 'primary' AND b.split = 'naive'"""
)
def leakage_inflation(spark, sf_dir):
    s = _scores(spark, sf_dir).where("model in ('large', 'medium')").select(F.lit("net").alias("model"), "seed", "macro_f1", F.when(F.col("model") == "large", "naive").otherwise("primary").alias("split"))
    return _rounded(compare.inflation(s))


_TWO = f"""{preds_sql(1.6, 42, "a")}, {preds_sql(1.5, 42, "b")}"""


@query(
    f"""WITH {_TWO}, d AS (SELECT abs(a.p - b.p) AS d FROM pa a JOIN pb b USING (test_index, c)), g AS (SELECT count(*) AS n, avg((a.y_pred = b.y_pred)::INT) AS agreement FROM topa a JOIN topb b USING (test_index))
SELECT n, round(agreement, 6) AS agreement, (SELECT round(max(d), 6) FROM d) AS max_deviation, (SELECT round(avg(d), 6) FROM d) AS mean_deviation, (SELECT round(quantile_cont(d, 0.99), 6) FROM d) AS p99_deviation, (SELECT max(d) <= 0.001 FROM d) AS within FROM g"""
)
def parity_summary(spark, sf_dir):
    return _rounded(compare.parity(_top(spark, sf_dir, 1.6), _top(spark, sf_dir, 1.5)))


@query(f"""WITH {_TWO} SELECT a.y_pred::INT AS from_class, b.y_pred::INT AS to_class, count(*) AS n FROM topa a JOIN topb b USING (test_index) WHERE a.y_pred <> b.y_pred GROUP BY 1, 2""")
def class_transitions(spark, sf_dir):
    return compare.transitions(_top(spark, sf_dir, 1.6), _top(spark, sf_dir, 1.5))


@query(
    f"""WITH {_TWO}, {_PRF.format("a")}, {_PRF.format("b")}, j AS (SELECT a.cls, a.f1 AS fa, b.f1 AS fb, 100 * (a.rec - b.rec) AS drop_ FROM prfa a JOIN prfb b USING (cls))
SELECT round(100 * (avg(fa) - avg(fb)), 6) AS f1_drop, arg_max(cls, drop_)::INT AS worst_class, round(max(drop_), 6) AS recall_drop, 100 * (avg(fa) - avg(fb)) > 1.5 OR max(drop_) > 5 AS material FROM j"""
)
def material_degradation(spark, sf_dir):
    per = lambda g: metrics.per_class(metrics.confusion(_top(spark, sf_dir, g)))
    return _rounded(compare.degradation(per(1.6), per(1.5)))


_CONDITIONS = [("clean", 0, 2.0), *((c, s, g) for c, g0 in (("blur", 1.6), ("noise", 1.8)) for s, g in ((1, g0), (2, g0 - 0.4), (3, g0 - 0.8)))]


def _judged_conditions(spark, sf_dir):
    return metrics.judged(many_preds(spark, sf_dir, [((c, s), g, 42) for c, s, g in _CONDITIONS], ("condition", "severity")))


def _conditions(spark, sf_dir):
    return _judged_conditions(spark, sf_dir).groupBy("condition", "severity").agg(F.avg("correct").alias("accuracy"), F.avg("conf").alias("confidence"))


_COND_SQL = ",\n".join(preds_sql(round(g, 2), 42, f"_{c}{s}") for c, s, g in _CONDITIONS) + ",\ncn AS (" + " UNION ALL ".join(f"SELECT '{c}' AS condition, {s} AS severity, avg(correct) AS accuracy, avg(conf) AS confidence FROM top_{c}{s}" for c, s, _ in _CONDITIONS) + ")"


@query(f"""WITH {_COND_SQL} SELECT x.condition, x.severity, round(100 * (k.accuracy - x.accuracy), 6) AS accuracy_drop, round(100 * (k.confidence - x.confidence), 6) AS confidence_drop FROM cn x, cn k WHERE k.condition = 'clean' AND x.condition <> 'clean'""")
def severity_deltas(spark, sf_dir):
    return _rounded(compare.severity_deltas(_conditions(spark, sf_dir), values=("accuracy", "confidence")))


@query(f"""WITH {_COND_SQL} SELECT count(*) AS n, round(corr(accuracy, confidence), 6) AS r FROM cn""")
def confidence_tracks_accuracy(spark, sf_dir):
    return _rounded(compare.tracking(_conditions(spark, sf_dir)))


@query(
    """WITH c AS (SELECT vec_id, i, greatest(embedding[i + 1]::DOUBLE, 0) AS v, (i // 8 BETWEEN 2 AND 5) AND (i % 8 BETWEEN 2 AND 5) AS inner_ FROM embeddings, (SELECT unnest(range(64)) AS i))
SELECT vec_id, round(coalesce(sum(CASE WHEN inner_ THEN 0 ELSE v END) / nullif(sum(v), 0), 0), 6) AS peripheral_mass FROM c GROUP BY 1"""
)
def cam_peripheral_mass(spark, sf_dir):
    cells = F.transform("embedding", lambda x: x.cast("double"))
    return _rounded(table(spark, sf_dir, "embeddings").select("vec_id", fn.peripheral_mass(cells, 8, 2).alias("peripheral_mass")))


@query(f"""WITH {preds_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY test_index ORDER BY p DESC, c) AS r FROM p) SELECT test_index, string_agg(CASE WHEN r <= 3 THEN c::VARCHAR END, ',' ORDER BY r) AS top3, round(-sum(p * ln(p)), 6) AS entropy, max(p) < 0.5 AS abstained FROM r GROUP BY 1""")
def entropy_top3(spark, sf_dir):
    rows = preds(spark, sf_dir)
    return _rounded(rows.select("test_index", F.array_join(F.transform(fn.top_indices(F.col("probs"), 3), lambda x: x.cast("string")), ",").alias("top3"), fn.entropy(F.col("probs")).alias("entropy"), (F.array_max("probs") < 0.5).alias("abstained")))


@query(
    """WITH e AS (SELECT event_type AS model, (event_id % 3)::INT AS repeat, value::DOUBLE AS v FROM events)
SELECT model, coalesce(repeat, -1)::INT AS repeat, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(min(v), 6) AS least, round(max(v), 6) AS largest
FROM e GROUP BY GROUPING SETS ((model, repeat), (model))"""
)
def latency_percentiles(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("repeat", (F.col("event_id") % 3).cast("int"))
    # -1 stands for all repeats together.
    return _rounded(records.latency(rows, "event_type", "repeat", "value")).withColumn("repeat", F.coalesce("repeat", F.lit(-1)))


@query("""SELECT event_type, round(list_sort(list(value))[least(count(*) - 1, floor(0.95 * count(*)))::INT + 1], 6) AS p95_n, round(list_sort(list(value))[floor((count(*) - 1) * 0.95)::INT + 1], 6) AS p95_n1 FROM events GROUP BY 1""")
def nearest_rank(spark, sf_dir):
    # The nearest-rank rules need the sorted values of a group; ranks by window keep the group out of one array.
    from pyspark.sql import Window as W

    w = W.partitionBy("event_type")
    rows = table(spark, sf_dir, "events").select("event_type", "value", (F.row_number().over(w.orderBy("value")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    pick = lambda at: F.max(F.when(F.col("i") == at, F.col("value")))
    return _rounded(rows.groupBy("event_type").agg(pick(F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))).alias("p95_n"), pick(F.floor((F.col("n") - 1) * 0.95)).alias("p95_n1")))


_LOG = """g AS (SELECT *, event_id % 50 AS k FROM events), r AS (SELECT *, CASE WHEN k = 1 THEN 'bad_json' WHEN k = 2 THEN 'no_image' WHEN k = 5 THEN 'missing_file' WHEN k = 3 THEN 'hash_mismatch' END AS reason FROM g WHERE k <> 0)"""


@query(f"""WITH {_LOG} SELECT coalesce(reason, 'good') AS reason, count(*) AS n FROM (SELECT reason FROM r UNION ALL SELECT NULL FROM events WHERE event_id % 7 = 0) GROUP BY 1""")
def fieldlog_quarantine(spark, sf_dir):
    rows = fieldlog.parse(journal_lines(spark, sf_dir), journal_images(spark, sf_dir))
    return rows.groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_LOG}, t AS (SELECT event_type AS device, value, event_id % 4 = 0 AS abstained, CASE WHEN event_id % 7 = 0 THEN ['correct', 'incorrect', 'unsure'][event_id % 3 + 1] END AS v, event_id % 14 = 0 AS expert FROM r WHERE reason IS NULL AND event_id % 10 <> 4)
SELECT device, count(*) AS n, round(avg(abstained::INT), 6) AS abstention_rate, round(avg(value), 6) AS latency_mean, round(quantile_cont(value, 0.95), 6) AS latency_p95, count(v) AS n_annotated,
round(count(*) FILTER (v = 'correct') / nullif(count(*) FILTER (v IN ('correct', 'incorrect')), 0)::DOUBLE, 6) AS agreement, round(count(*) FILTER (expert AND v = 'correct') / nullif(count(*) FILTER (expert AND v IN ('correct', 'incorrect')), 0)::DOUBLE, 6) AS expert_agreement FROM t GROUP BY 1"""
)
def fieldlog_tiers(spark, sf_dir):
    rows = fieldlog.parse(journal_lines(spark, sf_dir), journal_images(spark, sf_dir))
    return _rounded(fieldlog.tiers(fieldlog.fold(rows.where("reason is null"))))


@query("""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS r FROM documents) WHERE r = 1""")
def class_exemplars(spark, sf_dir):
    return records.exemplars(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).cast("binary")), "doc_id")


@query("""SELECT r_regionkey * 1000 AS id, r_name AS path FROM region UNION ALL SELECT n_nationkey AS id, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 0""")
def folder_tree(spark, sf_dir):
    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 1000).alias("id"), F.lit(None).cast("long").alias("up"), F.col("r_name").alias("name"))
    n = table(spark, sf_dir, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") * 1000).alias("up"), F.col("n_name").alias("name"))
    return records.folder_paths(r.unionByName(n), "id", "up", "name")


@query("""WITH r AS (SELECT event_type AS model, (user_id % 40)::INT AS seed, value FROM events) SELECT model, seed FROM (SELECT DISTINCT model FROM r), (SELECT DISTINCT seed FROM r) EXCEPT SELECT model, seed FROM r GROUP BY 1, 2 HAVING max(value) > 200""")
def open_experiments(spark, sf_dir):
    """Models and seeds without a finished run: events stand for progress reports, one beyond 200 for a finish."""
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (F.col("user_id") % 40).cast("int").alias("seed"), "value")
    return selection.open_runs(runs, ("model", "seed"), F.max("value") > 200)


@query()
def frozen_report(spark, sf_dir):
    return files.report(headline=headline_metrics(spark, sf_dir), calibration=calibration_summary(spark, sf_dir), policy=abstention_policy(spark, sf_dir), distribution=class_distribution(spark, sf_dir))


@query()
def table_digest(spark, sf_dir):
    return files.digest(table(spark, sf_dir, "orders"), "o_orderkey")


@query("""SELECT x.c::INT AS cls, coalesce(n, 0) AS n, round(sum(coalesce(n, 0)) OVER () / (12 * greatest(coalesce(n, 0), 1)), 6)::DOUBLE AS weight FROM (SELECT unnest(range(12)) AS c) x LEFT JOIN (SELECT label AS c, count(*) AS n FROM embeddings GROUP BY 1) USING (c)""")
def class_weights(spark, sf_dir):
    return _rounded(selection.class_histogram(table(spark, sf_dir, "embeddings"), "label", 12))


@query("""SELECT doc_id FROM documents ORDER BY ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT, doc_id LIMIT 30""")
def seeded_sample(spark, sf_dir):
    return selection.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 30)


@query("""(SELECT doc_id, n_chars, 'low' AS "end" FROM documents ORDER BY n_chars, doc_id LIMIT 3) UNION ALL (SELECT doc_id, n_chars, 'high' FROM documents ORDER BY n_chars DESC, doc_id LIMIT 3)""")
def size_extremes(spark, sf_dir):
    return selection.extremes(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@query(f"""WITH {preds_sql()}, f AS (SELECT *, row_number() OVER (PARTITION BY y_true, y_pred ORDER BY conf DESC, test_index) AS r FROM top WHERE y_true <> y_pred) SELECT test_index, y_true, y_pred::INT AS y_pred, round(conf, 6) AS conf FROM f WHERE r = 1 ORDER BY conf DESC, test_index LIMIT 4""")
def distinct_errors(spark, sf_dir):
    return _rounded(selection.distinct_errors(_top(spark, sf_dir)).select("test_index", "y_true", "y_pred", "conf"))


@query(f"""WITH {_HAMMING}, o AS (SELECT a, b, row_number() OVER (ORDER BY distance, a, b) - 1 AS i FROM h WHERE distance <= 20) SELECT a, b, i // 6 AS page, i % 6 AS place FROM o""")
def pair_pages(spark, sf_dir):
    return selection.pages(_pairs(spark, sf_dir), [F.col("distance"), F.col("a"), F.col("b")], 6).select("a", "b", F.col("page").cast("long").alias("page"), F.col("place").cast("long").alias("place"))


@query(f"""WITH {_HAMMING} (SELECT a, b, distance, 'closest' AS kind FROM h WHERE distance <= 20 ORDER BY distance, a, b LIMIT 1) UNION ALL (SELECT a, b, distance, 'farthest' FROM h WHERE distance <= 18 ORDER BY distance DESC, a, b LIMIT 1)""")
def pair_samples(spark, sf_dir):
    return selection.pair_samples(_pairs(spark, sf_dir), 18)


def _progress(spark, sf_dir):
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.row_number().over(W.partitionBy("event_type").orderBy("event_id")).alias("epoch"), F.col("value").alias("f1"))
    return selection.training_progress(e, "run", "epoch", "f1").select("run", "epoch", "best", "waited")


@query(
    """WITH e AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY event_id)::INT AS epoch, value AS f1 FROM events), b AS (SELECT *, max(f1) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best, max(f1) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT run, epoch, best, epoch - max(CASE WHEN before IS NULL OR f1 > before THEN epoch END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS waited FROM b WHERE epoch <= 200"""
)
def training_progress(spark, sf_dir):
    return _progress(spark, sf_dir).where("epoch <= 200")  # as its SQL; the whole runs are the next query


@query(ORACLE["training_progress"].replace(" WHERE epoch <= 200", ""))
def training_progress_all(spark, sf_dir):
    return _progress(spark, sf_dir)


@query(
    """WITH RECURSIVE g AS (SELECT n_nationkey AS "case", 0 AS step, (1000 + 7919 * n_nationkey)::BIGINT AS s FROM nation UNION ALL SELECT "case", step + 1, (s * 1103515245 + 12345) & 2147483647 FROM g WHERE step < 5)
SELECT "case", step::INT AS step, round(s / 2147483648.0::DOUBLE, 6) AS value FROM g WHERE step > 0"""
)
def parity_cases(spark, sf_dir):
    return _rounded(selection.parity_cases(table(spark, sf_dir, "nation"), "n_nationkey", 5))


@query("""SELECT lang, count(*) AS found, 100::BIGINT AS declared, count(*) - 100 AS delta FROM documents WHERE lang <> 'es' GROUP BY 1""")
def declared_totals(spark, sf_dir):
    declared = spark.createDataFrame([(x, 100) for x in ("en", "fr", "de")], "lang string, declared long")
    return selection.declared_totals(table(spark, sf_dir, "documents"), declared, "lang").where("declared is not null")


@query(
    """WITH c AS (SELECT vec_id, i, 100 * embedding[i + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS i)),
l AS (SELECT m.vec_id, a.v + b.v + t.v + u.v - 4 * m.v AS l FROM c m JOIN c a ON a.vec_id = m.vec_id AND a.i = m.i - 1 JOIN c b ON b.vec_id = m.vec_id AND b.i = m.i + 1 JOIN c t ON t.vec_id = m.vec_id AND t.i = m.i - 8 JOIN c u ON u.vec_id = m.vec_id AND u.i = m.i + 8 WHERE m.i % 8 BETWEEN 1 AND 6 AND m.i // 8 BETWEEN 1 AND 6)
SELECT c.vec_id, round(avg(v), 4) AS brightness, round(stddev_pop(v), 4) AS contrast, round(any_value(q), 4) AS laplacian, CASE WHEN any_value(q) < 100 THEN 'blurry' WHEN any_value(q) < 300 THEN 'soft' ELSE 'sharp' END AS sharpness FROM c JOIN (SELECT vec_id, var_pop(l) AS q FROM l GROUP BY 1) x ON x.vec_id = c.vec_id GROUP BY 1"""
)
def image_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: 100 * x.cast("double")).alias("px"))
    mean, sd = images.contrast(F.col("px"))
    q = images.laplacian_variance(F.col("px"), 8)
    return _rounded(rows.select("vec_id", mean.alias("brightness"), sd.alias("contrast"), q.alias("laplacian"), images.sharpness(q).alias("sharpness")), 4)


@query("""SELECT vec_id, cell::INT AS cell, round(greatest(sum(embedding[cell * 4 + k + 1]::DOUBLE * [0.5, -0.25, 1.0, 0.75][k + 1]), 0), 6) AS activation FROM embeddings, (SELECT unnest(range(16)) AS cell), (SELECT unnest(range(4)) AS k) GROUP BY 1, 2""")
def activation_maps(spark, sf_dir):
    weights = F.array(*[F.lit(w) for w in (0.5, -0.25, 1.0, 0.75)])
    cells = images.class_map(F.transform("embedding", lambda x: x.cast("double")), weights, 4)
    return _rounded(table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(cells).alias("cell", "activation")))


@query()
def corrupted_quality(spark, sf_dir):
    pixels = F.transform("embedding", lambda x: 128 + 200 * x.cast("double"))
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("width"), pixels.alias("pixels"))
    rows = images.corrupt(own, "vec_id")
    mean, sd = images.contrast(F.col("pixels"))
    return _rounded(rows.groupBy("corruption", "severity").agg(F.count("*").alias("n"), F.avg(mean).alias("brightness"), F.avg(sd).alias("contrast")), 3)


@query()
def segment_masks(spark, sf_dir):
    pixels = F.transform("embedding", lambda x: 128 + 200 * x.cast("double"))
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("width"), pixels.alias("pixels"))
    return images.segment(own, "vec_id").select("vec_id", F.round("area", 4).alias("area"), "touches_border")


def _streamed(spark, sf_dir, of, mode="complete", more=None):
    """What a stream over the journal's lines has given when all of them are read. ``more`` appends to the journal's folder first."""
    import uuid

    from lakeproof.session import shared_dir
    from lakeproof.streaming import journal, sinks

    root = f"{shared_dir(spark)}/journal-{uuid.uuid4().hex}"
    journal_lines(spark, sf_dir).write.text(f"{root}/lines")
    if more is not None:
        more(f"{root}/lines")
    rows = of(journal.journal_stream(spark, f"{root}/lines"))
    return _rounded(sinks.run_to_files(rows, f"{root}/rows", f"{root}/state", mode))


@query()
def fieldlog_stream(spark, sf_dir):
    from lakeproof.streaming import journal

    return _streamed(spark, sf_dir, journal.windowed)


from lakeproof.plans import cells, copies, frozen, reports, stored  # noqa: E402, F401  register their queries here
