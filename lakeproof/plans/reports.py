"""Registered reports, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.functions import scalars as fn
from lakeproof.operators import dedup, metrics, records, splits, summaries
from lakeproof.plans import catalog as c
from lakeproof.plans.fixtures import CLASSES, GAINS, RELEASES_SQL, SEEDS, journal_lines, preds, preds_sql, releases, table
from lakeproof.streaming import journal

query, rounded = c.query, c._rounded


_models, _judged_conditions = c._models, c._judged_conditions
_ALL = c._MODELS + ",\npm AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, {s} AS seed, * FROM p_{m}_{s}" for m in GAINS for s in SEEDS) + ")"
_PER = """pc AS (SELECT model, seed, c, count(*) FILTER (y_true = c) AS s, count(*) FILTER (y_true = c AND y_pred = c) AS tp, count(*) FILTER (y_pred = c) AS pr FROM m, (SELECT unnest(range(10)) AS c) GROUP BY 1, 2, 3),
pq AS (SELECT *, coalesce(tp / nullif(pr, 0)::DOUBLE, 0) AS prec, coalesce(tp / nullif(s, 0)::DOUBLE, 0) AS rec, coalesce(2 * tp / nullif(s + pr, 0)::DOUBLE, 0) AS f1 FROM pc WHERE s + pr > 0),
hd AS (SELECT model, seed, sum(tp)::DOUBLE / sum(s) AS accuracy, (sum(tp)::DOUBLE * sum(s) - sum(s * pr)::DOUBLE) / (sqrt(sum(s)::DOUBLE * sum(s) - sum(pr * pr)) * sqrt(sum(s)::DOUBLE * sum(s) - sum(s * s))) AS mcc, avg(prec) FILTER (s > 0) AS macro_precision, avg(rec) FILTER (s > 0) AS macro_recall, avg(f1) FILTER (s > 0) AS macro_f1, avg(rec) FILTER (s > 0) AS balanced_accuracy FROM pq GROUP BY 1, 2),
bn AS (SELECT model, seed, greatest(ceil(conf * 15), 1) AS bin, count(*) AS n, abs(avg(conf) - avg(correct)) AS gap FROM m GROUP BY 1, 2, 3),
cb AS (SELECT model, seed, sum(n * gap) / sum(n) AS ece, max(gap) AS mce FROM bn GROUP BY 1, 2),
nl AS (SELECT model, seed, avg(-ln(greatest(least(p, 1), 1e-12))) FILTER (c = y_true) AS nll, sum(power(p - (c = y_true)::INT, 2)) / count(DISTINCT test_index) AS brier FROM pm GROUP BY 1, 2),
lg AS (SELECT model, metric, value FROM (SELECT * FROM hd JOIN cb USING (model, seed) JOIN nl USING (model, seed)) UNPIVOT (value FOR metric IN (accuracy, mcc, macro_precision, macro_recall, macro_f1, balanced_accuracy, ece, mce, nll, brier)) UNION ALL SELECT model, 'f1_' || c, f1 FROM pq WHERE s > 0)"""


@query(f"""WITH {_ALL}, {_PER} SELECT model, metric, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS least, round(max(value), 6) AS largest FROM lg GROUP BY 1, 2""")
def metric_summary(spark, sf_dir):
    return rounded(summaries.metric_summary(_models(spark, sf_dir), "model", "seed"))


@query(
    f"""WITH {preds_sql()}, en AS (SELECT test_index, -sum(p * ln(p)) AS entropy FROM p GROUP BY 1), r AS (SELECT *, (conf < 0.5)::DOUBLE AS abstained FROM top JOIN en USING (test_index)),
s AS (SELECT 'all' AS subset, * FROM r UNION ALL SELECT 'correct', * FROM r WHERE correct = 1 UNION ALL SELECT 'wrong', * FROM r WHERE correct = 0 UNION ALL SELECT 'abstained', * FROM r WHERE conf < 0.5 UNION ALL SELECT 'class_' || y_true, * FROM r),
l AS (SELECT subset, 'conf' AS key, conf AS value FROM s UNION ALL SELECT subset, 'entropy', entropy FROM s UNION ALL SELECT subset, 'abstained', abstained FROM s)
SELECT subset, key, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75 FROM l GROUP BY 1, 2"""
)
def subset_summaries(spark, sf_dir):
    rows = metrics.judged(preds(spark, sf_dir)).withColumns({"entropy": fn.entropy(F.col("probs")), "abstained": F.col("conf") < 0.5})
    subsets = {"all": F.lit(True), "correct": F.col("correct") == 1, "wrong": F.col("correct") == 0, "abstained": F.col("abstained")} | {f"class_{k}": F.col("y_true") == k for k in range(CLASSES)}
    return rounded(summaries.subset_summaries(rows, subsets, ["conf", "entropy"], ["abstained"]))


_POLICY = ",\n".join(preds_sql(round(g, 2), 42, f"_{n}{s}") for n, s, g in c._CONDITIONS) + ",\nx AS (" + " UNION ALL ".join(f"SELECT '{n}' AS condition, {s} AS severity, * FROM top_{n}{s}" for n, s, _ in c._CONDITIONS) + ")"


@query(
    f"""WITH {_POLICY}, g AS (SELECT condition || severity AS name, avg((conf >= 0.3)::INT) AS coverage, avg(1 - correct) FILTER (conf >= 0.3) AS risk FROM x GROUP BY 1)
SELECT 'risk' AS rule, count(*) AS n, count(*) FILTER (risk > 0.4) AS violations, coalesce(string_agg(CASE WHEN risk > 0.4 THEN name END, ',' ORDER BY name), '') AS names FROM g
UNION ALL SELECT 'coverage', count(*), count(*) FILTER (coverage < 0.5), coalesce(string_agg(CASE WHEN coverage < 0.5 THEN name END, ',' ORDER BY name), '') FROM g"""
)
def policy_rollup(spark, sf_dir):
    kept = F.col("conf") >= 0.3
    per = _judged_conditions(spark, sf_dir).groupBy("condition", "severity").agg(F.avg(kept.cast("int")).alias("coverage"), F.avg(F.when(kept, 1 - F.col("correct"))).alias("risk"))
    return summaries.policy_rollup(per, F.concat("condition", F.col("severity").cast("string")), 0.4, 0.5)


@query(
    f"""WITH {_POLICY}, bn AS (SELECT condition, severity, greatest(ceil(conf * 15), 1) AS bin, count(*) AS n, abs(avg(conf) - avg(correct)) AS gap FROM x GROUP BY 1, 2, 3),
e AS (SELECT condition, severity, sum(n * gap) / sum(n) AS ece FROM bn GROUP BY 1, 2), f AS (SELECT condition, severity, avg(conf) AS confidence FROM x GROUP BY 1, 2), o AS (SELECT * FROM e JOIN f USING (condition, severity))
SELECT o.condition, o.severity, round(o.ece - k.ece, 5) AS ece_change, round(o.confidence - k.confidence, 5) AS confidence_change FROM o, o k WHERE k.condition = 'clean' AND o.condition <> 'clean'"""
)
def confidence_changes(spark, sf_dir):
    return summaries.confidence_changes(_judged_conditions(spark, sf_dir), ("condition", "severity"), F.col("condition") == "clean")


_TWO = f"""{preds_sql(1.8, 42, "a")}, {preds_sql(1.4, 42, "b")}"""


@query(
    f"""WITH {_TWO} SELECT count(*) AS n, round(avg((a.y_pred = b.y_pred)::INT), 6) AS survival, round(avg(a.correct), 6) AS accuracy_a, round(avg(a.conf), 6) AS confidence_a, round(avg((a.conf >= 0.4)::INT), 6) AS coverage_a,
round(avg(b.correct), 6) AS accuracy_b, round(avg(b.conf), 6) AS confidence_b, round(avg((b.conf >= 0.4)::INT), 6) AS coverage_b FROM topa a JOIN topb b USING (test_index) WHERE a.conf >= 0.25"""
)
def counterfactual(spark, sf_dir):
    a, b = (metrics.judged(preds(spark, sf_dir, g)) for g in (1.8, 1.4))
    return rounded(summaries.counterfactual(a, b, F.col("conf_a") >= 0.25, 0.4))


@query(
    f"""WITH {_TWO}, r AS (SELECT a.y_true, a.y_pred AS p, b.y_pred AS q FROM topa a JOIN topb b USING (test_index)),
per AS (SELECT y_true, round(100 * (avg((p = y_true)::INT) - avg((q = y_true)::INT)), 9) AS recall_drop, avg((p = q)::INT) AS retained FROM r GROUP BY 1), w AS (SELECT * FROM per ORDER BY recall_drop DESC, y_true LIMIT 1),
d AS (SELECT y_true, q::INT AS destination, count(*) AS n FROM r WHERE p <> q GROUP BY 1, 2) SELECT y_true, round(recall_drop, 6) AS recall_drop, round(retained, 6) AS retained, destination, n FROM w LEFT JOIN d USING (y_true)"""
)
def class_losses(spark, sf_dir):
    a, b = (metrics.judged(preds(spark, sf_dir, g)) for g in (1.8, 1.4))
    return rounded(summaries.class_losses(a, b))


@query(
    f"""WITH {preds_sql()}, r AS (SELECT c, y_true, rank() OVER (PARTITION BY c ORDER BY p) + (count(*) OVER (PARTITION BY c, p) - 1) / 2.0::DOUBLE AS r FROM p),
s AS (SELECT c, count(*) FILTER (y_true = c) AS pos, count(*) FILTER (y_true <> c) AS neg, sum(CASE WHEN y_true = c THEN r ELSE 0 END) AS s FROM r GROUP BY c)
SELECT count(*) FILTER (pos * neg > 0) AS classes, round(avg((s - pos * (pos + 1) / 2.0) / nullif(pos * neg, 0)), 6)::DOUBLE AS macro_auroc FROM s"""
)
def macro_auroc(spark, sf_dir):
    return rounded(summaries.macro_auroc(metrics.auroc(preds(spark, sf_dir), CLASSES)))


@query(
    f"""WITH {c._HAMMING}, k AS (SELECT h.* FROM h JOIN embeddings x ON x.vec_id = h.a JOIN embeddings y ON y.vec_id = h.b WHERE distance <= 20 AND cosine >= 0.6 AND x.label <> y.label)
SELECT count(*) AS n, min(distance) AS least_distance, max(distance) AS largest_distance, round(min(cosine), 6) AS least_cosine, round(max(cosine), 6) AS largest_cosine, count(*) FILTER (distance <= 18) AS operative FROM k"""
)
def cross_label_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    pairs = dedup.confirmed(c._pairs(spark, sf_dir), e, "vec_id", "embedding", 0.6, 18).where("passes")
    side = lambda s: e.select(F.col("vec_id").alias(s), F.col("label").alias(f"l_{s}"))
    return rounded(summaries.pair_extremes(pairs.join(side("a"), "a").join(side("b"), "b").where("l_a != l_b"), 18))


@query(
    f"""WITH {c._HAMMING}, k AS (SELECT x.label, h.b - h.a AS gap FROM h JOIN embeddings x ON x.vec_id = h.a JOIN embeddings y ON y.vec_id = h.b WHERE distance <= 20 AND x.label = y.label),
g AS (SELECT label, count(*) AS n, count(*) FILTER (gap = 1) AS adjacent FROM k GROUP BY 1), z AS (SELECT label, count(*) AS size FROM embeddings GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS n_pairs, sum(adjacent)::BIGINT AS adjacent, sum(2.0::DOUBLE * n / size) AS expected FROM g JOIN z USING (label))
SELECT n_pairs, adjacent, round(expected, 6) AS expected, round(adjacent / nullif(expected, 0), 6) AS ratio, (SELECT coalesce(string_agg(gap, ',' ORDER BY gap), '') FROM (SELECT gap FROM k ORDER BY gap LIMIT 15)) AS gaps FROM t"""
)
def expected_adjacency(spark, sf_dir):
    return rounded(summaries.expected_adjacency(c._pairs(spark, sf_dir), table(spark, sf_dir, "embeddings"), "vec_id", "label"))


_GRID = list(range(0, 19, 2))


@query(
    f"""WITH RECURSIVE {c._HAMMING}, t AS (SELECT unnest({_GRID}) AS threshold), e AS (SELECT threshold, a, b FROM h, t WHERE distance <= threshold UNION SELECT threshold, b, a FROM h, t WHERE distance <= threshold),
r AS (SELECT threshold, vec_id AS id, vec_id AS other FROM embeddings, t UNION SELECT r.threshold, r.id, e.b FROM r JOIN e ON r.other = e.a AND r.threshold = e.threshold),
k AS (SELECT threshold, id, min(other) AS k FROM r GROUP BY 1, 2), g AS (SELECT threshold, k, count(*) AS size FROM k GROUP BY 1, 2)
SELECT threshold::INT AS threshold, count(*) AS groups, count(*) FILTER (size > 1) AS multi, max(size) AS largest, round(100.0 * sum(CASE WHEN size > 1 THEN size ELSE 0 END) / sum(size), 3)::DOUBLE AS percent_grouped FROM g GROUP BY 1"""
)
def threshold_grid(spark, sf_dir):
    every = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    out = dedup.sweep(every, c._pairs(spark, sf_dir, _GRID[-1]), _GRID)
    return out.select("threshold", "groups", "multi", "largest", F.round(100.0 * F.col("in_multi") / (F.col("groups") - F.col("multi") + F.col("in_multi")), 3).alias("percent_grouped"))


_SHA = "SELECT doc_id, lang, source, sha256(text) AS sha FROM documents"


@query(f"""SELECT cluster_id, n AS group_size, labels FROM (SELECT 'EX' || lpad(CAST(row_number() OVER (ORDER BY sha) AS VARCHAR), 4, '0') AS cluster_id, n, labels, k FROM (SELECT sha, count(*) AS n, string_agg(DISTINCT source, '|' ORDER BY source) AS labels, count(DISTINCT source) AS k FROM ({_SHA}) GROUP BY 1 HAVING count(*) > 1)) WHERE k > 1""")
def cross_label_clusters(spark, sf_dir):
    return summaries.cross_label(records.exact_clusters(c._documents(spark, sf_dir), "sha", "source", "doc_id"))


@query(f"""WITH g AS (SELECT count(*) AS size FROM ({_SHA}) GROUP BY sha) SELECT size, count(*) AS groups, round(100.0 * size * count(*) / sum(size * count(*)) OVER (), 3)::DOUBLE AS share FROM g GROUP BY size""")
def group_sizes(spark, sf_dir):
    return summaries.group_sizes(c._documents(spark, sf_dir), "sha")


@query(
    f"""SELECT doc_id, source, sha, CASE WHEN doc_id % 37 = 0 THEN 'undecodable:truncated' ELSE 'cross_label_group' END AS reason FROM ({_SHA}) WHERE doc_id % 37 = 0 OR sha IN (SELECT sha FROM ({_SHA}) GROUP BY 1 HAVING count(DISTINCT source) > 1)"""
)
def quarantine_by_source(spark, sf_dir):
    d = c._documents(spark, sf_dir).withColumn("status", F.when(F.col("doc_id") % 37 == 0, "truncated").otherwise("ok"))
    return splits.quarantined(d, "doc_id", "source", "sha", "status")


@query(f"""WITH {c._NAIVE}, d AS ({_SHA}) SELECT split, count(*) AS n, count(DISTINCT d.lang) AS classes, count(DISTINCT sha) AS groups, round(count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS fraction FROM naive JOIN d USING (doc_id) GROUP BY 1""")
def split_report(spark, sf_dir):
    return summaries.split_report(c.naive_split(spark, sf_dir), c._documents(spark, sf_dir), "doc_id", "lang", "sha")


@query(f"""WITH {c._NAIVE} SELECT split, naive.lang, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS bytes, sum(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT)::BIGINT AS digest FROM naive JOIN documents USING (doc_id) GROUP BY 1, 2""")
def split_contents(spark, sf_dir):
    return summaries.split_contents(c.naive_split(spark, sf_dir), c._documents(spark, sf_dir), "doc_id", "lang", "text")


_BROKEN = f"""{c._NAIVE}, d AS ({_SHA}), q AS (SELECT doc_id FROM d WHERE doc_id % 53 = 0), bs AS (SELECT doc_id, lang, CASE WHEN lang = 'de' AND split = 'test' THEN 'train' ELSE split END AS split FROM naive WHERE doc_id % 41 <> 0 UNION ALL SELECT doc_id, lang, 'test' FROM naive WHERE doc_id % 50 = 0 AND lang <> 'de')"""
_TARGET = "CASE split WHEN 'train' THEN 0.7 ELSE 0.15 END"


@query(
    f"""WITH {_BROKEN}, ev AS (SELECT doc_id FROM bs UNION ALL SELECT doc_id FROM q), sh AS (SELECT split, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM bs GROUP BY 1), cl AS (SELECT lang, split, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) * ({_TARGET})::DOUBLE AS want FROM bs GROUP BY 1, 2),
tw AS (SELECT sha FROM bs JOIN d USING (doc_id) GROUP BY 1 HAVING count(DISTINCT split) > 1), pr AS (SELECT a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b ON a.sha = b.sha AND a.doc_id < b.doc_id)
SELECT 'disjoint' AS rule, (SELECT count(*) FROM (SELECT doc_id FROM bs GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS n
UNION ALL SELECT 'complete', (SELECT count(*) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM ev)) + (SELECT count(*) FROM ev WHERE doc_id NOT IN (SELECT doc_id FROM d))
UNION ALL SELECT 'quarantine', (SELECT count(*) FROM bs WHERE doc_id IN (SELECT doc_id FROM q))
UNION ALL SELECT 'classes', (SELECT count(*) FROM (SELECT split FROM bs GROUP BY 1 HAVING count(DISTINCT lang) < (SELECT count(DISTINCT lang) FROM bs)))
UNION ALL SELECT 'groups', (SELECT count(*) FROM tw) UNION ALL SELECT 'digests', (SELECT count(*) FROM tw)
UNION ALL SELECT 'shares', (SELECT count(*) FROM sh WHERE abs(share - ({_TARGET})::DOUBLE) >= 0.02)
UNION ALL SELECT 'class_shares', (SELECT count(*) FROM cl WHERE abs(n - want) > greatest(6.0, 0.25 * want))
UNION ALL SELECT 'pairs', (SELECT count(*) FROM pr JOIN bs x ON x.doc_id = a JOIN bs y ON y.doc_id = b WHERE x.split <> y.split)"""
)
def broken_split_violations(spark, sf_dir):
    """The rules on a split with planted faults: rows left out, rows twice, a class moved, quarantined rows kept."""
    d = c._documents(spark, sf_dir)
    naive = c.naive_split(spark, sf_dir)
    split = naive.where("doc_id % 41 != 0").withColumn("split", F.when((F.col("lang") == "de") & (F.col("split") == "test"), "train").otherwise(F.col("split")))
    split = split.unionByName(naive.where("doc_id % 50 = 0 and lang != 'de'").withColumn("split", F.lit("test")))
    split = split.join(d.select("doc_id", "sha"), "doc_id")
    return summaries.rule_counts(split, d, d.where("doc_id % 53 = 0"), "doc_id", "lang", "sha")


@query(f"""WITH {c._NAIVE} SELECT 'disjoint' AS rule, (SELECT count(*) FROM (SELECT doc_id FROM naive GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS n UNION ALL SELECT 'complete', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM naive))
UNION ALL SELECT 'groups', (SELECT count(*) FROM (SELECT sha256(text) FROM documents JOIN naive USING (doc_id) GROUP BY 1 HAVING count(DISTINCT split) > 1))""")
def naive_split_rules(spark, sf_dir):
    d = c._documents(spark, sf_dir)
    split = c.naive_split(spark, sf_dir).join(d.select("doc_id", "sha"), "doc_id")
    found = splits.violations(split, d, d.limit(0).select("doc_id"), "doc_id", "lang", "sha", "sha")
    return found.where(F.col("rule").isin("disjoint", "complete", "groups"))


@query(f"""WITH {RELEASES_SQL} SELECT count(*) AS n, count(*) FILTER (new.sha = old.sha) AS equal, count(*) FILTER (new.sha <> old.sha) AS differ, count(*) FILTER (new.sha IS NULL) AS missing FROM old LEFT JOIN new USING (path)""")
def digest_check(spark, sf_dir):
    return summaries.digest_check(*releases(spark, sf_dir), "path", "sha")


@query(r"""SELECT count(*) FILTER (NOT regexp_matches(lower(url), '\.html$')) AS wrong_extension, count(*) FILTER (regexp_matches(lower(url), '(^|[^a-z])(page|post|aug|mask)([^a-z]|$)')) AS derived FROM pages""")
def name_rules(spark, sf_dir):
    return summaries.name_rules(table(spark, sf_dir, "pages"), F.col("url"), "html", "page|post|aug|mask")


@query(
    """SELECT field, value, count(*) AS n FROM (SELECT 'model' AS field, CASE WHEN event_id % 50 NOT IN (0, 1) THEN event_type END AS value FROM events UNION ALL SELECT 'abstained', CASE WHEN event_id % 50 NOT IN (0, 1) THEN CASE WHEN event_id % 4 = 0 THEN 'true' ELSE 'false' END END FROM events
UNION ALL SELECT 'image', CASE WHEN event_id % 50 IN (0, 1, 2) THEN NULL WHEN event_id % 50 = 3 THEN 'blank' ELSE 'hashed' END FROM events UNION ALL SELECT 'top1', CASE WHEN event_id % 50 NOT IN (0, 1) THEN (event_id % 10)::VARCHAR END FROM events) GROUP BY 1, 2"""
)
def nested_histograms(spark, sf_dir):
    kind = "record_type string, image struct<sha256 string>, measurement struct<top1_index int, abstained boolean, device_state struct<device_model string>>"
    r = journal_lines(spark, sf_dir).select(F.from_json("value", kind).alias("r")).where("r.record_type is null")
    sha = F.col("r.image.sha256")
    fields = {"model": F.col("r.measurement.device_state.device_model"), "abstained": F.col("r.measurement.abstained"), "image": F.when(sha == "0", "blank").when(sha.isNotNull(), "hashed"), "top1": F.col("r.measurement.top1_index")}
    return summaries.histograms(r, fields)


_NAMES = {"en": "English", "de": "German", "fr": "French"}


@query(
    """SELECT doc_id, round(n_chars / nullif(doc_id % 7, 0)::DOUBLE, 6) AS aspect_ratio, round((n_chars * (doc_id % 7))::DECIMAL(24, 6) * 0.000001, 4)::DOUBLE AS megapixels, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE '' END AS normalised,
CASE doc_id % 5 - 1 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS class_name, trunc(n_chars / 7.0::DOUBLE)::BIGINT AS middle, trim('  ' || source || ' ') AS maker FROM documents"""
)
def manifest_shapes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    w, h = F.col("n_chars"), F.col("doc_id") % 7
    maker = F.concat(F.lit("\0 "), F.col("source"), F.lit(" \0"))
    return d.select("doc_id", *summaries.shapes(d, w, h, _NAMES, F.col("lang")), summaries.class_of_index((F.col("doc_id") % 5 - 1).cast("int"), ["a", "b", "c"]).alias("class_name"), (w / 7.0).cast("long").alias("middle"), F.trim(maker, F.lit("\0 ")).alias("maker"))


@query("""SELECT lang, doc_id || '.TXT' AS filename, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END AS size, sha256(doc_id::VARCHAR) AS sha256 FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT lang, doc_id || '.TXT', n_chars + 1, sha256(doc_id::VARCHAR) FROM documents WHERE doc_id % 3 = 0""")
def folder_listing(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    sha = F.upper(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256))
    item = F.struct(F.concat(F.col("doc_id").cast("string"), F.lit(".TXT")).alias("filename"), F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("size"), F.struct((F.col("n_chars") + 1).alias("size"), sha.alias("sha256_hash")).alias("content_details"))
    pages_of = d.groupBy("lang", (F.col("doc_id") / 500).cast("int").alias("page")).agg(F.to_json(F.collect_list(item)).alias("body"))  # 500 files a page
    return summaries.listing(pages_of.drop("page"), "body")


@query(
    """WITH v AS (SELECT vec_id, i, greatest(embedding[i + 1]::DOUBLE, 0) AS v, (i // 8 BETWEEN 2 AND 5) AND (i % 8 BETWEEN 2 AND 5) AS inner_ FROM embeddings, (SELECT unnest(range(64)) AS i)),
m AS (SELECT vec_id, coalesce(sum(CASE WHEN inner_ THEN 0 ELSE v END) / nullif(sum(v), 0), 0) AS mass FROM v GROUP BY 1) SELECT mass > 0.75 AS warned, count(*) AS n FROM m GROUP BY 1"""
)
def peripheral_warnings(spark, sf_dir):
    mass = fn.peripheral_mass(F.transform("embedding", lambda x: x.cast("double")), 8, 2)
    return table(spark, sf_dir, "embeddings").select((mass > 0.75).alias("warned")).groupBy("warned").agg(F.count("*").alias("n"))


@query(f"""{c._REACH}, k AS (SELECT id, min(other) AS component FROM r GROUP BY id), g AS (SELECT component, count(*) AS size FROM k GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY size DESC, component) AS g FROM g)
SELECT id, 'G' || lpad(g::VARCHAR, 5, '0') AS group_id, size FROM k JOIN o USING (component)""")
def duplicate_groups(spark, sf_dir):
    return dedup.group_numbers(c.duplicate_components(spark, sf_dir))


@query(f"""WITH {preds_sql()}, top8 AS (SELECT * FROM top WHERE y_true < 8), {c._PRF.format("8")} SELECT count(*) AS classes, round(avg(f1), 6) AS macro_all, round(avg(f1) FILTER (support > 0), 6) AS macro_present FROM prf8""")
def macro_over_all(spark, sf_dir):
    """Two classes are predicted only: the mean over all classes counts them as 0."""
    cm = metrics.confusion(metrics.judged(preds(spark, sf_dir)).where("y_true < 8"))
    every, present = (metrics.headline(cm, average=a).select(F.col("macro_f1").alias(n)) for a, n in (("all", "macro_all"), ("present", "macro_present")))
    one_row = metrics.per_class(cm).agg(F.count("*").alias("classes"))
    return rounded(one_row.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(present)))  # one row each


_GOOD = "WITH g AS (SELECT * FROM events WHERE event_id % 50 NOT IN (0, 1, 2, 3))"


@query(f"""{_GOOD} SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS device, count(*) AS n, count(*) FILTER (event_id % 4 = 0) AS n_abstained, round(avg(value), 6) AS latency_mean FROM g GROUP BY 1, 2""")
def journal_windows(spark, sf_dir):
    rows = c._streamed(spark, sf_dir, lambda r: journal.windowed(r.where("image.sha256 != '0'")))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "device", "n", "n_abstained", "latency_mean")


@query(
    f"""{_GOOD}, s AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens, event_id FROM g),
k AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id::VARCHAR AS session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM k GROUP BY user_id, k"""
)
def journal_sessions(spark, sf_dir):
    rows = c._streamed(spark, sf_dir, lambda r: journal.sessions(r.where("image.sha256 != '0'")))
    return rows.select("session_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query(f"""{_GOOD} SELECT event_id::VARCHAR AS record_id, ['correct', 'incorrect', 'unsure'][event_id % 3 + 1] AS verdict FROM g WHERE event_id % 7 = 0""")
def journal_verdicts(spark, sf_dir):
    """Records and their verdicts; those still waiting for one when the stream ends are not given."""
    rows = c._streamed(spark, sf_dir, lambda r: journal.folded(r.where("record_type is not null or image.sha256 != '0'")), "append")
    return rows.where("verdict is not null").select("record_id", "verdict")


@query(
    f"""{_GOOD} SELECT event_id::VARCHAR AS record_id, CASE WHEN event_id % 21 = 0 THEN 'unsure' WHEN event_id % 7 = 0 THEN ['correct', 'incorrect', 'unsure'][event_id % 3 + 1] END AS verdict,
CASE WHEN event_id % 21 = 0 OR event_id % 14 = 0 THEN 'expert' WHEN event_id % 7 = 0 THEN 'lay' END AS expertise FROM g"""
)
def journal_latest_verdicts(spark, sf_dir):
    """Every record with its latest verdict by event time, kept as state: more verdicts, older ones and newer ones, are appended to the journal."""
    from lakeproof.streaming import verdicts

    e = table(spark, sf_dir, "events")
    event = lambda rows, v, who, after: rows.select(F.col("event_id").alias("record_id"), F.lit(v).alias("verdict"), F.lit(who).alias("expertise"), (F.col("ts") + F.expr(f"interval {after}")).alias("annotated_at"))
    more = event(e.where("event_id % 14 = 0"), "incorrect", "lay", "30 minutes").unionByName(event(e.where("event_id % 21 = 0"), "unsure", "expert", "2 hours"))
    good = lambda r: r.where("record_type is not null or image.sha256 != '0'")
    rows = c._streamed(spark, sf_dir, lambda r: verdicts.latest_verdicts(good(r)), "append", lambda path: verdicts.append_verdicts(more, path))
    return verdicts.current(rows.where("timestamp_utc is not null")).select("record_id", "verdict", "expertise")
