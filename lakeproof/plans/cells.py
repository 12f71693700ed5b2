"""Registered queries of map, pixel, sensor and quantisation expressions, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeproof.functions import scalars as fn
from lakeproof.operators import images, selection
from lakeproof.plans import catalog as c
from lakeproof.plans.fixtures import preds, preds_sql, table

query, rounded = c.query, c._rounded


def _cells(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("cells"))


@query(
    """WITH c AS (SELECT vec_id, i, embedding[i * 4 + vec_id % 4 + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(16)) AS i)), k AS (SELECT vec_id, max(v) AS peak FROM c GROUP BY 1),
m AS (SELECT vec_id, list(CASE WHEN peak <= 0 THEN 0 ELSE greatest(v, 0) / peak END ORDER BY i) AS l FROM c JOIN k USING (vec_id) GROUP BY 1),
g AS (SELECT o, p - floor(p) AS f, floor(p)::INT AS a, least(floor(p)::INT + 1, 3) AS b FROM (SELECT o, least(greatest((o + 0.5::DOUBLE) / 2 - 0.5::DOUBLE, 0), 3) AS p FROM (SELECT unnest(range(8)) AS o)))
SELECT vec_id, (y.o * 8 + x.o)::INT AS cell, round((l[y.a * 4 + x.a + 1] * (1 - x.f) + l[y.a * 4 + x.b + 1] * x.f) * (1 - y.f) + (l[y.b * 4 + x.a + 1] * (1 - x.f) + l[y.b * 4 + x.b + 1] * x.f) * y.f, 6) AS value FROM m, g y, g x"""
)
def upsampled_maps(spark, sf_dir):
    own = images.extract_map(F.col("cells"), 4, F.col("vec_id") % 4)
    maps = _cells(spark, sf_dir).select("vec_id", fn.peak_normalised(own).alias("cells"))
    return rounded(maps.select("vec_id", F.posexplode(images.upsample(F.col("cells"), 4, 8)).alias("cell", "value")))


@query(
    """WITH s AS (SELECT vec_id, vec_id % 5 AS r, (vec_id // 5) % 5 AS q, CASE WHEN vec_id % 7 = 0 THEN 6 ELSE vec_id % 4 - 1 END AS s, embedding FROM embeddings),
c AS (SELECT vec_id, i, greatest(embedding[i + 1]::DOUBLE, 0) AS v, i // 8 >= r AND i // 8 <= r + s AND i % 8 >= q AND i % 8 <= q + s AS m, i // 8 IN (0, 7) OR i % 8 IN (0, 7) AS e FROM s, (SELECT unnest(range(64)) AS i)),
g AS (SELECT vec_id, sum(v) AS total, sum(CASE WHEN m THEN v ELSE 0 END) AS mass, avg(m::INT) AS area, bool_or(m AND e) AS border, list(m ORDER BY v DESC, i)[1] AS peak FROM c GROUP BY 1)
SELECT vec_id, round(coalesce(mass / nullif(total, 0), 0), 6) AS mass_on_mask, round(area, 6) AS area, round(CASE WHEN area > 0 THEN coalesce(mass / nullif(total, 0), 0) / area END, 6) AS concentration, peak AS peak_on_mask, border AS touches_border, area < 0.02 OR area > 0.45 OR border AS flagged FROM g"""
)
def mask_concentration(spark, sf_dir):
    v = F.col("vec_id")
    r, q, s = v % 5, F.floor(v / 5) % 5, F.when(v % 7 == 0, 6).otherwise(v % 4 - 1)
    inside = lambda i: F.floor(i / 8).between(r, r + s) & (i % 8).between(q, q + s)
    mask = F.transform(F.sequence(F.lit(0), F.lit(63)), inside)
    rows = _cells(spark, sf_dir).select("vec_id", F.transform("cells", lambda x: F.greatest(x, F.lit(0.0))).alias("cells"), mask.alias("mask"))
    rows = rows.select("vec_id", *[x.alias(n) for n, x in images.on_mask(F.col("cells"), F.col("mask")).items()], images.touches_border(F.col("mask"), 8).alias("touches_border"))
    return rounded(rows.withColumn("flagged", images.mask_flagged(F.col("area"), F.col("touches_border"))))


@query(
    f"""WITH {preds_sql()}, q AS (SELECT test_index, list((greatest(least(round_even(p * 256, 0) - 128, 127), -128) + 128) / 256.0::DOUBLE ORDER BY c) AS d FROM p GROUP BY 1),
s AS (SELECT test_index, d, abs(list_sum(d) - 1) > 0.01 AS guarded, list_sum(list_transform(d, lambda x: exp(x))) AS z FROM q)
SELECT test_index, guarded, (list_position(d, list_max(d)) - 1)::INT AS y_pred, round(CASE WHEN guarded THEN exp(list_max(d)) / z ELSE list_max(d) END, 6) AS conf FROM s"""
)
def quantised_probabilities(spark, sf_dir):
    back = fn.dequantised(fn.quantised(F.col("probs"), 1 / 256, -128), 1 / 256, -128)
    rows = preds(spark, sf_dir).select("test_index", back.alias("back"))
    rows = rows.select("test_index", fn.sums_to_one(F.col("back")).alias("sums"), fn.guarded_probs(F.col("back")).alias("probs"))
    return rounded(rows.select("test_index", (~F.col("sums")).alias("guarded"), fn.argmax(F.col("probs")).alias("y_pred"), F.array_max("probs").alias("conf")))


@query(
    f"""WITH {preds_sql()}, t AS (SELECT *, [0.0, 1.0, 0.5, -2.0, 3.0][test_index % 5 + 1]::DOUBLE AS t FROM p), l AS (SELECT *, ln(greatest(least(p, 1), 1e-12)) / CASE WHEN t <= 0 THEN 1 ELSE t END AS z FROM t),
w AS (SELECT *, exp(z - max(z) OVER (PARTITION BY test_index)) AS ez FROM l) SELECT test_index, c::INT AS cls, round(ez / sum(ez) OVER (PARTITION BY test_index), 6) AS p FROM w"""
)
def device_temperature(spark, sf_dir):
    """Temperatures of 0 or less change nothing."""
    temperature = F.get(F.array(*[F.lit(x) for x in (0.0, 1.0, 0.5, -2.0, 3.0)]), (F.col("test_index") % 5).cast("int"))
    scaled = fn.softmax(fn.logits_of(F.col("probs")), temperature)
    return rounded(preds(spark, sf_dir).select("test_index", F.posexplode(scaled).alias("cls", "p")))


@query(
    """WITH e AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS argb, (event_id * 7919) % 90000 - 45000 AS raw, (event_id * 37) % 1440 - 720 AS turn FROM events)
SELECT event_id, (argb >> 16) & 255 AS red, (argb >> 8) & 255 AS green, argb & 255 AS blue, round(CASE WHEN abs(raw) > 1000 THEN raw / 1000.0::DOUBLE ELSE raw END, 6)::DOUBLE AS celsius,
((turn % 360) + 360) % 360 AS turn, CASE event_id % 10 WHEN 3 THEN 180 WHEN 6 THEN 90 WHEN 8 THEN 270 ELSE 0 END::INT AS exif FROM e"""
)
def sensor_units(spark, sf_dir):
    e = F.col("event_id").cast("long")
    argb = (e * 2654435761) % 4294967296
    rows = table(spark, sf_dir, "events").select("event_id", fn.channels(argb).alias("rgb"), fn.celsius((e * 7919) % 90000 - 45000).cast("double").alias("celsius"), fn.angle((e * 37) % 1440 - 720).alias("turn"), fn.exif_degrees(e % 10).alias("exif"))
    return rounded(rows.select("event_id", *[F.get("rgb", F.lit(i)).alias(n) for i, n in enumerate(("red", "green", "blue"))], "celsius", "turn", "exif"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN round((c_custkey * 1000003 % 16777216) / 1024.0::DOUBLE / 1024.0::DOUBLE, 2) END AS mem_total_gb, (c_custkey % 9)::INT AS cores,
CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN (c_custkey % 60) / 1.0::DOUBLE ELSE (1001 + c_custkey % 60000) / 1000.0::DOUBLE END AS degrees FROM customer"""
)
def device_reports(spark, sf_dir):
    k = F.col("c_custkey").cast("long")
    said = lambda when, *parts: F.when(when, F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts]))
    report = F.concat_ws(
        "\n",
        said(k % 5 != 0, "MemTotal:   ", (k * 1000003 % 16777216).cast("string"), " kB"),
        F.repeat(F.lit("processor\t: 1\n"), (k % 9).cast("int")),
        said(k % 3 == 1, "temperature: ", (k % 60).cast("string")),
        said(k % 3 == 2, "temperature: ", (1001 + k % 60000).cast("string")),
    )
    lines = table(spark, sf_dir, "customer").select("c_custkey", report.alias("value"))
    return rounded(selection.device_facts(lines).drop("value").withColumn("cores", F.col("cores").cast("int")))


@query(
    """WITH x AS ((SELECT doc_id, 'low' AS part FROM documents ORDER BY n_chars, doc_id LIMIT 3) UNION ALL (SELECT doc_id, 'high' FROM documents ORDER BY n_chars DESC, doc_id LIMIT 3))
SELECT doc_id, part FROM x UNION ALL (SELECT doc_id, 'random' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM x) ORDER BY ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT, doc_id LIMIT 18)"""
)
def extremes_and_random(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    ends = selection.extremes(d, "n_chars", "doc_id").select("doc_id", F.col("end").alias("part"))
    rest = d.select("doc_id").join(F.broadcast(ends), "doc_id", "left_anti")  # six rows
    return ends.unionByName(selection.sample(rest, "doc_id", 18).select("doc_id", F.lit("random").alias("part")))
