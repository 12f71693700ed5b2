"""Relations that stand in for predictions, hashes, releases and journals, derived from the driver's tables.

Each has a DuckDB text beside it, which computes the same from the same numbers (the first 32 bits of an MD5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeproof.functions.scalars import softmax, unit_number
from lakeproof.session import ship

CLASSES = 10
SEEDS = (42, 123, 2026)
GAINS = {"large": 1.8, "medium": 1.6, "small": 1.3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _probs(gain: float, seed: int) -> Column:
    logit = lambda c: F.lit(gain) * (F.col("y_true") == c).cast("double") + 4.0 * unit_number(F.concat_ws(":", F.col("test_index").cast("string"), F.lit(str(c)), F.lit(str(seed))))
    return softmax(F.array(*[logit(c) for c in range(CLASSES)]))


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("test_index"), F.col("label").alias("y_true"))


def preds(spark: SparkSession, sf_dir: str, gain: float = 1.6, seed: int = 42) -> DataFrame:
    """``test_index, y_true, probs``."""
    return _tested(spark, sf_dir).select("test_index", "y_true", _probs(gain, seed).alias("probs"))


def many_preds(spark: SparkSession, sf_dir: str, runs: list[tuple[tuple, float, int]], names: tuple[str, ...]) -> DataFrame:
    """``test_index, y_true, probs`` of many runs (values of ``names``, gain, seed) from one scan of the table."""
    each = [F.struct(*[F.lit(v).alias(c) for c, v in zip(names, values)], _probs(gain, seed).alias("probs")) for values, gain, seed in runs]
    rows = _tested(spark, sf_dir).select("test_index", "y_true", F.explode(F.array(*each)).alias("run"))
    return rows.select("test_index", "y_true", *[F.col(f"run.{c}").alias(c) for c in (*names, "probs")])


def preds_sql(gain: float = 1.6, seed: int = 42, name: str = "") -> str:
    """CTEs ``p`` (test_index, y_true, c, p) and ``top`` (conf, y_pred, correct), their names followed by ``name``."""
    return f"""z{name} AS (SELECT vec_id AS test_index, label AS y_true, c, {gain} * (CASE WHEN c = label THEN 1.0::DOUBLE ELSE 0.0 END) + 4.0::DOUBLE * (('0x' || substr(md5(vec_id || ':' || c || ':{seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE) AS z FROM embeddings, (SELECT unnest(range({CLASSES})) AS c)),
e{name} AS (SELECT *, exp(z - max(z) OVER (PARTITION BY test_index)) AS ez FROM z{name}),
p{name} AS (SELECT test_index, y_true, c, ez / sum(ez) OVER (PARTITION BY test_index) AS p FROM e{name}),
top{name} AS (SELECT test_index, any_value(y_true) AS y_true, max(p) AS conf, arg_max(c, p) AS y_pred, (arg_max(c, p) = any_value(y_true))::INT AS correct FROM p{name} GROUP BY test_index)"""


def releases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two releases of documents as ``path, sha``: the new one lacks every 97th, changes every 89th and adds every 101st again."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    old = d.where("doc_id % 103 != 0").select("path", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    new = d.where("doc_id % 97 != 0").select("path", F.sha2(F.concat("text", F.when(F.col("doc_id") % 89 == 0, "!").otherwise("")).cast("binary"), 256).alias("sha"))
    return old, new


RELEASES_SQL = """d AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS path, text FROM documents),
old AS (SELECT path, sha256(text) AS sha FROM d WHERE doc_id % 103 != 0),
new AS (SELECT path, sha256(text || CASE WHEN doc_id % 89 = 0 THEN '!' ELSE '' END) AS sha FROM d WHERE doc_id % 97 != 0)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, vec_id, label, width, pixels, digest``: an 8 x 8 grey image of each embedding, a second shot of every third
    (a little darker, with a fixed unevenness) and a copy of every seventh."""
    e = table(spark, sf_dir, "embeddings")
    pixels = F.transform("embedding", lambda x: 128 + 200 * x.cast("double"))
    again = F.transform(pixels, lambda v, i: 0.97 * v + 1.5 * ((i * 37 + F.col("vec_id") * 11) % 13 - 6))
    shot = lambda rows, k, px: rows.select((F.col("vec_id") * 3 + k).alias("image_id"), "vec_id", "label", F.lit(8).alias("width"), px.alias("pixels"))
    rows = shot(e, 0, pixels).unionByName(shot(e.where("vec_id % 3 = 0"), 1, again)).unionByName(shot(e.where("vec_id % 7 = 0"), 2, pixels))
    return rows.withColumn("digest", F.md5(F.array_join(F.transform("pixels", lambda v: F.round(v, 3).cast("decimal(12,3)").cast("string")), ",").cast("binary")))


def scenes(spark: SparkSession, sf_dir: str, side: int = 32) -> DataFrame:
    """``vec_id, width, pixels``: colour images of a textured disc with a hole before a light backdrop. Every fifth backdrop is
    saturated, every seventh disc is cut by the border, every eleventh image has none. A place without a value is white. They are drawn by
    batches with numpy, since an expression over 3,072 places a row cost more than the corruptions."""
    y, x, c = np.indices((side, side, 3)).reshape(3, -1)
    k, cell = np.arange(side * side * 3), (y // 4 * 8 + x // 4) % 64
    by = lambda c, *values: np.array(values, float)[c]
    own, pale, vivid = by(c, 60, 130, 45), by(c, 236, 233, 228), by(c, 190, 120, 40)

    def drawn(v: np.ndarray, embedding: np.ndarray) -> np.ndarray:
        cx, cy, r = np.where(np.fmod(v, 7) == 0, 1, 11 + np.fmod(v, 9)), 12 + np.fmod(v, 8), 5 + np.fmod(v, 4)
        d = (x - cx) ** 2 + (y - cy) ** 2
        inside = (d <= r * r) & (d > 2) & (np.fmod(v, 11) != 0)
        back = np.where(np.fmod(v, 5) == 0, vivid, pale) + np.fmod(k * 37 + v * 11, 7)
        value = np.where(inside, own + 60 * embedding[:, cell], back)
        return np.floor(np.clip(np.where(np.isnan(value), 255, value), 0, 255))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.arange(64)
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            none, number = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy().astype(np.int64)
            sizes, starts = lists.value_lengths().fill_null(0).to_numpy(), lists.offsets.to_numpy()[:-1]
            values = np.append(lists.values.to_numpy(zero_copy_only=False).astype(float), np.nan)
            for i in range(0, len(batch), 128):
                part = slice(i, i + 128)
                at = np.where(places < sizes[part, None], starts[part, None] + places, len(values) - 1)
                pixels = drawn(number[part, None], values[at])
                pixels[none[part]] = 255
                ends = pa.array(np.arange(len(pixels) + 1) * pixels.shape[1], pa.int32())
                drawings = pa.ListArray.from_arrays(ends, pa.array(pixels.ravel()))
                yield pa.RecordBatch.from_pydict({"vec_id": ids[part], "width": pa.array(np.full(len(pixels), side), pa.int32()), "pixels": drawings})

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, f"vec_id {dict(rows.dtypes)['vec_id']}, width int, pixels array<double>")


#: CTE ``im``: image_id, vec_id, copy (the row that it equals), y, x, v.
IMAGES_SQL = """im AS (SELECT vec_id * 3 + k AS image_id, vec_id, label, CASE WHEN k = 2 THEN vec_id * 3 ELSE vec_id * 3 + k END AS same, i // 8 AS y, i % 8 AS x,
CASE WHEN k = 1 THEN 0.97::DOUBLE * (128 + 200 * embedding[i + 1]::DOUBLE) + 1.5::DOUBLE * ((i * 37 + vec_id * 11) % 13 - 6) ELSE 128 + 200 * embedding[i + 1]::DOUBLE END AS v
FROM embeddings, (SELECT unnest(range(3)) AS k), (SELECT unnest(range(64)) AS i) WHERE k = 0 OR (k = 1 AND vec_id % 3 = 0) OR (k = 2 AND vec_id % 7 = 0))"""


def resampling_sql(name: str, to: int) -> str:
    """CTE ``name``: weights ``w`` of input sample ``j`` (of 8) in output sample ``i`` of ``to``, bilinear at half-pixel centres, ends held."""
    return f"""{name} AS (SELECT i, j, CASE WHEN greatest(floor(s), 0) = j THEN 1 - (s - floor(s)) ELSE 0 END + CASE WHEN least(floor(s) + 1, 7) = j THEN s - floor(s) ELSE 0 END AS w
FROM (SELECT i, (i + 0.5::DOUBLE) * 8 / {to}.0::DOUBLE - 0.5::DOUBLE AS s FROM (SELECT unnest(range({to})) AS i)), (SELECT unnest(range(8)) AS j))"""


def journal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal of events with planted defects by ``event_id % 50``, and verdicts on every seventh."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 50
    sha = F.md5(F.col("event_id").cast("string").cast("binary"))
    record = F.struct(
        F.col("event_id").cast("string").alias("record_id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("ts").alias("timestamp_utc"),
        F.when(k != 2, F.struct(F.concat(F.col("event_id").cast("string"), F.lit(".jpg")).alias("file"), F.when(k == 3, "0").otherwise(sha).alias("sha256"))).alias("image"),
        F.struct(
            (F.col("event_id") % 10).cast("int").alias("top1_index"),
            F.lit(0.5).alias("top1_confidence_calibrated"),
            (F.col("event_id") % 4 == 0).alias("abstained"),
            F.struct(F.col("value").alias("end_to_end")).alias("latency_ms"),
            F.struct(F.col("event_type").alias("device_model")).alias("device_state"),
        ).alias("measurement"),
        F.struct((F.col("event_id") % 10 != 4).alias("research_use_granted")).alias("consent"),
    )
    lines = e.select(F.when(k == 0, "").when(k == 1, '{"record_id": ').otherwise(F.to_json(record)).alias("value"))
    verdict = F.struct(
        F.lit("annotation_update").alias("record_type"),
        F.col("event_id").cast("string").alias("record_id"),
        F.struct(
            F.element_at(F.array(F.lit("correct"), F.lit("incorrect"), F.lit("unsure")), (F.col("event_id") % 3 + 1).cast("int")).alias("verdict"), F.when(F.col("event_id") % 14 == 0, "expert").otherwise("lay").alias("annotator_expertise"), (F.col("ts") + F.expr("interval 1 hour")).alias("annotated_at_utc")
        ).alias("annotation"),
    )
    return lines.unionByName(e.where("event_id % 7 = 0").select(F.to_json(verdict).alias("value")))


def journal_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that exist: all but every fifth of the defect class 5."""
    e = table(spark, sf_dir, "events").where("event_id % 50 != 5")
    return e.select(F.concat(F.col("event_id").cast("string"), F.lit(".jpg")).alias("file"), F.md5(F.col("event_id").cast("string").cast("binary")).alias("sha256"))


def field_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field journal of events with all that a record may hold; every field is absent somewhere."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    pick = lambda k, *names: F.element_at(F.array(*map(F.lit, names)), (i % k % len(names) + 1).cast("int"))
    record = F.struct(
        i.cast("string").alias("record_id"),
        F.struct(F.lit("x").alias("file"), F.lit("y").alias("sha256")).alias("image"),
        F.struct(
            (i % 12 - 1).cast("int").alias("top1_index"),
            F.when(i % 9 != 0, (i % 101) / 101).alias("top1_confidence_calibrated"),
            F.when(i % 2 == 0, F.col("value") / 100).alias("predictive_entropy"),
            F.when(i % 8 != 3, i % 4 == 0).alias("abstained"),
            F.struct(F.col("value").alias("end_to_end"), F.when(i % 3 == 0, F.col("value") / 3).alias("inference")).alias("latency_ms"),
            F.when(i % 6 != 0, F.struct(pick(4, "cpu", "gpu").alias("delegate"))).alias("runtime"),
            F.struct(pick(3, "int8", "float16", "float32").alias("variant"), F.array(*[F.lit(f"c{k}") for k in range(10)]).alias("class_order")).alias("model"),
            F.struct(F.col("event_type").alias("device_model")).alias("device_state"),
        ).alias("measurement"),
        F.when(i % 5 != 0, F.struct(pick(7, "hand", "ground", "paper").alias("background"))).alias("context"),
        F.when(i % 7 == 0, F.struct(pick(21, "correct", "incorrect", "unsure", "odd").alias("verdict"), F.when(i % 14 == 0, "expert").otherwise("lay").alias("annotator_expertise"), F.concat(F.lit("c"), (i % 10).cast("string")).alias("claimed_true_class"))).alias("annotation"),
        F.when(i % 11 == 0, F.struct((i % 22 == 0).alias("verified"), F.concat(F.lit("c"), (i % 6).cast("string")).alias("expert_class"), pick(33, "agronomist", "pathologist").alias("expert_role"))).alias("expert_verification"),
        F.struct((i % 10 != 4).alias("research_use_granted")).alias("consent"),
    )
    return e.select(F.to_json(record).alias("value"))


#: CTEs of the same records: ``fa`` all of them, ``fc`` the consenting ones.
FIELD_SQL = """fa AS (SELECT event_id AS i, event_type, value::DOUBLE AS value, event_id % 12 - 1 AS top, CASE WHEN event_id % 9 <> 0 THEN (event_id % 101) / 101.0::DOUBLE END AS confidence, CASE WHEN event_id % 2 = 0 THEN value::DOUBLE / 100 END AS entropy,
coalesce(event_id % 8 <> 3 AND event_id % 4 = 0, false) AS abstained, CASE WHEN event_id % 3 = 0 THEN value::DOUBLE / 3 END AS inference, CASE WHEN event_id % 6 <> 0 THEN ['cpu', 'gpu'][event_id % 4 % 2 + 1] END AS delegate, ['int8', 'float16', 'float32'][event_id % 3 + 1] AS variant,
CASE WHEN event_id % 5 <> 0 THEN ['hand', 'ground', 'paper'][event_id % 7 % 3 + 1] END AS background, CASE WHEN event_id % 7 = 0 THEN ['correct', 'incorrect', 'unsure', 'odd'][event_id % 21 % 4 + 1] END AS verdict, CASE WHEN event_id % 14 = 0 THEN 'expert' WHEN event_id % 7 = 0 THEN 'lay' END AS expertise,
CASE WHEN event_id % 7 = 0 THEN 'c' || event_id % 10 END AS claimed, event_id % 22 = 0 AS verified, 'c' || event_id % 6 AS expert_class, ['agronomist', 'pathologist'][event_id % 33 % 2 + 1] AS role FROM events), fc AS (SELECT * FROM fa WHERE i % 10 <> 4)"""
