"""Places over a whole table, numbered range by range."""

from pyspark.sql import functions as F

from lakeproof.operators import dedup


def test_places_over_several_ranges(spark):
    rows = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("id"), (F.col("id") % 3).alias("size"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = dedup.numbered(rows, [F.desc("size"), F.col("id")], "place").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [r.place for r in sorted(got, key=lambda r: (-r.size, r.id))] == list(range(1, 5001))


def test_no_rows_and_groups_of_one(spark):
    assert dedup.numbered(spark.range(0), [F.col("id")], "place").count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 4)], "id int, component int")
    assert {r.id: (r.group_id, r.size) for r in dedup.group_numbers(labels).collect()} == {1: ("G00002", 1), 2: ("G00001", 2), 3: ("G00001", 2), 4: ("G00003", 1)}
