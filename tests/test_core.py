"""Sources, sinks, splits and streams on small data."""

import io
import shutil
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakeproof.functions import scalars
from lakeproof.operators import dedup, fieldlog, policy, records, selection, splits
from lakeproof.sources import files

ROOT = Path(__file__).resolve().parents[1]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("path,n\na.jpg,1\nb.jpg,\na.jpg,3\n")
    rows = {r.path: r.n for r in files.read_keyed_csv(spark, str(tmp_path / "a.csv"), "path string, n int", "path").collect()}
    assert rows == {"a.jpg": 3, "b.jpg": None}


def test_files(spark, tmp_path):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x05\x00\x07" + b"\0" * 12 + b"\xff\xd9"
    (tmp_path / "in/x").mkdir(parents=True)
    (tmp_path / "in/x/a.jpg").write_bytes(jpeg)
    (tmp_path / "in/b.jpg").write_bytes(b"no")
    tree = files.read_tree(spark, f"file:{tmp_path}/in")
    assert {r.relative_path: r.size_bytes for r in tree.collect()} == {"x/a.jpg": len(jpeg), "b.jpg": 2}
    assert {tuple(r) for r in files.jpeg_facts(tree).collect()} == {("x/a.jpg", True, 7, 5), ("b.jpg", False, None, None)}
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as out:
        out.writestr("d/one.txt", "1")
    (tmp_path / "z.zip").write_bytes(z.getvalue())
    assert [(r.relative_path, bytes(r.content)) for r in files.read_archives(spark, str(tmp_path / "z.zip")).collect()] == [("d/one.txt", b"1")]
    assert files.read_optional(spark, str(tmp_path / "none"), "a int").count() == 0


def test_runs_and_tables(spark, tmp_path):
    for name, done in (("r1", True), ("r2", False)):
        (tmp_path / "runs" / name).mkdir(parents=True)
        if done:
            (tmp_path / "runs" / name / "train_config.json").write_text('{"backbone": "net",\n "seed": 42}')
    assert [(r.run, r.seed) for r in files.read_runs(spark, str(tmp_path / "runs"), "backbone string, seed int").collect()] == [("r1", 42)]
    rows = spark.createDataFrame([(1, "a")], "n int, s string")
    files.write_table(rows, str(tmp_path / "t"), ["s", "n"])
    files.write_table(rows.limit(0), str(tmp_path / "t"), mode="ignore")
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["s", "n"]
    assert files.digest(rows, "n").first().fingerprint == files.digest(rows.repartition(3), "n").first().fingerprint


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.trailing_number(F.lit("a/IMG_0042.JPG")).alias("n"),
        scalars.trailing_number(F.lit("a/b.jpg")).alias("none"),
        scalars.argmax(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4))).alias("top"),
        F.sha2(F.lit(b"a"), 256).alias("sha"),
        scalars.angle(F.lit(-90)).alias("angle"),
        scalars.celsius(F.lit(38500)).alias("heat"),
        scalars.hamming(scalars.hex_words(F.lit("f" * 64)), scalars.hex_words(F.lit("0" * 64))).alias("bits"),
    ).first()
    assert (row.n, row.none, row.top, row.angle, row.heat, row.bits) == (42, None, 1, 270, 38.5, 256)
    assert row.sha.startswith("ca978112ca1bbdca")


def test_components_and_paths(spark):
    v = spark.range(6).select(F.col("id"))
    e = spark.createDataFrame([(4, 3), (3, 1), (5, 0)], "a long, b long")
    assert {r.id: r.component for r in dedup.components(v, e).collect()} == {0: 0, 1: 1, 2: 2, 3: 1, 4: 1, 5: 0}
    folders = spark.createDataFrame([(1, None, "r"), (2, 1, "a"), (3, 2, "b"), (8, 9, "x"), (9, 8, "y")], "id long, up long, name string")
    paths = {r.id: r.path for r in records.folder_paths(folders, "id", "up", "name").collect()}
    assert paths[3] == "r/a/b" and paths[1] == "r" and set(paths) == {1, 2, 3, 8, 9}


def test_splits(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], f"g{i // 4 * 2 + i % 2}", f"h{i}") for i in range(400)], "k long, label string, grp string, sha string")
    bad = splits.quarantined(rows, "k", "label", "grp")
    split = splits.group_split(rows, "k", "label", "grp")
    assert bad.count() == 0 and all(r.n == 0 for r in splits.violations(split, rows, bad, "k", "label", "grp", "sha").collect())


def test_policy(spark):
    curve = spark.createDataFrame([(0.0, 1.0, 0.3), (0.5, 0.8, 0.1), (0.9, 0.2, 0.0)], "threshold double, coverage double, risk double")
    assert tuple(policy.pick_threshold(curve, 0.05, 0.7).first()) == (0.5, "least_risk")
    assert tuple(policy.pick_threshold(curve, 0.2, 0.7).first()) == (0.5, "feasible")
    assert tuple(policy.pick_threshold(curve.limit(0)).first()) == (0.0, "disabled")


def test_device_facts(spark):
    text = "MemTotal:        7243776 kB\nprocessor : 0\nprocessor : 1\ntemperature: 41500"
    row = selection.device_facts(spark.createDataFrame([(text,), ("",)], "value string")).collect()
    assert (row[0].mem_total_gb, row[0].cores, row[0].degrees) == (6.91, 2, 41.5) and row[1].mem_total_gb is None


def test_journal(spark):
    lines = ['{"record_id": "1", "image": {"sha256": "x"}}', '{"record_id"', "", '{"record_id": "2"}', '{"record_type": "annotation_update", "record_id": "1", "annotation": {"verdict": "correct", "annotated_at_utc": "2024-01-01T00:00:00Z"}}']
    rows = fieldlog.parse(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(r.reason or "good" for r in rows.collect()) == ["bad_json", "good", "good", "no_image"]
    assert fieldlog.fold(rows.where("reason is null")).first().annotation.verdict == "correct"


def test_without_training_data_operators(tmp_path):
    """The rest imports, and its tests are found and pass, with that subpackage and its tests removed or never there."""
    for name in ("lakeproof", "tests", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    for name in ("lakeproof/llm", "tests/llm"):
        shutil.rmtree(tmp_path / name, ignore_errors=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') and x[2].isdigit() for x in q); e.oracle_sql()"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    said = subprocess.run([sys.executable, "-m", "pytest", "tests/test_core.py", "-q", "-k", "csv or scalars or files"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stdout
    said = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stdout


def test_crossing_pairs(spark):
    """Pairs counted from sizes are those that forming them gives, also with keys that stand twice and null groups."""
    rows = [(i, None if i % 7 == 0 else f"g{i % 4}") for i in range(40)]
    split = [(i, ("train", "test", "validation")[i * i % 5 % 3]) for i in range(38)] + [(i, "test") for i in range(0, 38, 3)]
    groups = dict(rows)
    want = sum(groups[a] == groups[b] is not None and a != b and s != t for n, (a, s) in enumerate(split) for b, t in split[:n])
    got = splits.crossing_pairs(spark.createDataFrame(split, "k long, split string"), spark.createDataFrame(rows, "k long, g string"), "k", "g")
    assert got.first().n == want > 0
    assert splits.crossing_pairs(spark.createDataFrame([], "k long, split string"), spark.createDataFrame(rows, "k long, g string"), "k", "g").first().n == 0


def test_deep_folders(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None, f"f{i}") for i in range(5)], "id long, up long, name string")
    assert {r.id: r.path for r in records.folder_paths(chain, "id", "up", "name").collect()}[4] == "f0/f1/f2/f3/f4"
    with pytest.raises(ValueError):
        records.folder_paths(chain, "id", "up", "name", depth=2)
