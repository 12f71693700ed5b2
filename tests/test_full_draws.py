"""Bootstraps of 2000 draws against brute force; the grid of 400 points."""

import collections
import hashlib

import numpy as np

from lakeproof.functions.hashing import digits_of, text_numbers
from lakeproof.operators import metrics
from lakeproof.plans import catalog


def test_draws(spark, monkeypatch):
    rng = np.random.default_rng(1)
    true = rng.integers(0, 3, 25)
    pred = {g: np.where(rng.random(25) < p, true, rng.integers(0, 3, 25)) for g, p in ((2.0, 0.7), (1.8, 0.7), (1.6, 0.4))}

    def top(spark, sf_dir, gain=2.0, *more):
        return spark.createDataFrame([(i, int(t), int(p)) for i, (t, p) in enumerate(zip(true, pred[gain]))], "test_index long, y_true int, y_pred int")

    monkeypatch.setattr(catalog, "_top", top)
    at = np.array([[int(hashlib.md5(f"{d}:{i}".encode()).hexdigest()[:8], 16) % 25 for i in range(25)] for d in range(2000)])

    def f1(t, p):
        return np.mean([2 * ((t == c) & (p == c)).sum() / ((t == c).sum() + (p == c).sum()) for c in set(t)])

    scores = np.array([f1(true[x], pred[2.0][x]) for x in at])
    (ci,) = catalog.QUERIES["bootstrap_ci_full"](spark, "").collect()
    assert np.allclose([ci["mean"], ci.low, ci.high], [scores.mean(), *np.quantile(scores, [0.025, 0.975])], atol=2e-6)
    diff = np.array([(true[x] == pred[1.8][x]).mean() - (true[x] == pred[1.6][x]).mean() for x in at])
    (ci,) = catalog.QUERIES["paired_bootstrap_full"](spark, "").collect()
    assert np.allclose([ci["mean"], ci.low, ci.high], [diff.mean(), *np.quantile(diff, [0.025, 0.975])], atol=2e-6)


def test_grid(spark):
    rows = catalog.QUERIES["temperature_grid_full"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.step for r in rows) == list(range(400))


def test_numbers():
    """The first 32 bits of the MD5 of texts of every length that one block holds."""
    for head, low, high in (("0:", 0, 10), ("1999:", 10, 100), ("7:", 995, 1000), ("12:", 1000, 1003), ("", 10_000, 10_003), ("123:", 123_456_789, 123_456_792), ("x" * 50, 10_000, 10_002)):
        want = [int(hashlib.md5(f"{head}{i}".encode()).hexdigest()[:8], 16) for i in range(low, high)]
        assert text_numbers(head, digits_of(low, high)).tolist() == want, (head, low)


def test_counts_in_several_blocks(spark, monkeypatch):
    """Rows dealt over pieces and blocks are drawn as in one; no table of rows becomes a literal of the plan."""
    monkeypatch.setattr(metrics, "PIECE", 7)
    monkeypatch.setattr(metrics, "PIECES", 3)
    rows = [(i * 3, i % 4, None if i % 9 == 0 else i % 5) for i in range(100)]
    df = spark.createDataFrame(rows[::-1], "test_index long, y_true int, y_pred int")
    out = metrics.drawn_counts(df, ("y_true", "y_pred"), 150)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    got = {(r.draw, r.y_true, r.y_pred): r.n for r in out.collect()}
    want = collections.Counter((d, *rows[int(hashlib.md5(f"{d}:{i}".encode()).hexdigest()[:8], 16) % 100][1:]) for d in range(150) for i in range(100))
    assert got == want
    assert metrics.drawn_counts(df.limit(0), ("y_true", "y_pred"), 5).count() == 0


def test_paired_draws(spark, monkeypatch):
    """Both predictions are judged on the rows of one hash; an odd number of rows over several blocks."""
    monkeypatch.setattr(metrics, "PIECE", 5)
    monkeypatch.setattr(metrics, "PIECES", 2)
    rows = [(i, i % 3, i % 4, (i * 7) % 3) for i in range(37)]
    df = spark.createDataFrame(rows, "test_index long, y_true int, p int, q int")
    got = {r.draw: r["diff"] for r in metrics.paired_differences(df, "p", "q", 140).collect()}
    at = [[int(hashlib.md5(f"{d}:{i}".encode()).hexdigest()[:8], 16) % 37 for i in range(37)] for d in range(140)]
    assert got == {d: sum(rows[k][1] == rows[k][2] for k in x) / 37 - sum(rows[k][1] == rows[k][3] for k in x) / 37 for d, x in enumerate(at)}


def test_rows_are_computed_once(spark):
    """Joined predictions are made once, however often the draws need them, and leave none of their plan to later jobs."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(i, i % 3, i % 4, (i * 7) % 3) for i in range(37)], "test_index long, y_true int, p int, q int")
    assert metrics.paired_differences(rows.mapInArrow(seen, rows.schema), "p", "q", 10).count() == 10
    assert made.value == 37
