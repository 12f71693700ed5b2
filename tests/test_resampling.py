"""Intervals from drawn counts against drawn rows; refusals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeproof.operators import compare, resampling


def by_rows(y, p):
    """Accuracy, balanced accuracy and macro-F1 by plain loops."""
    classes = sorted(set(y))
    recall, f1 = [], []
    for c in classes:
        tp = sum(a == b == c for a, b in zip(y, p))
        recall.append(tp / sum(a == c for a in y))
        f1.append(2 * tp / (sum(a == c for a in y) + sum(b == c for b in p)))
    return sum(a == b for a, b in zip(y, p)) / len(y), sum(recall) / len(classes), sum(f1) / len(classes)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 4, 150)
    a = np.where(rng.random(150) < 0.7, y, rng.integers(0, 5, 150))
    return y.tolist(), a.tolist(), np.where(rng.random(150) < 0.6, y, rng.integers(0, 5, 150)).tolist()


def test_scores(data):
    y, a, _ = data
    got = resampling.scores(np.array(y), np.array(a), np.ones(len(y)))
    assert np.allclose(got, by_rows(y, a))
    assert resampling.scores(np.array([0, 1]), np.array([0, 0]), np.zeros(2)) == (0, 0, 0)


def test_intervals(spark, data):
    y, a, b = data
    df = spark.createDataFrame(list(zip(range(150), y, a, b)), "i int, y_true int, a int, b int")
    got = {r.metric: r for r in resampling.bootstrap_intervals(df, "a", 2_000).collect()}
    both = {r.metric: r for r in resampling.paired_intervals(df.repartition(5), "a", "b", 2_000).collect()}
    rng = np.random.default_rng(1)
    picks = [rng.integers(0, 150, 150) for _ in range(600)]
    own = np.array([by_rows([y[i] for i in k], [a[i] for i in k]) for k in picks])
    other = np.array([by_rows([y[i] for i in k], [b[i] for i in k]) for k in picks])
    for j, m in enumerate(resampling.METRICS):
        assert got[m].n == 2_000 and abs(got[m].mean - own[:, j].mean()) < 0.01
        assert np.allclose([got[m].low, got[m].high], np.percentile(own[:, j], [2.5, 97.5]), atol=0.03)
        d = 100 * (own[:, j] - other[:, j])
        assert np.allclose([both[m].mean, both[m].low, both[m].high], [d.mean(), *np.percentile(d, [2.5, 97.5])], atol=3) and both[m].includes_zero == (both[m].low <= 0 <= both[m].high)
        assert both[m].positive > 0.5
    # The same draws however rows and tasks are laid out; a model is no better than itself.
    again = {r.metric: tuple(r) for r in resampling.bootstrap_intervals(df.repartition(3), "a", 2_000).collect()}
    assert again == {m: tuple(r) for m, r in got.items()}
    same = resampling.paired_intervals(df.withColumn("c", F.col("a")), "a", "c", 50).collect()
    assert all((r.mean, r.low, r.high, r.includes_zero, r.positive) == (0, 0, 0, True, 0) for r in same)
    assert all(r.mean == 0 for r in resampling.bootstrap_intervals(df.limit(0), "a", 10).collect())
    with pytest.raises(ValueError):
        resampling.bootstrap_intervals(df.withColumn("a", F.lit(None).cast("int")), "a", 10)


def test_refusals(spark):
    kind = "test_index int, y_true int"
    a = spark.createDataFrame([(1, 0), (2, 1), (3, None)], kind)
    compare.require_aligned(a, a)
    for rows, found in (([(1, 0), (2, 1)], (1, 0, 0, 0)), ([(1, 0), (2, 1), (3, None), (4, 4)], (0, 1, 0, 0)), ([(1, 0), (2, 2), (3, 5)], (0, 0, 2, 0)), ([(1, 0), (1, 0), (2, 1), (3, None)], (0, 0, 0, 1))):
        b = spark.createDataFrame(rows, kind)
        assert tuple(compare.alignment(a, b).first()) == found
        with pytest.raises(ValueError, match="can't be paired"):
            compare.require_aligned(a, b)
    assert tuple(compare.alignment(a.limit(0), a.limit(0)).first()) == (0, 0, 0, 0)
    compare.require_digest("AB", "ab")
    for one, two in (("a", "b"), (None, None), ("", "a")):
        with pytest.raises(ValueError, match="unlike"):
            compare.require_digest(one, two)
