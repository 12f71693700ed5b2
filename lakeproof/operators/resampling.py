"""Bootstrap intervals from counts: drawing n rows with replacement draws the counts of their kinds from a multinomial distribution.

Rows are first counted by truth and predictions, a cell per combination, of which there are as many as classes to the power of columns
whatever the number of rows. Draws are shared out over tasks, each with a generator of its own number, so results don't depend on how.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("accuracy", "balanced_accuracy", "macro_f1")
#: Cells that are sent along with the tasks at most (8 bytes a column each).
MOST_CELLS = 1_000_000


def scores(truth: np.ndarray, predicted: np.ndarray, counts: np.ndarray) -> tuple[float, float, float]:
    """:data:`METRICS` of counted cells with classes from 0; averages go over the classes that the truth holds; 0 without rows."""
    classes = int(max(truth.max(initial=0), predicted.max(initial=0))) + 1
    support = np.bincount(truth, counts, classes)
    called = np.bincount(predicted, counts, classes)
    right = np.bincount(truth, counts * (truth == predicted), classes)
    present = support > 0
    if not present.any():
        return 0.0, 0.0, 0.0
    f1 = 2 * right / np.maximum(support + called, 1)
    return float(right.sum() / support.sum()), float((right[present] / support[present]).mean()), float(f1[present].mean())


def drawn(seed: int, draw: int, counts: np.ndarray) -> np.ndarray:
    """Cell counts of one draw of as many rows as there are."""
    n = int(counts.sum())
    return np.random.Generator(np.random.PCG64([seed, draw])).multinomial(n, counts / max(n, 1)).astype(float) if n else counts


def draw_scores(rows: DataFrame, predictions: tuple[str, ...] = ("y_pred",), draws: int = 2_000, seed: int = 42, truth: str = "y_true") -> DataFrame:
    """``draw`` and each metric of each column of predictions (``accuracy_y_pred, ...``) on the same rows drawn.

    Rows without a class or a prediction, or with a negative one, are an error; an empty table scores 0."""
    names = [truth, *predictions]
    cells = rows.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).limit(MOST_CELLS + 1).toArrow()  # bounded by the classes
    if cells.num_rows > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} combinations of classes")
    if any(cells.column(c).null_count or (len(cells) and min(cells.column(c).to_pylist()) < 0) for c in names):
        raise ValueError("classes must be numbers from 0")
    y, *columns = (cells.column(c).to_numpy().astype(np.int64) for c in names)
    counts = cells.column("n").to_numpy().astype(float)
    out = [f"{m}_{p}" for p in predictions for m in METRICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[x for p in columns for x in _scores(y, p, _drawn(seed, d, counts))] for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in found], pa.float64()) for i in range(len(out))]], names=["draw", *out])

    from lakeproof.session import ship

    ship(rows.sparkSession)
    _scores, _drawn = scores, drawn
    return rows.sparkSession.range(draws).withColumnRenamed("id", "draw").mapInArrow(run, ", ".join(["draw long", *[f"{c} double" for c in out]]))


def intervals(values: DataFrame, columns: dict[str, str], level: float = 0.95) -> DataFrame:
    """``metric, n, mean, low, high, includes_zero, positive`` of expressions over draws; percentiles between two values are interpolated."""
    tail = (1 - level) / 2
    long = values.select(F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.expr(x).alias("value")) for name, x in columns.items()])).alias("x")).select("x.*")
    found = long.groupBy("metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"), F.avg((F.col("value") > 0).cast("int")).alias("positive"))
    low, high = F.col("q")[0], F.col("q")[1]
    return found.select("metric", "n", "mean", low.alias("low"), high.alias("high"), ((low <= 0) & (high >= 0)).alias("includes_zero"), "positive")


def bootstrap_intervals(rows: DataFrame, prediction: str = "y_pred", draws: int = 2_000, seed: int = 42) -> DataFrame:
    """Intervals of the three metrics."""
    return intervals(draw_scores(rows, (prediction,), draws, seed), {m: f"{m}_{prediction}" for m in METRICS})


def paired_intervals(rows: DataFrame, a: str, b: str, draws: int = 2_000, seed: int = 42) -> DataFrame:
    """Intervals of the differences a - b in points, both on the same rows drawn."""
    return intervals(draw_scores(rows, (a, b), draws, seed), {m: f"100 * ({m}_{a} - {m}_{b})" for m in METRICS})
