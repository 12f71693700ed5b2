"""Operators on pixel and activation arrays: ``pixels`` is a row-major array of numbers, 0 to 255, of ``width`` columns.

Statistics and maps are array expressions. What needs neighbourhoods over several steps runs on Arrow batches
with numpy; decoding and encoding of image files is left to the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeproof.functions.scalars import bound
from lakeproof.session import ship


def contrast(pixels: Column) -> tuple[Column, Column]:
    """Mean and population deviation of an array."""
    n = F.size(pixels)
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x) / n
    square = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x * x) / n
    return mean, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))


def laplacian_variance(pixels: Column, width: int) -> Column:
    """Variance of the four-neighbour Laplacian over inner pixels, a measure of sharpness; null without inner pixels."""

    def values(px: Column) -> Column:
        inner = lambda i: (i % width > 0) & (i % width < width - 1) & (i >= width) & (i < F.size(px) - width)
        at = lambda i: F.get(px, i)
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(px) - 1), inner), lambda i: at(i - 1) + at(i + 1) + at(i - width) + at(i + width) - 4 * at(i))

    # Bound, since an array that a lambda names is computed anew for every element.
    return bound(bound(pixels, values), lambda v: F.when(F.size(v) > 0, F.pow(contrast(v)[1], F.lit(2.0))))


def sharpness(variance: Column) -> Column:
    return F.when(variance < 100, "blurry").when(variance < 300, "soft").otherwise("sharp")


def class_map(features: Column, weights: Column, channels: int) -> Column:
    """Class activation map: per cell the weighted sum over ``channels`` consecutive features, negatives as 0."""
    cells = F.sequence(F.lit(0), (F.size(features) / channels).cast("int") - 1)
    dot = lambda i: F.aggregate(F.zip_with(F.slice(features, (i * channels + 1).cast("int"), channels), weights, lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v)
    return F.transform(cells, lambda i: F.greatest(dot(i), F.lit(0.0)))


def extract_map(flat: Column, classes: int, cls: Column) -> Column:
    """One class's map from a flat array ordered by cell, then class."""
    return F.filter(flat, lambda _, i: i % classes == cls)


def upsample(cells: Column, side: int, to: int) -> Column:
    """Bilinear enlargement of a square map with half-pixel centres, clamped at the edges."""
    place = lambda k: F.least(F.greatest((k + 0.5) * side / to - 0.5, F.lit(0.0)), F.lit(float(side - 1)))

    def value(i: Column) -> Column:
        y, x = place(F.floor(i / to)), place(i % to)
        y0, x0 = F.floor(y).cast("int"), F.floor(x).cast("int")
        y1, x1 = F.least(y0 + 1, F.lit(side - 1)), F.least(x0 + 1, F.lit(side - 1))
        v = lambda r, c: F.get(cells, r * side + c)
        top = v(y0, x0) * (1 - (x - x0)) + v(y0, x1) * (x - x0)
        low = v(y1, x0) * (1 - (x - x0)) + v(y1, x1) * (x - x0)
        return top * (1 - (y - y0)) + low * (y - y0)

    return F.transform(F.sequence(F.lit(0), F.lit(to * to - 1)), value)


def on_mask(cells: Column, mask: Column) -> dict[str, Column]:
    """Mass on the mask, its ratio to the mask's area (null for an empty mask) and whether the peak lies on it."""
    total = F.aggregate(cells, F.lit(0.0), lambda s, x: s + x)
    mass = F.aggregate(F.zip_with(cells, mask, lambda x, m: F.when(m, x).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    area = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("int")) / F.size(mask)
    share = F.coalesce(F.try_divide(mass, total), F.lit(0.0))
    peak = F.get(mask, (F.array_position(cells, F.array_max(cells)) - 1).cast("int"))
    return {"mass_on_mask": share, "area": area, "concentration": F.when(area > 0, share / area), "peak_on_mask": peak}


def touches_border(mask: Column, side: int) -> Column:
    """Whether a square mask holds a cell of the outermost rows or columns."""
    edge = lambda i: F.floor(i / side).isin(0, side - 1) | (i % side).isin(0, side - 1)
    return F.exists(F.transform(mask, lambda m, i: m & edge(i)), lambda x: x)


def mask_flagged(area: Column, border: Column, least: float = 0.02, most: float = 0.45) -> Column:
    """Masks too small, too large or cut by the border, which say little about where a map's mass lies."""
    return (area < least) | (area > most) | border


def _shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    return np.pad(a, ((abs(dy), abs(dy)), (abs(dx), abs(dx))), mode="edge")[abs(dy) - dy : abs(dy) - dy + a.shape[0], abs(dx) - dx : abs(dx) - dx + a.shape[1]]


def _mean_of(a: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    return np.mean([_shifted(a, *s) for s in steps], axis=0)


def _turned(a: np.ndarray, degrees: float) -> np.ndarray:
    h, w = a.shape
    y, x = np.mgrid[:h, :w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    t = np.deg2rad(degrees)
    sy, sx = np.rint(y * np.cos(t) - x * np.sin(t) + (h - 1) / 2).astype(int), np.rint(y * np.sin(t) + x * np.cos(t) + (w - 1) / 2).astype(int)
    return a[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)]


def _zoomed(a: np.ndarray, share: float) -> np.ndarray:
    h, w = a.shape
    top, left = int(h * share), int(w * share)
    rows = top + (np.arange(h) * (h - 2 * top) // h)
    columns = left + (np.arange(w) * (w - 2 * left) // w)
    return a[np.ix_(rows, columns)]


#: Corruptions by name, each of severity 1 to 3; add to the dictionary to extend it.
CORRUPTIONS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "brightness_up": lambda a, s: a * (1 + 0.25 * s),
    "brightness_down": lambda a, s: a * (1 - 0.25 * s),
    "contrast": lambda a, s: (a - a.mean()) * (1 - 0.25 * s) + a.mean(),
    "blur": lambda a, s: _mean_of(a, [(y, x) for y in range(-s, s + 1) for x in range(-s, s + 1)]),
    "motion_blur": lambda a, s: _mean_of(a, [(0, x) for x in range(-2 * s, 2 * s + 1)]),
    "quantise": lambda a, s: np.round(a / (16 * s)) * (16 * s),
    "rotation": lambda a, s: _turned(a, 10 * s),
    "crop_zoom": lambda a, s: _zoomed(a, 0.08 * s),
}


def corrupt(images: DataFrame, key: str, severities: tuple[int, ...] = (1, 2, 3), corruptions: dict | None = None) -> DataFrame:
    """Every image under every corruption and severity: ``key, corruption, severity, width, pixels``."""
    chosen = corruptions or CORRUPTIONS
    ship(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, width, pixels in zip(pdf[key], pdf.width, pdf.pixels):
                a = np.asarray(pixels, float).reshape(-1, width)
                rows = [(k, name, s, width, np.clip(f(a, s), 0, 255).ravel().tolist()) for name, f in chosen.items() for s in severities]
                yield pd.DataFrame(rows, columns=[key, "corruption", "severity", "width", "pixels"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "width", F.col("pixels").cast("array<double>").alias("pixels")).mapInPandas(run, f"{key} {kind}, corruption string, severity int, width int, pixels array<double>")


def otsu(values: np.ndarray) -> float:
    """The threshold of greatest variance between two classes of values from 0 to 255."""
    counts = np.bincount(np.clip(values, 0, 255).astype(int).ravel(), minlength=256).astype(float)
    below = np.cumsum(counts)
    sums = np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (sums[-1] * below / below[-1] - sums) ** 2 / (below * (below[-1] - below))
    return float(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def segment(images: DataFrame, key: str, dilate: int = 0) -> DataFrame:
    """Foreground masks by distance from the border's median: ``key, mask, area, touches_border``."""
    ship(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, width, pixels in zip(pdf[key], pdf.width, pdf.pixels):
                a = np.asarray(pixels, float).reshape(-1, width)
                border = np.concatenate([a[0], a[-1], a[:, 0], a[:, -1]])
                d = np.abs(a - np.median(border))
                m = d > otsu(d * 255 / max(d.max(), 1e-9)) * d.max() / 255
                for _ in range(dilate):
                    m = np.any([_shifted(m, *s) for s in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))], axis=0)
                rows.append((k, m.ravel().tolist(), float(m.mean()), bool(m[0].any() or m[-1].any() or m[:, 0].any() or m[:, -1].any())))
            yield pd.DataFrame(rows, columns=[key, "mask", "area", "touches_border"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "width", F.col("pixels").cast("array<double>").alias("pixels")).mapInPandas(run, f"{key} {kind}, mask array<boolean>, area double, touches_border boolean")


def predict(rows: DataFrame, key: str, features: str, model: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Class probabilities of an external model, batch by batch: ``key, probs``. The model must be small enough to travel with the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({key: pdf[key], "probs": list(model(np.stack(pdf[features])))})

    return rows.select(key, features).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, probs array<double>")
