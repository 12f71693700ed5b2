"""Colour images: segmentation of an object before an even backdrop, composites from its mask, and controlled corruptions.

``pixels`` is a row-major array of red, green and blue values, 0 to 255, of ``width`` columns. Work runs on Arrow batches, an image at a
time, with numpy. A null or empty image, and one whose length doesn't fit its width, has status ``no_image``, no mask and no composites; it is
left out of the corruptions. Repeated keys keep a row each; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.session import ship

# --- colour ---------------------------------------------------------------------------------------------------------

#: Linear sRGB to XYZ over the D65 white, row by row.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def lab(rgb: np.ndarray) -> np.ndarray:
    """CIE Lab of sRGB pixels, each channel as a byte: lightness times 2.55, the others plus 128, rounded."""
    c = rgb / 255.0
    linear = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    t = linear @ _XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    light = np.where(t[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * t[..., 1])
    out = np.stack([light * 2.55, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)
    return np.clip(np.rint(out), 0, 255)


def saturation(rgb: np.ndarray) -> np.ndarray:
    """HSV saturation, 0 to 255, rounded; 0 for black."""
    top = rgb.max(axis=-1)
    return np.rint(np.where(top > 0, (top - rgb.min(axis=-1)) * 255 / np.maximum(top, 1e-9), 0))


def threshold(values: np.ndarray, bins: int = 256) -> float:
    """Otsu's threshold over equal bins from the least to the greatest value: the middle of the bin after which the classes differ most."""
    if values.min() == values.max():
        return float(values.flat[0])
    counts, edges = np.histogram(values, bins)
    middle = (edges[1:] + edges[:-1]) / 2
    below, mass = np.cumsum(counts)[:-1], np.cumsum(counts * middle)
    above = counts.sum() - below
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = below * above * (mass[:-1] / below - (mass[-1] - mass[:-1]) / above) ** 2
    return float(middle[np.nanargmax(apart)])


# --- masks ----------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=64)
def _disk(radius: int) -> list[tuple[int, int]]:
    return [(y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if y * y + x * x <= radius * radius]


def _spread(mask: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    h, w = mask.shape
    r = max(max(abs(y), abs(x)) for y, x in steps)
    wide = np.pad(mask, r)
    return np.logical_or.reduce([wide[r + y : r + y + h, r + x : r + x + w] for y, x in steps])


def dilated(mask: np.ndarray, radius: int) -> np.ndarray:
    """The mask with all places within ``radius``."""
    return _spread(mask, _disk(radius)) if radius else mask


def grown(mask: np.ndarray, steps: int) -> np.ndarray:
    """The mask with all places within ``steps`` steps to a neighbour (not diagonal)."""
    return _spread(mask, [(y, x) for y in range(-steps, steps + 1) for x in range(abs(y) - steps, steps - abs(y) + 1)]) if steps else mask


def eroded(mask: np.ndarray, radius: int) -> np.ndarray:
    """Places of which nothing outside the mask lies within ``radius``; beyond the border counts as inside."""
    return ~dilated(~mask, radius)


def opened(mask: np.ndarray, radius: int) -> np.ndarray:
    return dilated(eroded(mask, radius), radius)


def closed(mask: np.ndarray, radius: int) -> np.ndarray:
    return eroded(dilated(mask, radius), radius)


def components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """For every place of the mask the first place of its connected component in reading order, else -1: a union-find whose links all
    jump at once."""
    h, w = mask.shape
    number = np.arange(h * w).reshape(h, w)
    pairs = [(number[:, :-1], number[:, 1:]), (number[:-1], number[1:])]
    if diagonal:
        pairs += [(number[:-1, :-1], number[1:, 1:]), (number[:-1, 1:], number[1:, :-1])]
    a, b = (np.concatenate([p[i].ravel() for p in pairs]) for i in (0, 1))
    flat = mask.ravel()
    both = flat[a] & flat[b]
    a, b = a[both], b[both]
    root = np.arange(h * w)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return np.where(flat, root, -1).reshape(h, w)


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask with its holes: what no path of neighbours (not diagonal) outside the mask links with the border."""
    outside = components(~np.pad(mask, 1), diagonal=False)
    return (outside != outside[0, 0])[1:-1, 1:-1]


def object_mask(rgb: np.ndarray, ring: int = 8, saturated: float = 60, opening: int = 2, closing: int = 3, least: float = 0.01) -> tuple[np.ndarray, dict]:
    """The object's mask, and how it was found.

    Pixels are scored by their Lab distance from the median of the outer ``ring`` pixels or, where that ring is itself saturated, by
    saturation; what lies over Otsu's threshold is opened, closed and filled. Of its components (8 neighbours) the largest that
    touches no border and covers ``least`` of the image is the object, without one the largest of all; of equal ones the first."""
    h, w = rgb.shape[:2]
    outer = np.ones((h, w), bool)
    outer[ring : h - ring, ring : w - ring] = False
    sat = saturation(rgb)
    border = float(np.median(sat[outer]))
    if border < saturated:
        colours = lab(rgb)
        score, basis = np.linalg.norm(colours - np.median(colours[outer], axis=0), axis=-1), "lab_distance_from_border_median"
    else:
        score, basis = sat, "saturation"
    cut = threshold(score)
    parts = components(filled(closed(opened(score > cut, opening), closing)))
    found = {"basis": basis, "otsu": cut, "border_saturation": border, "status": "empty", "area_fraction": 0.0, "touches_border": False, "n_components": 0}
    names, sizes = np.unique(parts[parts >= 0], return_counts=True)
    if not len(names):
        return np.zeros((h, w), bool), found
    cut_off = np.isin(names, np.concatenate([parts[0], parts[-1], parts[:, 0], parts[:, -1]]))
    inside = ~cut_off & (sizes >= least * h * w)
    best = int(np.argmax(np.where(inside, sizes, -1) if inside.any() else sizes))
    mask = parts == names[best]
    return mask, found | {"status": "ok", "area_fraction": float(mask.mean()), "touches_border": bool(cut_off[best]), "n_components": len(names)}


# --- resampling and composites --------------------------------------------------------------------------------------


@lru_cache(maxsize=256)
def triangle(size: int, to: int) -> np.ndarray:
    """``to`` x ``size``: bilinear weights at half-pixel centres; when making smaller the triangle is as wide as a new pixel on either side."""
    scale = size / to
    support = max(scale, 1.0)
    out = np.maximum(0, 1 - np.abs((np.arange(size) + 0.5 - (np.arange(to)[:, None] + 0.5) * scale) / support))
    return out / out.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resampled over all channels, first across, then down, each rounded to bytes. Axes before the last three are kept."""
    across = np.floor(np.einsum("jx,...yxc->...yjc", triangle(image.shape[-2], width), image.astype(float)) + 0.5)
    return np.clip(np.floor(np.einsum("iy,...yjc->...ijc", triangle(image.shape[-3], height), across) + 0.5), 0, 255)


def composites(rgb: np.ndarray, mask: np.ndarray, cover: int = 8, keep: int = 3, margin: float = 0.08, least_margin: int = 4, few: int = 100) -> dict[str, np.ndarray]:
    """``background_only``: the widened mask in the backdrop's colour; ``object_only``: all but it in that colour; ``object_crop``: the
    mask's bounding box with a margin, at the image's size (the image itself without a mask).

    The backdrop's colour is the median, cut to whole numbers, of what lies more than ``cover`` steps from the mask, or of all if that is under ``few`` pixels."""
    h, w = mask.shape
    wide, near = grown(mask, cover), grown(mask, keep)
    outside = ~wide if (~wide).sum() >= few else np.ones((h, w), bool)
    colour = np.floor(np.median(rgb[outside], axis=0))
    out = {"background_only": np.where(wide[..., None], colour, rgb), "object_only": np.where(near[..., None], rgb, colour), "object_crop": rgb.astype(float)}
    if mask.any():
        ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
        top, bottom, left, right = ys[0], ys[-1] + 1, xs[0], xs[-1] + 1
        dy, dx = max(least_margin, int(margin * (bottom - top))), max(least_margin, int(margin * (right - left)))
        out["object_crop"] = resized(rgb[max(0, top - dy) : min(h, bottom + dy), max(0, left - dx) : min(w, right + dx)], h, w)
    return out


# --- corruptions ----------------------------------------------------------------------------------------------------

# Each takes an image or a stack of them: rows, columns and channels are the last three axes.

# Parameters by severity 1 to 3.
SEVERITIES: dict[str, tuple] = {
    "brightness_down": (0.75, 0.55, 0.35),
    "brightness_up": (1.3, 1.6, 2.0),
    "contrast_down": (0.7, 0.5, 0.3),
    "gaussian_blur": (1.0, 2.0, 3.5),
    "motion_blur": (5, 9, 15),
    "jpeg_compression": (40, 20, 10),
    "rotation": (8, 15, 25),
    "crop_zoom": (0.85, 0.70, 0.55),
}

# The quantisation tables of the JPEG standard, annex K, for brightness and for colour.
_LUMA = """16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"""
_CHROMA = """17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99"""


def _wider(a: np.ndarray, by: tuple[tuple[int, int], ...]) -> np.ndarray:
    """The last axes with their edges repeated."""
    return np.pad(a, [(0, 0)] * (a.ndim - len(by)) + list(by), mode="edge")


def quantisation(table: str, quality: int) -> np.ndarray:
    """A table of the standard at a quality from 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table.split(), int).reshape(8, 8) * scale + 50) // 100, 1, 255)


@lru_cache(maxsize=1)
def _dct() -> np.ndarray:
    k = np.arange(8)[:, None]
    return np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos(np.pi * k * (2 * np.arange(8) + 1) / 16)


def _quantised_plane(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A plane of values 0 to 255 after cosine transform and quantisation of its 8 x 8 blocks; edges are repeated to whole blocks."""
    h, w = plane.shape[-2:]
    wide = _wider(plane, ((0, -h % 8), (0, -w % 8))) - 128
    blocks = wide.reshape(*wide.shape[:-2], wide.shape[-2] // 8, 8, wide.shape[-1] // 8, 8).swapaxes(-3, -2)
    d = _dct()
    terms = np.rint(d @ blocks @ d.T / table) * table
    back = (d.T @ terms @ d).swapaxes(-3, -2).reshape(wide.shape)
    return np.clip(np.rint(back + 128), 0, 255)[..., :h, :w]


def jpeg(rgb: np.ndarray, quality: int) -> np.ndarray:
    """What the lossy steps of JPEG leave: brightness and two colour planes (these at half size), quantised by blocks."""
    r, g, b = np.ascontiguousarray(np.moveaxis(rgb.astype(float), -1, 0))
    y = np.rint(0.299 * r + 0.587 * g + 0.114 * b)
    colours = [np.clip(np.rint(p), 0, 255) for p in (128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b)]
    h, w = y.shape[-2:]
    y = _quantised_plane(y, quantisation(_LUMA, quality))
    out = []
    for p in colours:
        wide = _wider(p, ((0, h % 2), (0, w % 2)))
        small = np.rint(wide.reshape(*wide.shape[:-2], wide.shape[-2] // 2, 2, wide.shape[-1] // 2, 2).mean(axis=(-3, -1)))
        out.append(_quantised_plane(small, quantisation(_CHROMA, quality)).repeat(2, axis=-2).repeat(2, axis=-1)[..., :h, :w] - 128)
    cb, cr = out
    return np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)), 0, 255)


def rotated(rgb: np.ndarray, degrees: float, fill: float = 255) -> np.ndarray:
    """Turned counter-clockwise about the middle, bilinear between pixels; ``fill`` where the image has nothing."""
    h, w = rgb.shape[-3:-1]
    t = np.deg2rad(degrees)
    y, x = np.mgrid[:h, :w] + 0.5
    sx = np.cos(t) * (x - w / 2) - np.sin(t) * (y - h / 2) + w / 2
    sy = np.sin(t) * (x - w / 2) + np.cos(t) * (y - h / 2) + h / 2
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    sx, sy = sx - 0.5, sy - 0.5
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]
    at = lambda j, i: rgb[..., np.clip(j, 0, h - 1), np.clip(i, 0, w - 1), :].astype(float)
    mixed = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return np.where(inside[..., None], np.floor(mixed + 0.5), fill)


def _weighted_sum(parts: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """In the given order, in place."""
    out, one = parts[0] * weights[0], np.empty(parts[0].shape)
    for part, k in zip(parts[1:], weights[1:]):
        out += np.multiply(part, k, out=one)
    return out


def _gaussian(rgb: np.ndarray, sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    weights /= weights.sum()
    out = rgb.astype(float)
    h, w = rgb.shape[-3:-1]
    down = _wider(out, ((r, r), (0, 0), (0, 0)))
    out = _weighted_sum([down[..., i : i + h, :, :] for i in range(2 * r + 1)], weights)
    across = _wider(out, ((r, r), (0, 0)))
    return np.rint(_weighted_sum([across[..., i : i + w, :] for i in range(2 * r + 1)], weights))


def _motion(rgb: np.ndarray, length: int) -> np.ndarray:
    w = rgb.shape[-2]
    wide = _wider(rgb.astype(float), ((length // 2, length // 2), (0, 0)))
    return np.floor(sum(wide[..., i : i + w, :] for i in range(length)) / length)


def _contrast(rgb: np.ndarray, factor: float) -> np.ndarray:
    grey = np.floor(rgb @ np.array([0.299, 0.587, 0.114]) + 0.5)
    middle = np.floor(grey.mean(axis=(-2, -1), keepdims=True) + 0.5)[..., None]
    return np.floor(middle + factor * (rgb - middle))


def _zoomed(rgb: np.ndarray, share: float) -> np.ndarray:
    h, w = rgb.shape[-3:-1]
    ch, cw = max(1, int(h * share)), max(1, int(w * share))
    top, left = (h - ch) // 2, (w - cw) // 2
    return resized(rgb[..., top : top + ch, left : left + cw, :], h, w)


#: What each corruption does at a value of :data:`SEVERITIES`.
CORRUPTIONS: dict[str, Callable[[np.ndarray, float], np.ndarray]] = {
    "brightness_down": lambda a, v: np.floor(a * v),
    "brightness_up": lambda a, v: np.floor(a * v),
    "contrast_down": _contrast,
    "gaussian_blur": _gaussian,
    "motion_blur": _motion,
    "jpeg_compression": jpeg,
    "rotation": rotated,
    "crop_zoom": _zoomed,
}


def corrupted(rgb: np.ndarray, name: str, severity: int) -> np.ndarray:
    return np.clip(CORRUPTIONS[name](rgb, SEVERITIES[name][severity - 1]), 0, 255)


# --- operators ------------------------------------------------------------------------------------------------------


def _images(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray | None]]:
    for i, (width, pixels) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
        good = width and width > 0 and pixels.is_valid and len(pixels) and len(pixels) % (3 * width) == 0
        yield i, pixels.values.to_numpy(zero_copy_only=False).reshape(-1, width, 3) if good else None


def _typed(images: DataFrame, key: str) -> tuple[DataFrame, str]:
    """What the tasks get of the images, and the key's type."""
    rows = images.select(key, F.col("width").cast("int").alias("width"), F.col("pixels").cast("array<double>").alias("pixels"))
    return rows, images.schema[key].dataType.simpleString()


def _mapped(images: DataFrame, key: str, rows_of: Callable, schema: str) -> DataFrame:
    """``key`` and the columns of ``schema``, as many rows of an image as ``rows_of`` gives."""
    ship(images.sparkSession)
    fields = images.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, made = [], []
            for i, image in _images(batch):
                for row in rows_of(image):
                    at.append(i)
                    made.append(row)
                if len(made) >= 64:
                    yield part(batch, at, made)
                    at, made = [], []
            yield part(batch, at, made)

    def part(batch: pa.RecordBatch, at: list, made: list) -> pa.RecordBatch:
        columns = [pa.array([row[j] for row in made], kind.type) for j, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=[key, *kinds.names])

    rows, kind = _typed(images, key)
    return rows.mapInArrow(run, f"`{key}` {kind}, {schema}")


def segment_objects(images: DataFrame, key: str, **params) -> DataFrame:
    """``key, mask, basis, otsu, border_saturation, status, area_fraction, touches_border, n_components`` (see :func:`object_mask`)."""
    names = ("basis", "otsu", "border_saturation", "status", "area_fraction", "touches_border", "n_components")

    def rows_of(image):
        if image is None:
            return [(None, None, None, None, "no_image", None, None, None)]
        mask, found = object_mask(image, **params)
        return [(mask.ravel().tolist(), *[found[n] for n in names])]

    return _mapped(images, key, rows_of, "mask array<boolean>, basis string, otsu double, border_saturation double, status string, area_fraction double, touches_border boolean, n_components int")


def object_composites(images: DataFrame, key: str, segmentation: dict | None = None, **params) -> DataFrame:
    """``key, composite, width, pixels``: the three composites of every image (see :func:`composites`) by its own mask."""

    def rows_of(image):
        if image is None:
            return []
        return [(name, image.shape[1], a.ravel().tolist()) for name, a in composites(image, object_mask(image, **(segmentation or {}))[0], **params).items()]

    return _mapped(images, key, rows_of, "composite string, width int, pixels array<double>")


#: Values of images of one shape that are corrupted at once: enough to spare calls, few enough for a core's cache.
_STACK = 1 << 15


def _stacks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the batch and pixels of its images, stacked where their shapes are equal."""
    pixels = batch.column(2)
    values, starts = pixels.values.to_numpy(zero_copy_only=False), pixels.offsets.to_numpy()[:-1]
    width, length = (x.fill_null(0).to_numpy().astype(np.int64) for x in (batch.column(1), pixels.value_lengths()))
    good = np.flatnonzero((width > 0) & (length > 0) & (length % np.maximum(3 * width, 1) == 0))
    shapes, own = np.unique(np.stack([width[good], length[good]], axis=1), axis=0, return_inverse=True)
    for k, (w, n) in enumerate(shapes):
        same = good[own.ravel() == k]
        step = max(1, _STACK // n)
        for i in range(0, len(same), step):
            at = same[i : i + step]
            yield at, values[starts[at][:, None] + np.arange(n)].reshape(len(at), -1, w, 3)


def corrupt_images(
    images: DataFrame,
    key: str,
    names: tuple[str, ...] = tuple(CORRUPTIONS),
    severities: tuple[int, ...] = (1, 2, 3),
    measures: dict[str, Callable[[np.ndarray], np.ndarray]] | None = None,
) -> DataFrame:
    """``key, corruption, severity, width, pixels``: every image under every corruption and severity.

    With ``measures``, the numbers that these give of each image's values (a row an image) stand in place of ``width`` and
    ``pixels``, so that pixels needn't leave the task that makes them."""
    ship(images.sparkSession)
    rows, kind = _typed(images, key)
    columns = [f"`{n}` double" for n in measures] if measures else ["width int", "pixels array<double>"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stack in _stacks(batch):
                keys, n = batch.column(0).take(pa.array(at)), len(at)
                for name in names:
                    for severity in severities:
                        flat = corrupted(stack, name, severity).reshape(n, -1)
                        if measures:
                            more = {m: pa.array(f(flat), pa.float64()) for m, f in measures.items()}
                        else:
                            ends = pa.array(np.arange(n + 1) * flat.shape[1], pa.int32())
                            more = {"width": pa.array(np.full(n, stack.shape[2]), pa.int32()), "pixels": pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))}
                        yield pa.RecordBatch.from_pydict({key: keys, "corruption": pa.array([name] * n), "severity": pa.array([severity] * n, pa.int32()), **more})

    return rows.mapInArrow(run, f"`{key}` {kind}, corruption string, severity int, {', '.join(columns)}")
