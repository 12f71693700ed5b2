"""Scalar and array expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_number(text: Column) -> Column:
    """The first 32 bits of a text's MD5 as a long: the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def unit_number(text: Column) -> Column:
    return text_number(text) / F.lit(4294967296.0)


def next_lcg(seed: Column) -> Column:
    """One step of the linear congruential generator of the parity cases."""
    return (seed * 1103515245 + 12345).bitwiseAND(0x7FFFFFFF)


def trailing_number(path: Column) -> Column:
    """The number in front of a path's extension; null without one."""
    return F.nullif(F.regexp_extract(path, r"([0-9]+)\.[A-Za-z]+$", 1), F.lit("")).try_cast("long")


def safe_ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    ratio = F.try_divide(a.cast("double"), b.cast("double"))
    return ratio if default is None else F.coalesce(ratio, F.lit(default))


def argmax(probs: Column) -> Column:
    """Index of the first largest element, from 0."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalised(values: Column) -> Column:
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return bound(values, lambda v: bound(total(v), lambda t: F.transform(v, lambda x: x / t)))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Max-shifted softmax of logits over a temperature; a temperature of 0 or less changes nothing."""
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    scale = F.when(t <= 0, F.lit(1.0)).otherwise(t)
    return bound(logits, lambda v: bound(F.array_max(v), lambda top: normalised(F.transform(v, lambda z: F.exp((z - top) / scale)))))


def logits_of(probs: Column) -> Column:
    return F.transform(probs, lambda p: F.ln(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12))))


def entropy(probs: Column) -> Column:
    return -F.aggregate(probs, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.ln(p)).otherwise(0.0))


def top_indices(probs: Column, k: int) -> Column:
    """Indices of the ``k`` largest elements, the first of equals first."""
    order = F.array_sort(F.transform(probs, lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    return F.transform(F.slice(order, 1, k), lambda x: x["i"])


def nearest_rank(values: Column, q: float, of: str = "n") -> Column:
    """``sorted[min(n-1, int(q n))]`` (``of='n'``) or ``sorted[int((n-1) q)]`` (``of='n-1'``) of a sorted array."""
    n = F.size(values)
    at = F.least(n - 1, F.floor(n * q)) if of == "n" else F.floor((n - 1) * q)
    return F.get(values, at.cast("int"))


def angle(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360))


def exif_degrees(orientation: Column) -> Column:
    return F.when(orientation == 3, 180).when(orientation == 6, 90).when(orientation == 8, 270).otherwise(0)


def celsius(raw: Column) -> Column:
    """Sensor values beyond 1000 are thousandths of a degree."""
    return F.when(F.abs(raw) > 1000, raw / 1000).otherwise(raw)


def channels(argb: Column) -> Column:
    """Red, green and blue of packed pixels."""
    return F.array(*[F.call_function("shiftright", argb, F.lit(s)).bitwiseAND(255) for s in (16, 8, 0)])


def dequantised(q: Column, scale: float, zero: int) -> Column:
    return F.transform(q, lambda x: (x - zero) * scale)


def quantised(values: Column, scale: float, zero: int) -> Column:
    """Signed bytes: rounded half to even, then clamped."""
    return F.transform(values, lambda x: F.greatest(F.least(F.bround(x / scale) + zero, F.lit(127.0)), F.lit(-128.0)).cast("int"))


def sums_to_one(values: Column, tolerance: float = 1e-2) -> Column:
    return F.abs(F.aggregate(values, F.lit(0.0), lambda s, x: s + x) - 1) <= tolerance


def guarded_probs(values: Column, tolerance: float = 1e-2) -> Column:
    """The values, or their softmax where they do not sum to one."""
    return F.when(sums_to_one(values, tolerance), values).otherwise(softmax(values))


def hex_words(digest: Column, words: int = 4) -> Column:
    """A hex digest as 64-bit words."""
    return F.array(*[F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long") for i in range(words)])


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def peripheral_mass(cells: Column, side: int, margin: int) -> Column:
    """Share of a square map's positive mass outside its centre; 0 without mass."""
    inside = lambda i: (F.floor(i / side) >= margin) & (F.floor(i / side) < side - margin) & (i % side >= margin) & (i % side < side - margin)
    total = F.aggregate(cells, F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(0.0)))
    outer = F.aggregate(F.transform(cells, lambda x, i: F.when(inside(i), 0.0).otherwise(F.greatest(x, F.lit(0.0)))), F.lit(0.0), lambda s, x: s + x)
    return safe_ratio(outer, total)


def peak_normalised(cells: Column) -> Column:
    peak = F.array_max(cells)
    return F.transform(cells, lambda x: F.when(peak <= 0, 0.0).otherwise(F.greatest(x, F.lit(0.0)) / peak))
