"""Secret scan: patterns of credentials, and tokens that a battery of randomness tests can't tell from random ones.

1. Patterns: assignments to telling names, access keys and long hex runs (``KINDS``), leftmost and non-overlapping per kind.
2. Candidates: maximal runs of ``[A-Za-z0-9+/_-]`` of ``least`` characters or more. A candidate's encoding is the narrowest
   that its characters allow: hex of either case, base32, base36, base62, base64 or base64url. Digits alone are none.
3. Battery, under "every symbol equally likely and independent": chi-squared of the symbol counts with its exact mean and
   variance (both tails: sequences are too even), runs above and below the middle of the alphabet, and serial correlation of
   neighbours. Fisher's method makes one p-value of the three; under ``alpha`` a candidate isn't random and is done with.
4. False discoveries: ordinary words in the same alphabet make a chi-squared that grows with length, by how unevenly the
   corpus uses the symbols of that encoding (counted over all texts). Its lower tail at a candidate's length is the chance that words look
   this even; short tokens never get a small one. Over the p-values of all candidates of all texts the Benjamini-Hochberg step, on a
   histogram of ``bins`` of log p, finds the bound at which at most ``rate`` of what is reported is expected to be words.

Candidates at or under the bound are spans of kind ``random``, unless a pattern's span covers them.

Edge cases: null and empty texts have no spans; texts are read whole; every row is judged by itself, repeated rows and null ids
too, but all count in the corpus; ties at the bound are all reported; a table without candidates reports patterns alone; an empty
table gives an empty result; other columns are passed on, those named as a result are
replaced by it, and one named ``found_spans`` is left out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeproof.llm import words as wd
from lakeproof.llm.tables import cut, free_name, slices

#: Patterns by kind, the group that must have a least length, and that length.
KINDS = {
    "assign": (re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets of the encodings, the narrowest first.
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}


@dataclass(frozen=True)
class SecretParams:
    #: Characters of a candidate at least.
    least: int = 20
    #: Chance that a random token fails the battery.
    alpha: float = 0.001
    #: Share of words among the tokens reported, at most, as expected.
    rate: float = 0.05
    #: Bins of the histogram of p-values, 16 to a factor of ten.
    bins: int = 512


def _members(alphabet: str) -> np.ndarray:
    out = np.full(256, -1, np.int64)
    out[np.frombuffer(alphabet.encode(), np.uint8)] = np.arange(len(alphabet))
    return out


_VALUES = {name: _members(alphabet) for name, alphabet in ENCODINGS.items()}


def encoding_of(token: bytes) -> tuple[str, np.ndarray] | None:
    """The narrowest encoding that has all characters of a token, and their values; None if no encoding has, and for digits alone."""
    held = np.frombuffer(token, np.uint8)
    if token.isdigit():
        return None
    for name, values in _VALUES.items():
        own = values[held]
        if (own >= 0).all():
            return name, own
    return None


def _two_tails(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _lower_tail(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def chi_squared(values: np.ndarray, k: int) -> float:
    return float((np.bincount(values, minlength=k).astype(float) ** 2).sum()) * k / len(values) - len(values)


def battery(values: np.ndarray, k: int) -> tuple[float, float, float]:
    """p-values of evenness, runs and serial correlation of symbols 0 to k - 1, were they random."""
    n = len(values)
    if n < 3:
        return 1.0, 1.0, 1.0
    even = _two_tails((chi_squared(values, k) - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n)))
    high = values >= k / 2
    a = int(high.sum())
    b = n - a
    if not a or not b:
        return even, 0.0 if n >= 10 else 1.0, 0.0 if n >= 10 and np.ptp(values) == 0 else 1.0
    mean = 2 * a * b / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs = _two_tails((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    x = values - values.mean()
    serial = _two_tails((float((x[1:] * x[:-1]).sum() / (x * x).sum()) + 1 / n) * math.sqrt(n)) if x.any() else 0.0
    return even, runs, serial


def fisher(ps: tuple[float, ...]) -> float:
    """The p-value of three independent ones together: chi-squared with six degrees of freedom."""
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    return math.exp(-half) * (1 + half + half * half / 2)


def unevenness(frequencies: np.ndarray, encoding: str) -> float:
    """How far the symbols of an encoding are from even where ordinary text uses them: chi-squared grows by it with every symbol.

    ``frequencies``: counts of the 256 bytes. For hex, text stands as the nibbles of its bytes; elsewhere letters and digits are symbols."""
    if encoding in ("hex", "HEX"):
        bytes_ = np.concatenate([frequencies[32:33], frequencies[48:58], frequencies[65:91], frequencies[97:123]])
        codes = np.concatenate([[32], np.arange(48, 58), np.arange(65, 91), np.arange(97, 123)])
        counts = np.bincount(codes >> 4, bytes_, 16) + np.bincount(codes & 15, bytes_, 16)
    else:
        fold = frequencies.astype(float).copy()
        if encoding in ("base32", "BASE36"):
            fold[65:91] += fold[97:123]
        if encoding == "base36":
            fold[97:123] += fold[65:91]
        counts = fold[np.frombuffer(ENCODINGS[encoding].encode(), np.uint8)]
    total = counts.sum()
    k = len(counts)
    return float(k * ((counts / total) ** 2).sum() - 1) if total else 0.0


def text_tail(n: int, chi: float, k: int, uneven: float) -> float:
    """The chance that ``n`` symbols of ordinary text are as even as that (normal approximation of a noncentral chi-squared)."""
    shift = n * uneven
    return _lower_tail((chi - (k - 1) - shift) / math.sqrt(2 * (k - 1) + 4 * shift))


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """``start, place of the kind, end`` with its kind, of every pattern match, in order."""
    out = []
    for place, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        out += [(m.start(), place, m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def _candidates(least: int) -> re.Pattern:
    return re.compile(rf"[A-Za-z0-9+/_-]{{{least},}}")


def random_tokens(text: str, params: SecretParams, pattern: re.Pattern | None = None) -> list[tuple[int, int, str, float]]:
    """``start, end, encoding, chi-squared`` of every candidate that passes the battery."""
    out = []
    for m in (pattern or _candidates(params.least)).finditer(text):
        if (found := encoding_of(m.group().encode())) is None:
            continue
        name, values = found
        k = len(ENCODINGS[name])
        if fisher(battery(values, k)) >= params.alpha:
            out.append((*m.span(), name, chi_squared(values, k)))
    return out


_SPAN = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("kind", pa.string()), ("chi", pa.float64())])


def _scanner(params: SecretParams, names: list[str]):
    pattern = _candidates(params.least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, len(names))):
            rows = []
            for text in batch.column(len(names)).to_pylist():
                text = text or ""
                rows.append([*pattern_spans(text), *random_tokens(text, params, pattern)])
            spans = pa.array([[{"a": x[0], "b": x[1], "kind": x[2], "chi": x[3] if len(x) > 3 else None} for x in own] for own in rows], pa.list_(_SPAN))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], spans], names=[*names, "found_spans"])

    return run


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(256, np.int64)
    for batch in (part for whole in batches for part in slices(whole, 0)):
        counts += np.bincount(np.frombuffer(b"".join(wd.encoded(batch.column(0))), np.uint8), minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(counts)], names=["byte", "n"])


def byte_counts(texts: DataFrame) -> np.ndarray:
    """How often each byte stands in all texts: 256 numbers for the driver."""
    out = np.zeros(256, np.int64)
    for r in texts.mapInArrow(_bytes, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r.byte] = r.n
    return out


def bound(counts: dict[int, int], rate: float, bins: int) -> int:
    """The Benjamini-Hochberg step on p-values in bins of ``10 ** (-bin / 16)`` at most: the lowest bin reported, ``bins`` for none."""
    total, below = sum(counts.values()), 0
    lowest = bins
    for i in range(bins - 1, -1, -1):
        below += counts.get(i, 0)
        if counts.get(i, 0) and 10 ** (-i / 16) <= rate * below / total:
            lowest = i
    return lowest


def bin_of(chi: float, n: int, encoding: str, uneven: dict[str, float], bins: int) -> int:
    p = text_tail(n, chi, len(ENCODINGS[encoding]), uneven[encoding])
    return min(bins - 1, int(-16 * math.log10(max(p, 1e-300))))


def _binned(span: Column, uneven: dict[str, float], bins: int) -> Column:
    def run(chi: pa.Array, size: pa.Array, kind: pa.Array) -> pa.Array:
        return pa.array([bin_of(x, n, name, uneven, bins) for x, n, name in zip(chi.to_pylist(), size.to_pylist(), kind.to_pylist())], pa.int32())

    run.__annotations__ = {"chi": pa.Array, "size": pa.Array, "kind": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "int")(span["chi"], span["b"] - span["a"], span["kind"])


def _digest(names: list[str], lowest: int, uneven: dict[str, float], bins: int):
    kinds = list(KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own in batch.column(len(names)).to_pylist():
                base = [(x["a"], kinds.index(x["kind"]), x["b"]) for x in own if x["chi"] is None]
                spans, most = list(base), 0
                for x in own:
                    if x["chi"] is None or any(a <= x["a"] and x["b"] <= b for a, _, b in base):
                        continue
                    if bin_of(x["chi"], x["b"] - x["a"], x["kind"], uneven, bins) >= lowest:
                        spans.append((x["a"], len(kinds), x["b"]))
                        most += 1
                joined = lambda s: ",".join(f"{[*kinds, 'random'][k]}:{a}:{b}" for a, k, b in sorted(s))
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*n, most, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            kinds_of = [pa.int64()] * 4 + [pa.string()] * 2
            made = [pa.array(list(x), k) for x, k in zip(zip(*rows), kinds_of)] if rows else [pa.array([], k) for k in kinds_of]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], names=[*names, *_ADDED])

    return run


_ADDED = ("n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")


def secret_scan(docs: DataFrame, params: SecretParams = SecretParams(), text_col: str = "text") -> DataFrame:
    """The other columns of ``docs`` with the number of spans of each kind, the digest of the patterns' spans and all spans
    (``kind:start:end``, code points, end exclusive, by start and kind)."""
    rest = [c for c in docs.columns if c != text_col and c.lower() not in (*_ADDED, "found_spans")]
    spare = free_name(docs, "scanned_text")
    texts = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text_col).alias(spare))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1]]
    found = "found_spans"
    scanned = texts.mapInArrow(_scanner(params, rest), ", ".join([*fields, "found_spans array<struct<a:bigint,b:bigint,kind:string,chi:double>>"]))
    scanned = cut(scanned, "spans")
    frequencies = byte_counts(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    uneven = {name: unevenness(frequencies, name) for name in ENCODINGS}
    spans = scanned.where(F.size(found) > 0).select(F.explode(found).alias("x")).where("x.chi is not null")
    counts = {r.bin: r.n for r in spans.select(_binned(F.col("x"), uneven, params.bins).alias("bin")).groupBy("bin").agg(F.count("*").alias("n")).collect()}  # a row per bin
    schema = ", ".join([*fields, "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"])
    return scanned.mapInArrow(_digest(rest, bound(counts, params.rate, params.bins), uneven, params.bins), schema)
