"""Words, their 64-bit hashes and word n-grams of many texts at once, with numpy.

Two word rules are in use. ``SPACED``: runs of anything but ASCII white space. ``ALNUM``: runs of ASCII
letters and digits and of any non-ASCII character; both can be told from the UTF-8 bytes alone.
Hashes are 64 bits wide: a collision among a billion distinct keys has a chance near 3 %, and a false result
needs both keys in the same comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from lakeproof.llm.workers import kept

#: Bytes that part words.
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_NOT_ALNUM = np.zeros(256, bool)
_NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
SPACED, ALNUM = _SPACE, _NOT_ALNUM

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}
#: Bytes hashed at a time, about.
_PIECE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if n > _PIECE:  # for one huge word: not worth keeping
            return have
        _POWERS[base] = have
    return have


kept(_POWERS.clear)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Some texts laid end to end, a line feed after each: ``data`` (bytes), word ``start`` and ``end``, and
    ``first``: text ``i`` has the words ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, texts: list[bytes], breaks: np.ndarray, lower: bool):
        joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.data = _LOWER[joined] if lower else joined
        inside = ~breaks[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.offset = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.offset[1:])
        self.first = np.searchsorted(self.start, self.offset)

    def hashes(self) -> np.ndarray:
        """The hash of every word, by pieces of the text, so that what is held at a time doesn't grow with it."""
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(self.start):
            low = self.start[at]
            upto = max(at + 1, int(np.searchsorted(self.end, low + _PIECE, "right")))
            start, end = self.start[at:upto] - low, self.end[at:upto] - low
            n = int(end[-1])
            with np.errstate(over="ignore"):
                sums = np.zeros(n + 1, np.uint64)
                np.cumsum(_BYTE[self.data[low : low + n]] * _powers(_BASE, n)[:n], out=sums[1:])
                out[at:upto] = mix((sums[end] - sums[start]) * _powers(_UNBASE, n)[start])
            at = upto
        return out


def chunks(texts: list[bytes], breaks: np.ndarray, lower: bool = False, size: int = 1 << 20) -> Iterator[tuple[int, Chunk]]:
    """Chunks of about ``size`` bytes, each with the index of its first text; a longer text is one chunk."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield at, Chunk(texts[at:i], breaks, lower)
            at, held = i, 0
        held += len(t) + 1
    if held:
        yield at, Chunk(texts[at:], breaks, lower)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every ``n`` consecutive words (n up to 64); empty with fewer words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:m] * _GRAM[0]
        for j in range(1, n):
            out += words[j : j + m] * _GRAM[j]
    return mix(out)


def whole(words: np.ndarray) -> np.uint64:
    """The hash of a whole sequence of fewer than 64 words."""
    with np.errstate(over="ignore"):
        return mix(np.array([(words * _GRAM[: len(words)]).sum(dtype=np.uint64) ^ np.uint64(len(words) << 56)]))[0]


def encoded(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
