"""The first 32 bits of MD5 over arrays of texts: what :func:`lakeproof.functions.scalars.text_number` gives, for numbered draws by the million."""

from __future__ import annotations

import math

import numpy as np

_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_PLACES = ((1, 0), (5, 1), (3, 5), (7, 0))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def digits_of(low: int, high: int) -> list[np.ndarray]:
    """The characters, first to last, of the numbers from ``low`` up to before ``high``, which all have as many digits."""
    i = np.arange(low, high, dtype=np.int64)
    return [(i // 10**k % 10 + 48).astype(np.uint32) for k in reversed(range(len(str(low))))]


def text_numbers(head: str, tail: list[np.ndarray]) -> np.ndarray:
    """Of each text made of ``head`` and one character of every array of ``tail``; texts have 55 bytes at most."""
    text: list = [*head.encode(), *tail, 0x80]
    if len(text) > 56:
        raise ValueError("texts of 55 bytes at most")
    n = len(tail[0])
    words: list = [0] * 16
    for p, c in enumerate(text):
        words[p // 4] = words[p // 4] + (np.left_shift(c, np.uint32(8 * (p % 4))) if isinstance(c, np.ndarray) else np.uint32(c << 8 * (p % 4)))
    words[14] = np.uint32(8 * (len(text) - 1))
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three steps don't reach the first word
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        by, first = _PLACES[i // 16]
        word, turn = words[(by * i + first) % 16], _TURNS[i // 16][i % 4]
        np.add(a, f, out=a)
        if isinstance(word, np.ndarray):
            np.add(a, word, out=a), np.add(a, np.uint32(_SINES[i]), out=a)
        else:
            np.add(a, np.uint32((_SINES[i] + int(word)) % 2**32), out=a)
        np.left_shift(a, np.uint32(turn), out=g), np.right_shift(a, np.uint32(32 - turn), out=a)
        np.bitwise_or(a, g, out=a), np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(_START[0])).byteswap()
