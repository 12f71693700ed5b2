"""Image files decoded and resampled: PNG of 8 bits a channel, without interlacing.

Every file gives a row with a ``status``: ``ok``, or ``verify_failed:`` (signature, checksum, cut off) or ``decode_failed:`` (a form not read
here, wrong sizes, damaged data) with the reason, and then no pixels. Grey and palette images become red, green and blue; transparency is dropped. Labels
and other columns stay beside their image. Null and empty contents fail the verification.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.operators.masks import resized
from lakeproof.session import ship

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by the kind of colour that a file names.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Names and contents of a file's chunks up to its end; a wrong checksum or a missing end is an error."""
    if data[:8] != SIGNATURE:
        raise ValueError("signature")
    at = 8
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4])
        name, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            break
        if zlib.crc32(name + body) != int.from_bytes(data[at + 8 + size : at + 12 + size]):
            raise ValueError("checksum")
        yield name, body
        if name == b"IEND":
            return
        at += 12 + size
    raise ValueError("cut off")


def unpredicted(rows: np.ndarray, step: int) -> np.ndarray:
    """Bytes of an image's lines from what their predictors left: ``rows`` has a line's predictor first, ``step`` is the bytes of a pixel."""
    out = np.zeros((len(rows), rows.shape[1] - 1), np.uint8)
    above = np.zeros(rows.shape[1] - 1, np.uint8)
    for y, (kind, line) in enumerate(zip(rows[:, 0].tolist(), rows[:, 1:])):
        if kind == 1:  # the pixel to the left
            line = line.reshape(-1, step).cumsum(axis=0, dtype=np.uint8).ravel()
        elif kind == 2:  # the pixel above
            line = line + above
        elif kind in (3, 4):  # a mixture, one pixel after the other
            own, up = line.tolist(), above.tolist()
            for i in range(len(own)):
                a, b, c = (own[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                own[i] = (own[i] + guess) & 255
            line = np.array(own, np.uint8)
        elif kind:
            raise ValueError("predictor")
        out[y] = above = line
    return out


def decode_png(data: bytes) -> np.ndarray:
    """An image's red, green and blue values; ValueError says why not."""
    held = list(chunks(data))
    if not held or held[0][0] != b"IHDR" or len(held[0][1]) != 13:
        raise ValueError("header")
    head = held[0][1]
    width, height = int.from_bytes(head[:4]), int.from_bytes(head[4:8])
    depth, colour, _, _, interlaced = head[8:13]
    if depth != 8 or colour not in _CHANNELS or interlaced or not width or not height:
        raise ValueError("form")
    n = _CHANNELS[colour]
    try:
        raw = zlib.decompress(b"".join(body for name, body in held if name == b"IDAT"))
    except zlib.error:
        raise ValueError("data") from None
    if len(raw) != height * (width * n + 1):
        raise ValueError("size")
    pixels = unpredicted(np.frombuffer(raw, np.uint8).reshape(height, -1), n).reshape(height, width, n)
    if colour == 3:
        palette = next((np.frombuffer(body, np.uint8).reshape(-1, 3) for name, body in held if name == b"PLTE"), None)
        if palette is None or pixels.max() >= len(palette):
            raise ValueError("palette")
        return palette[pixels[..., 0]]
    return pixels[..., :3] if n >= 3 else np.repeat(pixels[..., :1], 3, axis=2)


def decode_images(files: DataFrame, content: str = "content", size: int | None = None) -> DataFrame:
    """The other columns of ``files`` with ``status, width, height`` (of the file) and ``pixels``, resampled to ``size`` x ``size`` if given."""
    ship(files.sparkSession)
    rest = [c for c in files.columns if c.lower() not in (content.lower(), "status", "width", "height", "pixels")]

    def one(data: bytes | None) -> tuple:
        try:
            for _ in chunks(data or b""):
                pass
        except ValueError as e:
            return f"verify_failed:{e}", None, None, None
        try:
            image = decode_png(data)
        except ValueError as e:
            return f"decode_failed:{e}", None, None, None
        pixels = resized(image, size, size) if size else image
        return "ok", image.shape[1], image.shape[0], pixels.astype(int).ravel().tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                made = list(zip(*map(one, part.column(len(rest)).to_pylist())))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], *[pa.array(x, k) for x, k in zip(made, kinds)]], names=[*rest, "status", "width", "height", "pixels"])

    rows = files.select(*[F.col(f"`{c}`") for c in rest], content)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "status string, width int, height int, pixels array<int>"]))


def encode_png(pixels: np.ndarray, predictors: tuple[int, ...] = (0,), colour: int | None = None) -> bytes:
    """A file of ``height x width x channels`` bytes, its lines under the predictors in turn."""
    h, w, n = pixels.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[n] if colour is None else colour
    lines = pixels.reshape(h, w * n).astype(int)
    body = bytearray()
    for y in range(h):
        kind = predictors[y % len(predictors)]
        body.append(kind)
        a = np.concatenate([np.zeros(n, int), lines[y][:-n]])
        b = lines[y - 1] if y else np.zeros(w * n, int)
        c = np.concatenate([np.zeros(n, int), b[:-n]])
        p = a + b - c
        near = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
        body += bytes(((lines[y] - (0, a, b, (a + b) // 2, near)[kind]) & 255).astype(np.uint8).tolist())
    part = lambda name, data: len(data).to_bytes(4) + name + data + zlib.crc32(name + data).to_bytes(4)
    head = w.to_bytes(4) + h.to_bytes(4) + bytes([8, colour, 0, 0, 0])
    return SIGNATURE + part(b"IHDR", head) + part(b"IDAT", zlib.compress(bytes(body))) + part(b"IEND", b"")
