"""PNG files written with every predictor and kind of colour, and damaged ones."""

import zlib

import numpy as np
import pytest

from lakeproof.operators.decode import SIGNATURE, decode_images, decode_png, encode_png
from lakeproof.operators.masks import resized


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_predictors(channels):
    rng = np.random.default_rng(channels)
    a = rng.integers(0, 256, (11, 7, channels)).astype(np.uint8)
    want = a[..., :3] if channels >= 3 else np.repeat(a[..., :1], 3, axis=2)
    for kinds in ((0,), (1,), (2,), (3,), (4,), (4, 3, 2, 1, 0)):
        assert (decode_png(encode_png(a, kinds)) == want).all(), kinds


def part(name, data):
    return len(data).to_bytes(4) + name + data + zlib.crc32(name + data).to_bytes(4)


def test_palette_and_several_data_chunks():
    idx = np.array([[[0], [1]], [[2], [1]]], np.uint8)
    good = encode_png(idx, (1, 2), colour=3)
    cut = good.index(b"IDAT") - 4
    body = good[cut + 8 : cut + 8 + int.from_bytes(good[cut : cut + 4])]
    palette = bytes([1, 2, 3, 40, 50, 60, 7, 8, 9])
    data = good[:cut] + part(b"PLTE", palette) + part(b"IDAT", body[:3]) + part(b"tEXt", b"a\0b") + part(b"IDAT", body[3:]) + part(b"IEND", b"")
    assert decode_png(data).tolist() == [[[1, 2, 3], [40, 50, 60]], [[7, 8, 9], [40, 50, 60]]]
    with pytest.raises(ValueError, match="palette"):
        decode_png(good)


def test_files(spark):
    rng = np.random.default_rng(9)
    a = rng.integers(0, 256, (6, 10, 3)).astype(np.uint8)
    good = encode_png(a, (4,))
    broken = bytearray(good)
    broken[45] ^= 1
    odd = SIGNATURE + part(b"IHDR", (4).to_bytes(4) * 2 + bytes([16, 2, 0, 0, 0])) + part(b"IDAT", b"") + part(b"IEND", b"")
    short = SIGNATURE + part(b"IHDR", (4).to_bytes(4) * 2 + bytes([8, 2, 0, 0, 0])) + part(b"IDAT", zlib.compress(b"abc")) + part(b"IEND", b"")
    rows = [(1, good, "x"), (2, None, "x"), (3, b"", "x"), (4, b"\xff\xd8 no", None), (5, bytes(broken), "x"), (6, good[:-15], "x"), (7, odd, "x"), (8, short, "x"), (1, good, "x")]
    df = spark.createDataFrame(rows, "label int, content binary, Status string")
    got = decode_images(df).collect()
    assert [(r.label, r.status) for r in got] == [(1, "ok"), (2, "verify_failed:signature"), (3, "verify_failed:signature"), (4, "verify_failed:signature"), (5, "verify_failed:checksum"), (6, "verify_failed:cut off"), (7, "decode_failed:form"), (8, "decode_failed:size"), (1, "ok")]
    assert got[0].pixels == a.ravel().tolist() and (got[0].width, got[0].height) == (10, 6) and all(r.pixels is None for r in got[1:8])
    small = decode_images(df, size=4).first()
    assert small.pixels == resized(a, 4, 4).astype(int).ravel().tolist() and small.width == 10
    assert decode_images(df.limit(0)).count() == 0


def test_files_of_a_table_twice(spark):
    """Made and decoded in one plan, and again in the same session."""
    from lakeproof.plans import catalog

    for _ in range(2):
        rows = catalog.QUERIES["decoded_images"](spark, "/root/testdata/sf0.001").collect()
        assert {r.status for r in rows if r.vec_id % 13} == {"ok"} and all(r.weighted > 0 for r in rows if r.vec_id % 13)
        assert {(r.status, r.weighted) for r in rows if r.vec_id % 13 == 0} == {("verify_failed:cut off", 0)}
