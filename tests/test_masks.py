"""Segmentation, composites and corruptions against plain loops and flood fills."""

import math
from statistics import median

import numpy as np
import pytest

from lakeproof.operators import masks as m
from lakeproof.plans.copies import SMALL, corrupted_images, object_composites, object_masks
from lakeproof.plans.fixtures import scenes

SF = "/root/testdata/sf0.001"


def near(h, w, y, x, r):
    return [(j, i) for j in range(y - r, y + r + 1) for i in range(x - r, x + r + 1) if (j - y) ** 2 + (i - x) ** 2 <= r * r and 0 <= j < h and 0 <= i < w]


def by_disk(mask, r, want_all):
    h, w = mask.shape
    return np.array([[(all if want_all else any)(mask[p] for p in near(h, w, y, x, r)) for x in range(w)] for y in range(h)])


def flood(free, starts, steps):
    seen, todo = set(starts), list(starts)
    while todo:
        y, x = todo.pop()
        for dy, dx in steps:
            p = (y + dy, x + dx)
            if p not in seen and 0 <= p[0] < free.shape[0] and 0 <= p[1] < free.shape[1] and free[p]:
                seen.add(p)
                todo.append(p)
    return seen


CROSS = [(0, 1), (1, 0), (0, -1), (-1, 0)]
AROUND = CROSS + [(1, 1), (1, -1), (-1, 1), (-1, -1)]


def filled_by_hand(mask):
    h, w = mask.shape
    edge = [(y, x) for y in range(h) for x in range(w) if not mask[y, x] and (y in (0, h - 1) or x in (0, w - 1))]
    out = flood(~mask, edge, CROSS)
    return np.array([[(y, x) not in out for x in range(w)] for y in range(h)])


def parts_by_hand(mask):
    left, parts = set(zip(*np.nonzero(mask))), []
    left = {(int(y), int(x)) for y, x in left}
    for p in sorted(left):
        if p in left:
            own = flood(mask, [p], AROUND)
            parts.append(own)
            left -= own
    return parts


def mask_by_hand(rgb, ring, opening, closing):
    h, w = rgb.shape[:2]
    outer = [(y, x) for y in range(h) for x in range(w) if y < ring or y >= h - ring or x < ring or x >= w - ring]
    sat = lambda p: round((max(p) - min(p)) * 255 / max(p)) if max(p) else 0
    border = median(sat(rgb[p].tolist()) for p in outer)
    if border < 60:
        lab = m.lab(rgb)
        back = [median(lab[p][c] for p in outer) for c in range(3)]
        score = np.array([[math.dist(lab[y, x], back) for x in range(w)] for y in range(h)])
    else:
        score = np.array([[sat(rgb[y, x].tolist()) for x in range(w)] for y in range(h)], float)
    mask = score > m.threshold(score)
    for r, order in ((opening, (True, False)), (closing, (False, True))):
        for want_all in order:
            mask = by_disk(mask, r, want_all)
    mask = filled_by_hand(mask)
    parts = parts_by_hand(mask)
    cut = lambda s: any(y in (0, h - 1) or x in (0, w - 1) for y, x in s)
    inside = [s for s in parts if not cut(s) and len(s) >= 0.01 * h * w]
    best = max(inside or parts, key=len) if parts else set()
    return np.array([[(y, x) in best for x in range(w)] for y in range(h)]), len(parts), bool(best) and cut(best), border


def test_colour():
    """Known colours: white, black and the primaries."""
    rgb = np.array([[255, 255, 255], [0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255], [128, 128, 128]])
    assert m.lab(rgb).tolist() == [[255, 128, 128], [0, 128, 128], [136, 208, 195], [224, 42, 211], [82, 207, 20], [137, 128, 128]]
    assert m.saturation(rgb).tolist() == [0, 0, 255, 255, 255, 0]


def test_threshold():
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(10, 2, 300), rng.normal(60, 5, 100)])
    counts, edges = np.histogram(v, 256)
    mid = (edges[1:] + edges[:-1]) / 2

    def apart(k):
        a, b = counts[: k + 1], counts[k + 1 :]
        return a.sum() * b.sum() * ((a * mid[: k + 1]).sum() / a.sum() - (b * mid[k + 1 :]).sum() / b.sum()) ** 2

    assert m.threshold(v) == mid[max(range(255), key=apart)] and m.threshold(np.full(5, 3.0)) == 3.0


def test_steps():
    rng = np.random.default_rng(1)
    for k in range(12):
        mask = rng.random((17, 23)) < (0.2, 0.5, 0.8)[k % 3]
        r = k % 4
        assert (m.dilated(mask, r) == by_disk(mask, r, False)).all() and (m.eroded(mask, r) == by_disk(mask, r, True)).all()
        assert (m.filled(mask) == filled_by_hand(mask)).all()
        got = m.components(mask)
        assert sorted(sorted(zip(*np.nonzero(got == n))) for n in np.unique(got[got >= 0])) == sorted(sorted(s) for s in parts_by_hand(mask))
        want = mask
        for _ in range(r):
            want = np.array([[want[y, x] or any(want[y + a, x + b] for a, b in CROSS if 0 <= y + a < 17 and 0 <= x + b < 23) for x in range(23)] for y in range(17)])
        assert (m.grown(mask, r) == want).all()
    spiral = np.zeros((41, 41), bool)  # a long winding path is one component
    spiral[::2] = True
    spiral[1::4, -1] = spiral[3::4, 0] = True
    assert len(np.unique(m.components(spiral))) == 2


def test_masks(spark):
    rows = {r.vec_id: np.array(r.pixels, float).reshape(32, 32, 3) for r in scenes(spark, SF).where("vec_id < 40 or vec_id in (77, 110)").collect()}
    found = {r.vec_id: r for r in object_masks(spark, SF).collect()}
    sizes = []
    for i, rgb in rows.items():
        mask, n, cut, border = mask_by_hand(rgb, **SMALL)
        got, how = m.object_mask(rgb, **SMALL)
        assert (got == mask).all(), i
        r = found[i]
        assert (r.n_components, r.touches_border, r.border_saturation, r.status) == (n, cut, border, "ok" if n else "empty") and abs(r.area_fraction - mask.mean()) < 1e-5
        assert r.basis == ("saturation" if border >= 60 else "lab_distance_from_border_median") == how["basis"]
        sizes.append(mask.mean())
    assert sum(0.05 < s < 0.35 for s in sizes) > 0.6 * len(sizes)


def test_composites(spark):
    rgb = next(np.array(r.pixels, float).reshape(32, 32, 3) for r in scenes(spark, SF).where("vec_id = 4").collect())
    mask = m.object_mask(rgb, **SMALL)[0]
    got = m.composites(rgb, mask, cover=3, keep=1)
    colour = [math.floor(median(rgb[p][c] for p in zip(*np.nonzero(~m.grown(mask, 3))))) for c in range(3)]
    assert all(got["background_only"][y, x].tolist() == (colour if m.grown(mask, 3)[y, x] else rgb[y, x].tolist()) for y in range(32) for x in range(32))
    assert all(got["object_only"][y, x].tolist() == (rgb[y, x].tolist() if m.grown(mask, 1)[y, x] else colour) for y in range(32) for x in range(32))
    ys, xs = np.nonzero(mask)
    box = rgb[max(0, ys.min() - 4) : ys.max() + 5, max(0, xs.min() - 4) : xs.max() + 5]
    assert (got["object_crop"] == m.resized(box, 32, 32)).all()
    assert (m.composites(rgb, np.zeros((32, 32), bool))["object_crop"] == rgb).all()
    assert object_composites(spark, SF).count() == 3 * scenes(spark, SF).count()


def test_resized():
    """Enlarged: bilinear at half pixels. Halved: triangle over four pixels. The same size: nothing changes."""
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (6, 5, 3)).astype(float)
    assert (m.resized(a, 6, 5) == a).all()

    def sample(row, s):
        low = math.floor(s)
        pick = lambda i: row[min(max(i, 0), len(row) - 1)]
        return pick(low) * (1 - s + low) + pick(low + 1) * (s - low)

    got = m.resized(a, 12, 11)
    wide = np.array([[[math.floor(sample(a[y, :, c], (x + 0.5) * 5 / 11 - 0.5) + 0.5) for c in range(3)] for x in range(11)] for y in range(6)], float)
    want = np.array([[[math.floor(sample(wide[:, x, c], (y + 0.5) / 2 - 0.5) + 0.5) for c in range(3)] for x in range(11)] for y in range(12)])
    assert np.abs(got - want).max() <= 1
    assert np.allclose(m.triangle(8, 4)[1], [0, 0.125, 0.375, 0.375, 0.125, 0, 0, 0])


@pytest.mark.parametrize("severity", [1, 3])
def test_corruptions(severity):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (16, 24, 3)).astype(float)
    h, w = 16, 24
    value = {n: v[severity - 1] for n, v in m.SEVERITIES.items()}
    clip = lambda v: min(max(v, 0), 255)
    each = lambda f: np.array([[[f(y, x, c) for c in range(3)] for x in range(w)] for y in range(h)], float)
    grey = [math.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5) for r, g, b in a.reshape(-1, 3)]
    middle = math.floor(sum(grey) / len(grey) + 0.5)
    k = value["motion_blur"]
    at = lambda y, x, c: a[min(max(y, 0), h - 1), min(max(x, 0), w - 1), c]

    def turned(y, x, c):
        t = math.radians(value["rotation"])
        sx = math.cos(t) * (x + 0.5 - w / 2) - math.sin(t) * (y + 0.5 - h / 2) + w / 2
        sy = math.sin(t) * (x + 0.5 - w / 2) + math.cos(t) * (y + 0.5 - h / 2) + h / 2
        if not (0 <= sx < w and 0 <= sy < h):
            return 255
        sx, sy = sx - 0.5, sy - 0.5
        i, j = math.floor(sx), math.floor(sy)
        return math.floor(sum(at(j + p, i + q, c) * (sy - j if p else 1 - sy + j) * (sx - i if q else 1 - sx + i) for p in (0, 1) for q in (0, 1)) + 0.5)

    want = {
        "brightness_down": each(lambda y, x, c: math.floor(a[y, x, c] * value["brightness_down"])),
        "brightness_up": each(lambda y, x, c: clip(math.floor(a[y, x, c] * value["brightness_up"]))),
        "contrast_down": each(lambda y, x, c: clip(math.floor(middle + value["contrast_down"] * (a[y, x, c] - middle)))),
        "motion_blur": each(lambda y, x, c: math.floor(sum(at(y, x + i - k // 2, c) for i in range(k)) / k)),
        "rotation": each(turned),
    }
    for name, img in want.items():
        assert np.abs(m.corrupted(a, name, severity) - img).max() <= (1e-9 if name != "rotation" else 1), name
    share = value["crop_zoom"]
    ch, cw = int(h * share), int(w * share)
    assert (m.corrupted(a, "crop_zoom", severity) == m.resized(a[(h - ch) // 2 : (h - ch) // 2 + ch, (w - cw) // 2 : (w - cw) // 2 + cw], h, w)).all()
    s = value["gaussian_blur"]
    r = int(4 * s + 0.5)
    g = [math.exp(-0.5 * (i / s) ** 2) for i in range(-r, r + 1)]
    y, x = 7, 3
    want = sum(g[i] * g[j] * at(y + i - r, x + j - r, 1) for i in range(2 * r + 1) for j in range(2 * r + 1)) / sum(g) ** 2
    assert abs(m.corrupted(a, "gaussian_blur", severity)[y, x, 1] - want) <= 0.5 + 1e-9


def test_jpeg():
    """One grey block by the double sum; flat images stay, low quality costs more."""
    rng = np.random.default_rng(4)
    block = rng.integers(0, 256, (8, 8)).astype(float)
    table = m.quantisation(m._LUMA, 20)
    c = lambda k: math.sqrt(1 / 8) if k == 0 else 0.5
    cos = lambda k, x: math.cos(math.pi * k * (2 * x + 1) / 16)
    terms = [[c(u) * c(v) * sum((block[y, x] - 128) * cos(u, y) * cos(v, x) for y in range(8) for x in range(8)) for v in range(8)] for u in range(8)]
    kept = [[round(terms[u][v] / table[u, v]) * table[u, v] for v in range(8)] for u in range(8)]
    back = [[min(max(round(128 + sum(c(u) * c(v) * kept[u][v] * cos(u, y) * cos(v, x) for u in range(8) for v in range(8))), 0), 255) for x in range(8)] for y in range(8)]
    got = m.jpeg(np.repeat(block[..., None], 3, axis=2), 20)
    assert np.abs(got - np.array(back)[..., None]).max() <= 1e-9
    assert m.quantisation(m._LUMA, 50)[0].tolist() == [16, 11, 10, 16, 24, 40, 51, 61] and m.quantisation(m._CHROMA, 100).max() == 1
    flat = np.full((13, 10, 3), 128.0)
    assert (m.jpeg(flat, 10) == flat).all()
    a = np.kron(rng.integers(0, 256, (5, 6, 3)), np.ones((4, 4, 1))).astype(float)
    assert np.abs(m.jpeg(a, 90) - a).mean() < np.abs(m.jpeg(a, 10) - a).mean()


def test_rows(spark):
    rows = [(1, 4, [10.0] * 48), (2, 4, None), (3, None, [1.0] * 12), (4, 4, [1.0] * 13), (5, 4, []), (1, 4, [10.0] * 48)]
    df = spark.createDataFrame(rows, "k long, width int, pixels array<double>")
    got = m.segment_objects(df, "k", ring=1, opening=1, closing=1).collect()
    assert sorted((r.k, r.status) for r in got) == [(1, "empty"), (1, "empty"), (2, "no_image"), (3, "no_image"), (4, "no_image"), (5, "no_image")]
    assert m.corrupt_images(df, "k", ("rotation",), (2,)).count() == 2 and m.object_composites(df, "k", {"ring": 1}).count() == 6
    assert m.segment_objects(df.limit(0), "k").count() == 0
    assert corrupted_images(spark, SF).count() == 24 * scenes(spark, SF).count()


def test_stacks(spark):
    """Images of several shapes, corrupted in stacks, are what they are one by one; measures are those of the same pixels."""
    rng = np.random.default_rng(5)
    shapes = [(5, 7), (9, 16), (5, 7), (16, 9), (9, 16), (1, 1), (5, 7)]
    rows = [(i, w, rng.integers(0, 256, h * w * 3).astype(float).tolist()) for i, (h, w) in enumerate(shapes)] + [(50, 4, [1.0] * 13), (51, 0, [1.0] * 3), (52, 4, None), (None, 7, [9.0] * 105)]
    df = spark.createDataFrame(rows, "k long, width int, pixels array<double>").coalesce(1)
    got = {(r.k, r.corruption, r.severity): (r.width, r.pixels) for r in m.corrupt_images(df, "k").collect()}
    assert len(got) == 24 * 8
    for k, w, pixels in [*rows[:7], rows[-1]]:
        a = np.array(pixels).reshape(-1, w, 3)
        for n in m.CORRUPTIONS:
            for s in (1, 2, 3):
                assert got[k, n, s] == (w, m.corrupted(a, n, s).ravel().tolist()), (k, n, s)
    for r in m.corrupt_images(df, "k", severities=(2,), measures={"top": lambda v: v.max(axis=1), "n": lambda v: np.full(len(v), v.shape[1])}).collect():
        w, pixels = got[r.k, r.corruption, 2]
        assert (r.top, r.n) == (max(pixels), len(pixels))


def test_corrupted_in_tasks(spark):
    """The query's sums are taken where the pixels are made: before, every pixel of 24 images a row went back to Spark's expressions."""
    df = corrupted_images(spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "lambda" not in plan
    some = scenes(spark, SF).where("vec_id < 5")
    want = {(r.vec_id, r.corruption, r.severity): r.pixels for r in m.corrupt_images(some, "vec_id").collect()}
    got = {(r.vec_id, r.corruption, r.severity): (r.mean, r.weighted) for r in df.where("vec_id < 5").collect()}
    assert got.keys() == want.keys() and len(got) == 120
    assert all(abs(got[k][0] - sum(v) / 3072) < 1e-6 and got[k][1] == sum(x * (i % 97) for i, x in enumerate(v)) for k, v in want.items())


def test_scenes(spark, tmp_path):
    """Drawn by batches as by the definition, place by place; without a value a place is white."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 2, 64).tolist()) for i in [*range(24), -3, -35, 10**12]]
    rows += [(103, [1.0] * 9), (104, []), (106, None), (107, [None, float("nan"), float("inf"), float("-inf")] * 16), (None, [0.5] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.pixels for r in scenes(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and {len(p) for p in got.values()} == {3072} and set(got[None]) == {255}
    for v, e in rows[:-1]:
        e = [None if x is None or math.isnan(x) else float(np.float32(x)) for x in e or []] + [None] * 64
        cx, cy, r = 1 if v % 7 == 0 else 11 + math.fmod(v, 9), 12 + math.fmod(v, 8), 5 + math.fmod(v, 4)
        for k, p in enumerate(got[v]):
            y, x, c = k // 96, k // 3 % 32, k % 3
            d = (x - cx) ** 2 + (y - cy) ** 2
            value = ((190, 120, 40) if v % 5 == 0 else (236, 233, 228))[c] + math.fmod(k * 37 + v * 11, 7)
            if 2 < d <= r * r and v % 11:
                t = e[y // 4 * 8 + x // 4]
                value = 255 if t is None else (60, 130, 45)[c] + 60 * t
            assert p == math.floor(max(min(value, 255), 0)), (v, k)
