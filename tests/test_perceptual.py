"""Perceptual hashes, SSIM, both ways of pairing hashes, spanning forests: against plain loops."""

import math

import numpy as np
from pyspark.sql import functions as F

from lakeproof.operators import dedup, perceptual
from lakeproof.operators.perceptual import confirmed_images, hex_of, linked_images, perceptual_hashes, ssim, structural_similarity


def sampled(row, to):
    """Bilinear samples at half-pixel centres of a list, ends held."""
    out = []
    for i in range(to):
        s = (i + 0.5) * len(row) / to - 0.5
        a = math.floor(s)
        out.append(row[min(max(a, 0), len(row) - 1)] * (1 - s + a) + row[min(max(a + 1, 0), len(row) - 1)] * (s - a))
    return out


def resized(img, h, w):
    wide = [sampled(r, w) for r in img]
    return [list(r) for r in zip(*[sampled(list(col), h) for col in zip(*wide)])]


def packed(bits):
    return [int.from_bytes(int("".join("1" if b else "0" for b in bits[i : i + 64]), 2).to_bytes(8, "big"), "big", signed=True) for i in range(0, len(bits), 64)]


def hashes_by_hand(img):
    big = resized(img, 64, 64)
    cos = [[math.cos(math.pi * k * (2 * x + 1) / 128) for x in range(64)] for k in range(16)]
    half = [[sum(c * v for c, v in zip(cos[k], r)) for k in range(16)] for r in big]
    terms = [round(sum(cos[k][y] * half[y][m] for y in range(64)), 6) for k in range(16) for m in range(16)]
    middle = sorted(terms)
    middle = (middle[127] + middle[128]) / 2
    d = resized(img, 16, 17)
    a = [v for r in resized(img, 8, 8) for v in r]
    return packed([t > middle for t in terms]), packed([r[i + 1] > r[i] for r in d for i in range(16)]), packed([v > sum(a) / 64 for v in a])


def ssim_by_hand(a, b, n=7):
    out = []
    for y in range(len(a) - n + 1):
        for x in range(len(a[0]) - n + 1):
            p = [a[y + i][x + j] for i in range(n) for j in range(n)]
            q = [b[y + i][x + j] for i in range(n) for j in range(n)]
            mp, mq = sum(p) / 49, sum(q) / 49
            vp, vq, c = (sum((s - ms) * (t - mt) for s, t in zip(u, v)) / 48 for u, v, ms, mt in ((p, p, mp, mp), (q, q, mq, mq), (p, q, mp, mq)))
            out.append((2 * mp * mq + 6.5025) * (2 * c + 58.5225) / ((mp**2 + mq**2 + 6.5025) * (vp + vq + 58.5225)))
    return sum(out) / len(out)


def test_hashes(spark):
    rng = np.random.default_rng(0)
    shapes = [(8, 8), (20, 31), (64, 64), (100, 7), (1, 5)]
    imgs = [rng.uniform(0, 255, s).tolist() for s in shapes]
    rows = [(i, [v for r in img for v in r], len(img[0])) for i, img in enumerate(imgs)] + [(10, None, 8), (11, [], 8), (12, [1.0, 2.0, 3.0], 2), (13, [1.0], None)]
    df = spark.createDataFrame(rows, "k long, pixels array<double>, width int")
    got = {r.k: (r.phash, r.dhash, r.ahash) for r in perceptual_hashes(df, "k").collect()}
    for i, img in enumerate(imgs):
        assert tuple(got[i]) == tuple(hashes_by_hand(img)), i
    assert all(got[i] == (None, None, None) for i in (10, 11, 12, 13))
    assert perceptual_hashes(df.limit(0), "k").count() == 0
    assert spark.range(1).select(hex_of(F.array(F.lit(-1).cast("long"), F.lit(10).cast("long")))).first()[0] == "f" * 16 + "000000000000000a"


def test_ssim(spark):
    rng = np.random.default_rng(1)
    a = rng.uniform(0, 255, (5, 12, 9))
    b = np.clip(a + rng.normal(0, 20, a.shape), 0, 255)
    for x, y, v in zip(a, b, structural_similarity(a, b)):
        assert math.isclose(v, ssim_by_hand(x.tolist(), y.tolist()), rel_tol=1e-9)
    assert np.allclose(structural_similarity(a, a), 1)
    flat = lambda x: x.ravel().tolist()
    rows = [(flat(a[0]), flat(b[0]), 9), (flat(a[0]), flat(b[0])[:-9], 9), (None, flat(b[0]), 9), (flat(a[0]), None, 9), ([1.0] * 12, [1.0] * 12, 4)]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<double>, b array<double>, w int").select(ssim(F.col("a"), F.col("b"), F.col("w"))).collect()]
    assert math.isclose(got[0], ssim_by_hand(a[0].tolist(), b[0].tolist()), rel_tol=1e-9) and got[1:] == [None] * 4


def test_confirmation(spark):
    """Equal digests count without further evidence; unlike shapes and missing hashes confirm nothing."""
    px = [float(v) for v in np.random.default_rng(2).uniform(0, 255, 64)]
    rows = [(1, px, 8, [0], "x"), (2, px, 8, [0], "x"), (3, px, 8, [0], "y"), (4, px[:56], 8, [0], "z"), (5, px, 8, None, None), (6, px, 8, [-1], "q")]
    imgs = spark.createDataFrame(rows, "k long, pixels array<double>, width int, dhash array<long>, digest string")
    pairs = spark.createDataFrame([(1, 2, 60), (1, 3, 30), (2, 3, 40), (1, 4, 0), (1, 5, 0), (1, 6, 0)], "a long, b long, distance int")
    got = {(r.a, r.b): (r.exact, r.confirmed, r.duplicate) for r in confirmed_images(pairs, imgs, "k", 32).collect()}
    assert got == {(1, 2): (True, True, True), (1, 3): (False, True, True), (2, 3): (False, True, False), (1, 4): (False, False, False), (1, 5): (False, False, False), (1, 6): (False, False, False)}


def test_pairs(spark):
    """Chunk tables of any number and blocks give the pairs of a double loop; tables see a fraction of all pairs."""
    rng = np.random.default_rng(3)
    for bits, threshold, n in ((64, 9, 120), (256, 64, 150), (128, 3, 99)):
        held = rng.integers(0, 2, (n, bits))
        for i in range(0, n, 3):  # near copies at, below and above the threshold
            held[i + 1] = held[i]
            held[i + 1][rng.choice(bits, threshold + i % 3 - 1, replace=False)] ^= 1
        words = np.packbits(held.astype(np.uint8), axis=1).view(">i8").astype(np.int64).tolist()
        df = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(n, None)], "id long, words array<long>")
        want = {(a, b, d) for b in range(n) for a in range(b) if (d := int((held[a] != held[b]).sum())) <= threshold}
        assert len(want) > 20
        for chunks in (0, 16, 5 if bits == 64 else 32, None):
            assert {tuple(r) for r in dedup.hamming_pairs(df, threshold, bits, chunks).collect()} == want, (bits, chunks)
        assert {tuple(r) for r in dedup._block_pairs(df.where("words is not null"), threshold, 7).collect()} == want
        if bits == 256:
            assert dedup.chunk_candidates(df.where("words is not null"), threshold, bits, 16).select("a", "b").distinct().count() < n * n / 10


def test_plan():
    """Radii and chunk numbers make up the threshold; the tables are chosen where rows are many and the threshold is tight."""
    for bits, threshold, chunks in ((256, 64, 16), (256, 32, 12), (64, 20, 5), (64, 2, 16), (64, 0, 3)):
        plan = dedup.chunk_plan(bits, threshold, chunks)
        assert sum(r + 1 for _, _, r in plan) == threshold + 1 and all(w > 0 for _, w, _ in plan)
    assert dedup.best_chunks(2_000, 256, 64) == 0 and dedup.best_chunks(10**8, 256, 32) > 0 and dedup.best_chunks(10**7, 64, 3) > 0


def test_sweep(spark):
    rng = np.random.default_rng(4)
    n = 60
    edges = [(a, b, int(rng.integers(0, 10))) for a, b in {tuple(sorted(rng.choice(n, 2, replace=False).tolist())) for _ in range(70)}]
    exact = [(1, 2), (50, 51)]
    v = spark.range(n)
    e = spark.createDataFrame(edges, "a long, b long, distance int")
    forest = [tuple(r) for r in dedup.spanning_forest(e).collect()]

    def groups(pairs):
        root = list(range(n))
        for a, b in pairs:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    for t in range(10):
        assert groups([x[:2] for x in forest if x[2] <= t]) == groups([x[:2] for x in edges if x[2] <= t])
    assert len(forest) == n - len(set(groups([x[:2] for x in edges])))
    for links in (None, exact):
        out = dedup.sweep(v, e, [0, 3, 5, 9], links and spark.createDataFrame(links, "a long, b long"))
        for r in out.collect():
            sizes = np.bincount(groups([x[:2] for x in edges if x[2] <= r.threshold] + (links or [])), minlength=n)
            sizes = sizes[sizes > 0]
            assert tuple(r)[1:] == (sum(x[2] <= r.threshold for x in edges), len(sizes), (sizes > 1).sum(), sizes[sizes > 1].sum(), sizes.max())
    assert [tuple(r) for r in dedup.sweep(v, e.limit(0), [1]).collect()] == [(1, 0, n, 0, 0, 1)]


def test_groups_by_task_and_by_rounds(spark, monkeypatch):
    """One task, parts and rounds of joins find the same groups; a sweep of few edges runs few jobs."""
    rng = np.random.default_rng(5)
    n = 80
    pairs = {(int(a), int(b)) for a, b in (sorted(rng.choice(n, 2, replace=False)) for _ in range(130))}
    e = spark.createDataFrame([(f"k{a:02d}", f"k{b:02d}", int(rng.integers(0, 8))) for a, b in pairs], "a string, b string, distance int")
    v = spark.range(n).select(F.format_string("k%02d", "id").alias("id"))
    found = []
    for most in (1_000_000, 20):
        monkeypatch.setattr(dedup, "LOCAL_EDGES", most)
        monkeypatch.setattr(dedup, "PART_EDGES", 30 if most > 20 else 10)
        forest = dedup.spanning_forest(e).collect()
        found.append((len(forest), sum(r.distance for r in forest), sorted(map(tuple, dedup.components(v, e.where("distance < 2")).collect()))))
    assert found[0] == found[1]
    monkeypatch.undo()
    spark.sparkContext.setJobGroup("sweep", "")
    dedup.sweep(v, e, [0, 2, 4, 7]).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("sweep"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < 45


def test_sweep_of_a_long_chain(spark):
    """Three hundred rows in a chain are one group, in as many jobs as a short one."""
    order = np.random.default_rng(6).permutation(300).tolist()
    e = spark.createDataFrame([(min(p), max(p), i % 3) for i, p in enumerate(zip(order, order[1:]))], "a long, b long, distance int")
    spark.sparkContext.setJobGroup("chain", "")
    got = [tuple(r) for r in dedup.sweep(spark.range(300), e, [1, 2]).collect()]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(got) == [(1, 200, 100, 100, 300, 3), (2, 299, 1, 1, 300, 300)] and 0 < jobs < 45


def test_sweep_of_copies_only(spark):
    """Exact copies in a long chain count as one group at every one of 33 thresholds, in as many jobs as at one; pairs of none."""
    order = np.random.default_rng(7).permutation(200).tolist()
    copies = spark.createDataFrame([(min(p), max(p)) for p in zip(order, order[1:])], "a long, b long")
    spark.sparkContext.setJobGroup("copies", "")
    got = dedup.sweep(spark.range(201), spark.createDataFrame([], "a long, b long, distance int"), list(range(0, 65, 2)), copies).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("copies"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {tuple(r)[1:] for r in got} == {(0, 2, 1, 200, 200)} and len(got) == 33 and 0 < jobs < 45


def test_links_of_images(spark, monkeypatch):
    """A sweep over what tasks of two blocks keep equals one over every pair, with near and equal copies, shapes and missing digests."""
    for name, value in (("BLOCK_IMAGES", 40), ("CELLS", 300), ("VALUES", 1000)):
        monkeypatch.setattr(perceptual, name, value)
    rng = np.random.default_rng(5)
    rows, base = [], rng.uniform(0, 255, (12, 64))
    for i in range(260):
        px = base[i % 12] + (rng.normal(0, rng.choice([0.5, 6, 25]), 64) if i % 5 else 0)
        if i % 31 == 0:
            px = px + 1e-5 * i  # equal by digest only
        digest = None if i % 17 == 0 else ",".join(f"{v:.1f}" for v in px)
        rows.append((i, (px[:48] if i % 13 == 0 else px).tolist(), 16 if i % 19 == 0 else 8, digest))
    rows += [(300, [float("nan")] * 64, 8, "x"), (301, [float("nan")] * 64, 8, "y"), (302, None, 8, None), (303, [1.0] * 7, 8, "z"), (304, [1.0, 2.0] * 8, 8, "small"), (305, [1.0, 2.0] * 8, 8, "small")]
    images = spark.createDataFrame(rows, "image_id long, pixels array<double>, width int, digest string")
    images = images.join(perceptual_hashes(images, "image_id"), "image_id").cache()
    v = images.select(F.col("image_id").alias("id"))
    near = dedup.hamming_pairs(images.select(F.col("image_id").alias("id"), F.col("phash").alias("words")), 64, 256)
    pairs = confirmed_images(near, images, "image_id", 32).where("exact or confirmed").cache()
    copies = images.join(images.groupBy("digest").agg(F.min("image_id").alias("a")), "digest").where("image_id != a").select("a", F.col("image_id").alias("b"))
    links = linked_images(images, "image_id", 64).cache()
    grid = list(range(0, 65, 4))
    assert sorted(map(tuple, dedup.sweep(v, links, grid, copies).collect())) == sorted(map(tuple, dedup.sweep(v, pairs, grid, copies).collect()))
    assert links.agg(F.sum("links")).first()[0] == pairs.count()
    assert 4 * links.count() < 3 * pairs.count()
    assert links.where("a >= b or links < 1").count() == 0
    images.unpersist(), pairs.unpersist(), links.unpersist()


def test_links_of_many_near_copies(spark):
    """The pairs of a group of near copies grow with its square, the rows that the sweep gets don't."""
    rng = np.random.default_rng(6)
    base = rng.uniform(0, 255, 64)
    images = spark.createDataFrame([(i, (base + rng.normal(0, 0.3, 64)).tolist(), 8, str(i)) for i in range(500)], "image_id long, pixels array<double>, width int, digest string")
    images = images.join(perceptual_hashes(images, "image_id"), "image_id")
    (got,) = linked_images(images, "image_id", 64).agg(F.count("*").alias("rows"), F.sum("links").alias("links")).collect()
    assert got.links > 100_000 and got.rows < 2_000


def test_forest_of_sparse_edges(spark, monkeypatch):
    """Parts too small to hold circles grow until what is left is one task: no rounds of joins."""
    monkeypatch.setattr(dedup, "PART_EDGES", 50)
    monkeypatch.setattr(dedup, "LOCAL_EDGES", 800)
    monkeypatch.setattr(dedup, "components", None)
    rng = np.random.default_rng(8)
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 200, (3000, 2)) if a != b})
    edges = [(a, b, (a * 7 + b * 3) % 11) for a, b in edges]
    root, weights = list(range(200)), []
    for a, b, d in sorted(edges, key=lambda e: e[2]):
        a, b = root[a], root[b]
        if a != b:
            weights.append(d)
            root = [a if r == b else r for r in root]
    got = [r.distance for r in dedup.spanning_forest(spark.createDataFrame(edges, "a long, b long, distance int")).collect()]
    assert sorted(got) == sorted(weights)
