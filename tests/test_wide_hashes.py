"""Hamming pairs of hashes of several words, against brute force."""

import numpy as np

from lakeproof.operators.dedup import hamming_pairs


def test_256_bits(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, 256)
    held = [base]
    for low, high, n in ((0, 64, 64), (0, 64, 63), (0, 256, 64), (0, 256, 65), (64, 192, 60), (192, 256, 40)):
        x = base.copy()
        x[rng.choice(np.arange(low, high), n, replace=False)] ^= 1
        held.append(x)
    held += [rng.integers(0, 2, 256) for _ in range(10)]
    words = [np.packbits(x.astype(np.uint8), bitorder="little").view(np.int64).tolist() for x in held]
    df = spark.createDataFrame(list(enumerate(words)), "id int, words array<long>")
    want = {(a, b, d) for b in range(len(held)) for a in range(b) if (d := int((held[a] != held[b]).sum())) <= 64}
    assert (0, 1, 64) in want
    assert {tuple(r) for r in hamming_pairs(df, 64, 256).collect()} == want
