"""The split rule against a loop over all groups, with ties, mixed groups and long runs."""

import hashlib
from collections import Counter
from fractions import Fraction

import numpy as np

from lakeproof.operators.splits import FRACTIONS, group_split, naive_split, share_runs


def one_by_one(groups, fractions=FRACTIONS):
    """``groups`` in order, each with its rows by class: deficit of the dominant class, then of all classes, then the name."""
    shares = {s: Fraction(str(f)) for s, f in fractions.items()}
    totals = Counter()
    for _, counts in groups:
        totals.update(counts)
    filled = {s: Counter() for s in shares}
    out = []
    for dominant, counts in groups:
        best = max(shares, key=lambda s: (shares[s] * totals[dominant] - filled[s][dominant], shares[s] * sum(totals.values()) - sum(filled[s].values()), s))
        filled[best].update(counts)
        out.append(best)
    return out


def test_runs():
    rng = np.random.default_rng(0)
    for k in range(300):
        fractions = FRACTIONS if k % 3 else {"a": 0.5, "b": 0.25, "c": 0.125, "d": 0.125}
        runs = []
        for size in sorted({int(x) for x in rng.integers(1, 30, rng.integers(1, 6))}, reverse=True):
            for c in "xyz":
                if rng.random() < 0.6:
                    mix = {c: size} if size < 4 or rng.random() < 0.7 else {c: size - 1, "q": 1}
                    runs.append((size, c, sorted(mix.items()), int(rng.integers(1, 200 if size < 3 else 12))))
        groups = [(c, dict(mix)) for _, c, mix, n in runs for _ in range(n)]
        got = []
        for (_, _, _, n), segments in zip(runs, share_runs(runs, fractions)):
            own = [None] * n
            for j, (a, turns) in enumerate(segments):
                upto = segments[j + 1][0] if j + 1 < len(segments) else n
                own[a:upto] = [turns[(i - a) % len(turns)] for i in range(a, upto)]
            got += own
        assert got == one_by_one(groups, fractions), runs
    # A long run takes a few segments.
    assert len(share_runs([(1, "x", [("x", 1)], 10**9)])[0]) < 12


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def test_group_split(spark):
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for g in range(300):
        label = [None, "a", "b", "c"][int(rng.integers(4))]
        for j in range(int(rng.choice([1, 1, 1, 2, 2, 3, 7, 20]))):
            rows.append((k, "c" if g % 50 == 0 and j == 1 else label, f"g{g}", "x"))
            k += 1
    rows.append((k, "a", None, "x"))
    df = spark.createDataFrame(rows, "k long, label string, grp string, note string")
    by = {}
    for k, label, g, _ in rows:
        if g is not None:
            by.setdefault(g, []).append((k, label))
    order = []
    for g, own in by.items():
        counts = Counter(label for _, label in own)
        first = {c: min(k for k, label in own if label == c) for c in counts}
        dominant = max(counts, key=lambda c: (counts[c], -first[c]))
        mix = sorted(((c is not None, c or ""), n) for c, n in counts.items())
        order.append((-len(own), (dominant is not None, dominant or ""), mix, number(f"{g}:42"), g, dominant, counts))
    order.sort(key=lambda x: x[:5])
    want = dict(zip([x[4] for x in order], one_by_one([x[5:] for x in order])))
    got = group_split(df, "k", "label", "grp")
    assert got.columns == ["k", "label", "grp", "split"]
    assert {r.k: r.split for r in got.collect()} == {k: want[g] for k, _, g, _ in rows if g is not None}
    assert group_split(df.limit(0), "k", "label", "grp").count() == 0


def test_naive_split(spark):
    rows = [(i, [None, "a", "b"][i % 7 % 3], 1) for i in range(200)]
    got = {r.k: r.split for r in naive_split(spark.createDataFrame(rows, "k long, label string, x int"), "k", "label").collect()}
    for c in (None, "a", "b"):
        own = sorted((number(f"{k}:42"), k) for k, label, _ in rows if label == c)
        n = len(own)
        assert [got[k] for _, k in own] == ["train"] * round(n * 0.7) + ["validation"] * round(n * 0.15) + ["test"] * (n - round(n * 0.7) - round(n * 0.15))
