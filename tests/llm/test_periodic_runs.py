"""Periodic runs against every stretch and period by definition."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lakeproof.llm.periodic_runs import RunParams, periodic_runs, planted, runs_of
from lakeproof.llm.queries import op11_periodic_runs
from lakeproof.session import ship

SF = "/root/testdata/sf0.001"


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def by_definition(w, least=6, times=4):
    """Maximal stretches of each period, of which those go that a smaller period gives too."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q) and j > i:
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def expected(doc_id, text):
    w = spaced(text)
    runs = by_definition(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def planted_by_hand(doc_id, text):
    h, w = zlib.crc32(str(doc_id).encode()), spaced(text)
    if doc_id is None or h % 10 or not w:
        return text
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))


def test_definition():
    rng = np.random.default_rng(0)
    for k in range(1500):
        n, at, p = int(rng.integers(0, 120)), int(rng.integers(0, 40)), int(rng.integers(1, 30))
        w = rng.integers(0, 1 + k % 4, n)
        if k % 3 and n > at + p:
            w = np.array([w[i] if i < at else w[at + (i - at) % p] for i in range(n)])
        params = RunParams(key_words=int(rng.integers(1, 9))) if k % 2 else RunParams()
        assert runs_of(w, params) == by_definition(w.tolist()), w.tolist()
    with pytest.raises(ValueError):
        RunParams(times=2)


def test_long_texts():
    """Constant, periodic and aperiodic sequences of some hundred thousand words."""
    rng = np.random.default_rng(1)
    assert runs_of(np.zeros(200_000, int)) == [(0, 200_000, 1)]
    assert runs_of(np.tile(rng.permutation(777), 300)) == [(0, 233_100, 777)]
    assert runs_of(rng.permutation(200_000)) == []


def test_rows(spark):
    """Nulls, empty texts, ties, repeated rows, texts side by side that would be periodic together, clashing columns."""
    ship(spark)
    texts = [None, "", " \n", "a", "a a a a a a", "a b " * 3, "a b " * 4, "x y\tx  y\nx y x y x y z q q q q q q", "ü ö ü ö ü ö ü ö ü", "a a a", "a a a", "p q r s " * 2_000 + "t " * 9, "A a " * 4]
    rows = [(i, t, 9, "s") for i, t in enumerate(texts)] + [(6, texts[6], 9, "s"), (None, texts[6], 9, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Start int, note string")
    out = periodic_runs(df)
    assert out.columns == ["doc_id", "note", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed_text"]
    got = sorted((tuple(r)[:1] + tuple(r)[2:-1] for r in out.collect()), key=str)
    assert got == sorted((expected(i, t) for i, t, *_ in rows), key=str)
    assert {r.doc_id: r.collapsed_text for r in out.collect()}[7] == "x y z q"
    assert periodic_runs(df.limit(0)).count() == 0


def test_planted(spark):
    rows = [(i, t) for i in range(60) for t in ("a b  c d\n" * 9, "", None)] + [(None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in planted(df).collect()]
    assert sorted(got, key=str) == sorted(((i, planted_by_hand(i, t)) for i, t in rows), key=str)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r.doc_id: expected(r.doc_id, planted_by_hand(r.doc_id, r.text)) for r in docs if len(r.text or "") < 6_000}
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs) and any(x[1] for x in want.values())
    assert all(got[i] == x for i, x in want.items())
