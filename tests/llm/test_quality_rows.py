"""Distances and verdicts of whole rows, and repeated windows of long texts, by plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from lakeproof.llm import quality_rules as q
from lakeproof.session import ship

SF = "/root/testdata/sf0.001"


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def histograms(t):
    t, w = t or "", spaced(t)
    inside = sum(map(len, w))
    classes = [sum(t.count(c) for c in marks) for marks in q.CLASSES.values()] + [len(t.encode()) - len(t)]
    return [*classes, len(t) - inside, inside - sum(classes)], [w.count(x) for x in q.COMMON_WORDS]


def distance(a, b):
    if not sum(a) or not sum(b):
        a, b = (([0.0] * len(x)) if not sum(x) else [v / sum(x) for v in x] for x in (a, b))
    else:
        a, b = [v / sum(a) for v in a], [v / sum(b) for v in b]
    part = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
    return math.sqrt(max(0.0, sum(part(x, (x + y) / 2) + part(y, (x + y) / 2) for x, y in zip(a, b)) / 2))


def repeated(w):
    c = Counter(zip(w, w[1:], w[2:]))
    return len({j + k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in range(3)})


def by_hand(rows, p=q.QualityParams()):
    """``id: (base_failed, char_distance, word_distance, kept)`` of ``id, text, lang``."""
    own = {i: (*histograms(t), len(spaced(t)), lang or "") for i, t, lang in rows}
    refs = {}
    for c, w, n, lang in own.values():
        a, b, m = refs.get(lang, ([0] * len(c), [0] * len(w), 0))
        refs[lang] = ([x + y for x, y in zip(a, c)], [x + y for x, y in zip(b, w)], m + n)
    out = {}
    for i, t, _ in rows:
        c, w, n, lang = own[i]
        rc, rw, rn = refs[lang]
        failed = n < p.min_words or 100 * repeated(spaced(t)) > p.max_repeat_percent * n
        cd = distance(c, rc) if sum(c) >= p.min_chars else None
        expected = n * sum(rw) / max(rn, 1)
        judged = sum(w) >= p.min_common or expected >= (p.min_expected if sum(w) else p.min_expected_none)
        wd = (distance(w, rw) if sum(w) else 1.0) if sum(rw) and judged else None
        out[i] = (failed, cd, wd, not failed and (cd or 0) <= p.max_char_distance and (wd or 0) <= p.max_word_distance)
    return out


def same(got, want):
    for r in got:
        failed, cd, wd, kept = want[r.doc_id]
        assert (r.base_failed, r.kept) == (failed, kept), r.doc_id
        for x, y in ((r.char_distance, cd), (r.word_distance, wd)):
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, abs_tol=1e-9)), r.doc_id


def test_table(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = by_hand([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    same(q.quality_rules(docs).collect(), want)
    assert len({k for *_, k in want.values()}) == 2


def test_odd_rows(spark):
    """Languages of few rows, texts of symbols, clashing columns."""
    ship(spark)
    prose = "the cat and the dog of a house in the town, to be or not. " * 30
    rows = [(0, None, None), (1, prose, "en"), (2, "#$%& <> " * 60, "en"), (3, "und die der das " * 40, "en"), (4, prose.upper(), "en"), (5, prose, None), (6, "日本 語 " * 120, "ja"), (7, "", "ja")]
    df = spark.createDataFrame([(*r, 0.5, True) for r in rows], "doc_id long, text string, lang string, char_distance double, kept boolean")
    same(q.quality_rules(df).collect(), by_hand(rows))
    assert q.quality_rules(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [q.PACKED_WORDS - 1, q.PACKED_WORDS, q.PACKED_WORDS + 1, 40_000])
def test_long_texts(spark, n):
    """Windows are compared alike on either side of the packed size."""
    ship(spark)
    rng = np.random.default_rng(n)
    text = " ".join(f"w{i}" for i in rng.integers(0, int((n * n / 40) ** (1 / 3)), n))
    df = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, lang string")
    assert q.quality_rules(df).first().n_repeat_words == repeated(spaced(text)) > 0
