"""The training-data operators on small tables, against brute force and on the awkward cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeproof.llm.decontamination import DecontaminationParams, contamination
from lakeproof.llm.html_text import extract_text, main_text
from lakeproof.llm.license_scan import license_scan
from lakeproof.llm.lm_scoring import LmParams, lm_scores
from lakeproof.llm.near_duplicates import near_duplicates
from lakeproof.llm.quality_rules import js_distance, quality_rules
from lakeproof.llm.sharding import ShardParams, shard_documents
from lakeproof.llm.substrings import SubstringParams, remove_repeats, repeated_windows
from lakeproof.session import ship
from lakeproof.llm.toxicity import fit, toxicity

SCHEMA = "doc_id long, text string, lang string, n_words int, words string, component_id string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n, size=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in rng.zipf(1.3, n) % size)


BASE, PASSAGE = prose(1, 120), prose(2, 60, 10_000)
LONG = prose(3, 30_000, 5_000)
TEXTS = [
    None, "", " \n\t ", "one", "Two words", BASE, BASE, BASE.upper(), BASE + " tail", BASE.replace("w1 ", "v ", 2), prose(4, 200), prose(5, 200) + " " + PASSAGE, PASSAGE + "\n" + prose(6, 150), LONG, LONG, prose(7, 40) + " " + BASE,
    "ha " * 200, "line here\nline here\n\nother line\nline here", "Licensed under the Apache License, Version 2.0.", "Über ÄÖ été 日本 😀 Über", "This is the MIT License and CC BY too; mit license.",
]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, 1, "x", "y") for i, t in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alnum(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))


def test_quality(docs, nothing):
    got = by_id(quality_rules(docs))
    for i, t in enumerate(TEXTS):
        w = spaced(t)
        c = Counter(zip(w, w[1:], w[2:]))
        inside = {j + k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if spaced(x)]
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(inside)), i
        assert got[i].n_dup_lines == len(lines) - len(set(lines))
        assert got[i].base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert not (got[i].base_failed and got[i].kept)
    assert quality_rules(nothing).count() == 0


def test_distance(spark):
    df = spark.createDataFrame([([1.0, 1.0], [1.0, 1.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "p array<double>, q array<double>")
    assert [round(r[0], 6) for r in df.select(js_distance("p", "q")).collect()][:2] == [0.0, 1.0]


def test_licenses(docs, nothing):
    got = by_id(license_scan(docs))
    assert (got[18].base_labels, got[18].labels) == ("apache", "apache")
    assert (got[20].base_labels, got[20].n_base, got[20].first_word, got[20].last_word) == ("cc-by,mit", 3, 3, 9)
    assert got[0].n_words == 0 and got[0].first_word is None and got[0].score == 0
    assert all(got[i].n_words == len(alnum(t)) for i, t in enumerate(TEXTS))
    assert license_scan(nothing).count() == 0


def test_contamination(spark, docs, nothing):
    items = spark.createDataFrame([(1, PASSAGE), (2, " ".join(PASSAGE.split()[5:20])), (3, "two WORDS"), (4, None), (5, ""), (6, prose(99, 30)), (7, "one")], "item_id long, text string")
    got = by_id(contamination(docs, items))
    windows = {}
    for r in items.collect():
        w = alnum(r.text)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(r.item_id)
    for i, t in enumerate(TEXTS):
        w, hit, ids = alnum(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    ids |= windows[k]
        digest = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (len(w), len(hit), len(ids), digest, bool(hit)), i
    # Without a broadcast the rows are the same, also those of a null id and of a row that stands twice.
    more = docs.unionByName(docs.where("doc_id = 11")).unionByName(docs.where("doc_id = 11").withColumn("doc_id", F.lit(None).cast("long")))
    joined = contamination(more, items, DecontaminationParams(broadcast_shingles=0)).collect()
    assert len(joined) == len(TEXTS) + 2 and all(tuple(r)[1:] == tuple(got[11 if r.doc_id is None else r.doc_id])[1:] for r in joined)
    assert contamination(nothing, items).count() == 0
    assert not any(r.contaminated for r in contamination(docs, items.limit(0)).collect())


def shingles(t):
    w = spaced((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def check_groups(df, texts):
    got = by_id(near_duplicates(df))
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), find(i), find(i) == i), i


def test_near_duplicates(docs, nothing):
    check_groups(docs, TEXTS)
    assert near_duplicates(nothing).count() == 0


def test_loose_group(spark):
    """A large group whose members lie on both sides of the threshold."""
    rng = np.random.default_rng(8)
    base = prose(9, 150, 5_000).split()
    texts = []
    for i in range(150):
        w = list(base)
        for j in rng.choice(len(w), rng.integers(1, 8), replace=False):
            w[j] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    check_groups(df, texts)


def test_substrings(docs, nothing):
    got = by_id(remove_repeats(docs))
    words = [spaced(t) for t in TEXTS]
    c = Counter(tuple(w[j : j + 35]) for w in words for j in range(len(w) - 34))
    for i, w in enumerate(words):
        gone = {j + k for j in range(len(w) - 34) if c[tuple(w[j : j + 35])] > 1 for k in range(35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(w), len(gone), kept), i
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert remove_repeats(nothing).count() == 0
    # Several shards give the same.
    assert {r.doc_id: r.n_removed for r in remove_repeats(docs, SubstringParams(shard_words=500)).collect()} == {i: r.n_removed for i, r in got.items()}


def test_repeated_ids(spark):
    """Rows that share an id, equal or not, or have none: every row gives one, clean texts stay whole."""
    ship(spark)
    long, other = prose(70, 3_000, 10**6), prose(71, 80, 10**6)
    rows = [(1, long), (1, "short"), (1, None), (2, long), (3, other), (3, other), (None, other), (4, prose(72, 50, 10**6)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(df).collect()
    assert len(got) == len(rows) and {r.doc_id: r.n_removed for r in got if r.doc_id in (2, 3, 4)} == {2: 3_000, 3: 80, 4: 0}
    near = near_duplicates(df).collect()
    assert len(near) == len(rows) and {r.doc_id: r.component_id for r in near if r.doc_id in (2, 3, 4)} == {2: 1, 3: 3, 4: 4}
    assert all(r.kept for r in near if r.doc_id is None)


def test_window_bounds():
    for window, gram in ((65, 8), (7, 8), (10, 0)):
        with pytest.raises(ValueError):
            SubstringParams(window=window, gram=gram)


def test_index():
    rng = np.random.default_rng(5)
    held = [rng.integers(0, 3, n).astype(np.uint32) for n in (12, 9, 30, 8)]
    c = Counter(tuple(x[j : j + 8]) for x in held for j in range(len(x) - 7))
    got = repeated_windows(held, np.ones(4, int), 8)
    assert [f.tolist() for f in got] == [[c[tuple(x[j : j + 8])] > 1 for j in range(len(x) - 7)] for x in held]


def test_html():
    assert main_text("") == "" and main_text("<script>x</script><nav>a</nav>") == ""
    page = "<body><header>Site</header><nav><a>x</a></nav><article class='post'><h1>A&amp;B</h1><p>One <b>bo</b>ld.<p>Two&nbsp;\n three<br>four</article><div class='comments'><p>Nice, really!</p></div><footer>f</footer>"
    assert main_text(page) == "A&B One bold. Two three four"
    plain = "<div class=ad>Buy, now!</div><div><p>The first, of some length, is here. It goes on and on.</p><p>Short.</p><p>With <a href=x>a link</a>, too.</p></div><form>Join</form>"
    assert main_text(plain) == "The first, of some length, is here. It goes on and on. Short. With a link, too."
    assert main_text("<p " * 5_000) is not None and main_text("<b>" * 3_000 + "x, y.") == "x, y."


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (2, "u", "<article><p>Hi, all.</article>", "t")], "page_id long, url string, html string, text string")
    assert {r.page_id: (r.text, r.n_chars) for r in extract_text(df).collect()} == {1: ("", 0), 2: ("Hi, all.", 8)}
    assert extract_text(df.limit(0)).count() == 0


def test_toxicity(spark, docs, nothing):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        w = prose(1000 + i, 40).split()
        if i % 4 == 0:
            w[rng.integers(40)] = rng.choice(["blorg", "snarfel"])
        rows.append((" ".join(w), int(i % 4 == 0)))
    train = spark.createDataFrame(rows[:300], "text string, toxic int")
    grammar = fit(train)
    test = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows[300:])], "doc_id long, text string, y int")
    assert all(r.predicted == r.y for r in toxicity(test, grammar).collect())
    assert all(0 <= r.score <= 1 for r in toxicity(docs, grammar).collect())
    assert toxicity(nothing, fit(train.limit(0))).count() == 0


@pytest.mark.parametrize("k", [2, 4])
def test_scores(docs, nothing, k):
    got = by_id(lm_scores(docs, LmParams(order=k, block_bytes=50_000)))
    import zlib
    from math import isclose, log10

    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(TEXTS))}
    counts, words = {}, Counter()
    for i, t in enumerate(TEXTS):
        if not out[i]:
            words.update(spaced((t or "").translate(LOWER)))
            words[None] += 1
            s = b"\0" * k + (t or "").encode() + b"\0"
            for j in range(k, len(s)):
                for o in range(k + 1):
                    counts.setdefault(s[j - o : j], Counter())[s[j]] += 1
    n, v = sum(words.values()), len(words)
    for i, t in enumerate(TEXTS):
        own = [*spaced((t or "").translate(LOWER)), None]
        base = sum(log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(own), sum(words[w] > 0 for w in own), n, out[i])
        assert isclose(got[i].base_score, base, rel_tol=1e-9)
        if len(t or "") > 5_000:
            continue
        s, total = b"\0" * k + (t or "").encode() + b"\0", 0.0
        for j in range(k, len(s)):
            seen = set()
            for o in range(k, -1, -1):
                left = {a: b for a, b in counts.get(s[j - o : j], {}).items() if a not in seen}
                if not left:
                    continue
                whole = sum(left.values()) + len(left)
                if s[j] in left:
                    total += log10(left[s[j]] / whole)
                    break
                total += log10(len(left) / whole)
                seen |= set(left)
            else:
                total -= log10(256 - len(seen))
        assert isclose(got[i].score, total, rel_tol=1e-9), i
    assert lm_scores(nothing).count() == 0


def test_scores_without_training(docs):
    """No row to learn from: every byte is one of 256, and the base formula gives 0."""
    for r in lm_scores(docs, is_held_out=F.lit(True)).where("doc_id < 9").collect():
        size = len((TEXTS[r.doc_id] or "").encode()) + 1
        assert r.train_tokens == 0 and abs(r.base_score) < 1e-9 and abs(r.score + size * np.log10(256)) < 1e-6


def test_shards(spark, docs, nothing):
    rng = np.random.default_rng(7)
    texts = [prose(i, int(rng.integers(5, 60))) for i in range(600)] + ["same " * 20] * 300 + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = shard_documents(df, ShardParams(bucket_rows=50)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    sizes, slots, where = Counter(), {}, {}
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert r.size == len(t) + 1 and r.law == "bytes" and r.grown_shard is None
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        where.setdefault(t, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 4 * max(r.size for r in rows)
    assert len(where[b"same " * 20]) <= 8
    assert shard_documents(docs).count() == len(TEXTS) and shard_documents(nothing).count() == 0
