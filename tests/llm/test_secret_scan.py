"""Secret scan: patterns by a second reading, the battery on known samples, the false-discovery step, all spans of the query."""

import hashlib
import re

import numpy as np

from lakeproof.llm.queries import op12_secret_scan
from lakeproof.llm.secret_scan import ENCODINGS, SecretParams, battery, bound, encoding_of, fisher, secret_scan, text_tail, unevenness
from lakeproof.session import ship

SF = "/root/testdata/sf0.01"
KINDS = ["assign", "access", "hex", "random"]


def patterns(text):
    """Case folding by the library, lengths tested after the match."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def token(rng, name, n):
    return "".join(rng.choice(list(ENCODINGS[name]), n))


def test_encodings():
    assert [encoding_of(x.encode())[0] for x in ("09af", "09AF", "ABZ2", "abz0", "AZ019", "aZ0", "aZ+/", "aZ-_")] == ["hex", "HEX", "base32", "base36", "BASE36", "base62", "base64", "base64url"]
    assert encoding_of(b"0123456789") is None and encoding_of(b"a+_") is None


def test_battery():
    """Random tokens pass about as often as promised; sequences, repeats, alternations and words don't."""
    rng = np.random.default_rng(0)
    for name, alphabet in ENCODINGS.items():
        passed = np.mean([fisher(battery(rng.integers(0, len(alphabet), n), len(alphabet))) >= 0.01 for n in (20, 40, 200) for _ in range(200)])
        assert passed > 0.95, name
    k = 16
    for bad in (np.zeros(30, int), np.arange(48) % 16, np.arange(40) % 2 * 15, np.repeat(np.arange(16), 4), rng.integers(0, 4, 60)):
        assert fisher(battery(bad, k)) < 0.01
    for word in ("onthtionwhonattionnd", "bananananasandanannas", "tttttttttttttttttttttt"):
        own = encoding_of(word.encode())
        assert fisher(battery(own[1], len(ENCODINGS[own[0]]))) < 0.01


def test_length_counts():
    """What is as even as random is likelier to be words the shorter it is."""
    counts = np.zeros(256, np.int64)
    counts[97:123] = np.arange(1, 27) ** 2
    uneven = unevenness(counts, "base36")
    tails = [text_tail(n, 35.0, 36, uneven) for n in (20, 40, 80)]
    assert tails[0] > tails[1] > tails[2] and unevenness(np.zeros(256, np.int64), "hex") == 0


def test_bound():
    """The histogram step against the textbook one on the bins' upper ends."""
    rng = np.random.default_rng(1)
    for _ in range(50):
        counts = {int(b): int(rng.integers(1, 9)) for b in rng.integers(0, 90, 6)}
        ps = sorted((10 ** (-b / 16) for b, n in counts.items() for _ in range(n)))
        most = max((i + 1 for i, p in enumerate(ps) if p <= 0.05 * (i + 1) / len(ps)), default=0)
        lowest = bound(counts, 0.05, 512)
        assert sum(n for b, n in counts.items() if b >= lowest) == most
    assert bound({}, 0.01, 512) == 512


def test_rows(spark):
    ship(spark)
    rng = np.random.default_rng(12)
    b64, upper, hexed = token(rng, "base64", 44), token(rng, "HEX", 40), token(rng, "hex", 40)
    words = ["internationalization", "the_configuration_value_of_an_option", "path/to/some/ordinary/folder", "1234567890123456789012345", "aaaaaaaaaaaaaaaaaaaaaaaaaa"]
    texts = [None, "", "plain words", f"x {b64} y", f"id={upper}.", f"sha {hexed} é", f"é PassWord : '{b64}' end", "token=ab secret=abcdef ſecret=abcdef", "AKIA" + "A1" * 8, "AKIAX", *words, "Whether the house is empty or not " * 2_000 + b64]
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)] + [(3, texts[3], "x", 1, "y"), (None, texts[3], "x", 1, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, N_hex int, found_spans string")
    out = secret_scan(df)
    assert out.columns == ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[3 if r.doc_id is None else r.doc_id] or ""
        base = patterns(t)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3)), t
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        own = [s for s in r.spans.split(",") if s.startswith("random")]
        assert r.n_random == len(own) and [s for s in r.spans.split(",") if s and s not in own] == [s for s in joined(base).split(",") if s]
    found = {r.doc_id: r.spans for r in got}
    assert found[3] == f"random:2:{2 + len(b64)}" and found[4] == f"random:3:{3 + len(upper)}" and found[15] == f"random:68000:{68000 + len(b64)}"
    assert found[5] == "hex:4:44" and found[6].startswith("assign:2:") and "random" not in found[6]  # covered by the pattern
    assert all(found[i] == "" for i in (0, 1, 2, 9, 10, 11, 12)) and all("random" not in found[i] for i in (13, 14))
    assert secret_scan(df.limit(0)).count() == 0


def test_false_discoveries(spark):
    """Planted tokens of all encodings are found; of invented words of the same length hardly any is."""
    ship(spark)
    rng = np.random.default_rng(3)
    parts = ["tion", "ment", "heit", "keit", "ver", "an", "re", "ou", "que", "ing", "lich", "zu", "es", "the"]
    names = ["base62", "base64", "base64url", "BASE36", "base36", "HEX"]
    rows = []
    for i in range(600):
        word = "".join(rng.choice(parts, 12))[:36]
        rows.append((i, f"some text {word} and {token(rng, names[i % 6], 36)} more" if i % 2 else f"some text {word} and more"))
    got = secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = [(r.doc_id, int(s.split(":")[1])) for r in got for s in r.spans.split(",") if s.startswith("random")]
    real = [x for x in found if x[1] > 20]
    assert len(real) >= 0.9 * 300 and len(found) - len(real) <= 0.05 * len(found)


def test_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op12_secret_scan(spark, SF).collect():
        base = patterns(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        own = {tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("random")}
        for a, b in own:  # what the method adds passes its tests and lies outside the patterns
            name, values = encoding_of(docs[r.doc_id][a:b].encode())
            assert fisher(battery(values, len(ENCODINGS[name]))) >= SecretParams().alpha and not any(x <= a and b <= y for x, _, y in base)
