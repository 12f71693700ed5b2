"""The encoder against the installed library, and the pipeline's stages on a small corpus."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lakeproof.llm.sentence_pieces import PieceModel, decode_documents, encode_documents, read_model
from lakeproof.llm.tables import cut, table, tokenizer_path
from lakeproof.llm.toxicity import seeded
from lakeproof.session import ship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return read_model(tokenizer_path())


def test_library(model):
    sentencepiece = pytest.importorskip("sentencepiece")
    own, lib = PieceModel.parse(model), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    rng = np.random.default_rng(0)
    texts = ["", " ", "  a  b", "日本語 𝔘𝔫𝔦", "a" * 300, " " * 40, "▁▁ x▁", "<s> </s> <0x0A>", "\x00\x01"]
    texts += ["".join(rng.choice(list("abcdeéß \n.,ABCintghero1234@😀"), 60)) for _ in range(300)]
    assert own.encode(texts) == lib.encode(texts)
    ids = lib.encode(texts)
    assert [own.decode(x) for x in ids] == [lib.decode(x) for x in ids]


def test_long_parts(model):
    """Texts without spaces: as the library has it, and in proportion to length."""
    import time

    sentencepiece = pytest.importorskip("sentencepiece")
    own, lib = PieceModel.parse(model), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    rng = np.random.default_rng(5)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他这", "aé😀\x00日"]
    texts = ["".join(rng.choice(list(a), n)) for a in alphabets for n in (47, 48, 49, 50, 200, 3_000)] + ["".join(rng.choice(["tion", "ing", "the", "x9"], 800))]
    assert own.encode(texts) == lib.encode(texts)
    blob = "".join(rng.choice(list(alphabets[0]), 300_000))
    began = time.process_time()
    assert own.encode([blob]) == lib.encode([blob])
    assert time.process_time() - began < 30


def test_refused_models():
    """Pieces that this encoder would treat wrongly are an error."""
    kinds = np.array([2, 1, 1, 4])
    with pytest.raises(ValueError):
        PieceModel(["<unk>", "a", "b", "ab"], np.zeros(4), kinds)
    with pytest.raises(ValueError):
        PieceModel(["<unk>", "a", "b", "ab"], np.zeros(4), np.array([2, 1, 1, 5]), model=2)
    m = PieceModel(["<unk>", "a", "b", "ab"], np.array([0.0, -1.0, -1.0, -0.1]), np.array([2, 1, 1, 5]), dummy_prefix=False)
    assert m.encode(["abab"]) == [[1, 2, 1, 2]]  # the unused piece is never given


def test_unigram():
    """Against every segmentation."""
    rng = np.random.default_rng(1)
    pieces = ["<unk>", *sorted({"".join(rng.choice(list("ab"), n)) for n in (1, 2, 3) for _ in range(12)} | {"a", "b"})]
    m = PieceModel(pieces, np.array([0.0, *-rng.random(len(pieces) - 1) * 5]), np.array([2] + [1] * (len(pieces) - 1)), dummy_prefix=False, squeeze=False)

    def best(t):
        if not t:
            return 0.0
        return max(m.scores[m.ids[t[:n]]] + best(t[n:]) for n in (1, 2, 3) if t[:n] in m.ids)

    for t in ("abab", "bbaabab", "aaaa"):
        assert np.isclose(sum(m.scores[i] for i in m.encode([t])[0]), best(t))


def test_documents(spark, model):
    ship(spark)
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello  there\n", "x")], "doc_id long, text string, ids string")
    rows = encode_documents(df, model)
    got = {r.doc_id: r for r in rows.collect()}
    assert got[1].ids == got[2].ids == [] and got[3].round_trip
    assert {r.doc_id: r.text for r in decode_documents(rows, model).collect()}[3] == "Hello  there\n"
    assert encode_documents(df.limit(0), model).count() == 0


def test_stages(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def kept_near(docs):
    """Ids of the least document of every group, by the definition."""
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset()) for i, t in docs.items() for w in [spaced((t or "").lower())]}
    group = {i: i for i in docs}
    for a, b in itertools.combinations(sorted(docs), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    return {i for i, g in group.items() if i == g}


def cut_by_hand(docs):
    words = {i: spaced(t) for i, t in docs.items()}
    seen = Counter(tuple(w[j : j + 35]) for w in words.values() for j in range(len(w) - 34))
    out = {}
    for i, w in words.items():
        gone = {j + k for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for k in range(35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        if not gone or kept:
            out[i] = kept if gone else docs[i]
    return out


def clean_by_hand(docs, items):
    alnum = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    windows = {tuple(w[j : j + 10]) for t in items for w in [alnum(t)] for j in range(max(len(w) - 9, min(len(w), 1)))}
    lengths = {len(w) for w in windows}
    return {i: t for i, t in docs.items() if not any(tuple(w[j : j + n]) in windows for w in [alnum(t)] for n in lengths for j in range(len(w) - n + 1))}


def test_stages_against_plain_python(spark, tmp_path, model):
    """All stages over planted cases, with nulls, a very long text, repeated rows and extra columns of clashing names."""
    ship(spark)
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(f"w{rng.integers(5_000)}" for _ in range(n))
    base, passage, item, long = prose(120), prose(60), prose(14), prose(20_000)
    texts = [None, "", "  ", "one", base, base, base + " and a tail", prose(80) + " " + passage, passage + " " + prose(90), prose(50) + " " + item + " " + prose(20), long, long + " end", prose(30)]
    texts += ["You idiot, you moron. You idiot, you scum. " + prose(20), "He said: you idiot. " + prose(20), prose(70), prose(70)]
    rows = [(i, t, "en", None, len(t or ""), 9.0, "x", "y", 1, None, True) for i, t in enumerate(texts)]
    rows.append(rows[12])
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, scored_text string, ranges string, held int, Kept_Text string, kept boolean"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, str(tmp_path), "documents")
    grammar = seeded()
    want = {i: t for i, t in enumerate(texts)}
    by_hand = [
        lambda d: {i: t for i, t in d.items() if grammar.score(t or "") < 0.5},
        lambda d: {i: d[i] for i in kept_near(d)},
        cut_by_hand,
        lambda d: clean_by_hand(d, [item]),
    ]
    for (name, stage), expected in zip(corpus_pipeline.STAGES, by_hand):
        before, docs = docs, cut(stage(spark, docs, str(tmp_path)), name)
        want = expected(want)
        assert docs.columns == before.columns
        got = docs.collect()
        assert {r.doc_id: r.text for r in got} == want, name
        assert Counter(r.doc_id for r in got)[12] == (2 if name == "toxicity" else 1)
        assert all((r.score, r.scored_text, r.ranges, r.held, r.Kept_Text, r.kept, r.source) == (9.0, "x", "y", 1, None, True, None) and r.n_chars == len(r.text or "") for r in got)
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    out = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: r.ids for r in out} == {i: lib.encode(t or "") for i, t in want.items()}
    assert 13 not in want and 14 in want and 5 not in want and 9 not in want and 11 not in want


def test_run(spark):
    n = table(spark, SF, "documents").count()
    rows = corpus_pipeline.run(spark, SF).collect()
    assert 0.5 * n < len(rows) < n and all(r.n_tokens == len(r.ids) for r in rows)
