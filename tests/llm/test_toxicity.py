"""The grammar of clauses: its composition against running the transducers one after another, and constructed clauses."""

import itertools

import pytest

from lakeproof.llm.toxicity import Grammar, composed, fit, labelled, seeded, toxicity, transducers
from lakeproof.session import ship


def one_after_another(symbols):
    found = {symbols: 0.0}
    for t in transducers():
        new = {}
        for word, weight in found.items():
            paths = [(0, "", weight)]
            for read in word:
                paths = [(to, out + write, w + more) for state, out, w in paths for write, more, to in t.arcs.get((state, read), ())]
            for state, out, w in paths:
                if state in t.final:
                    new[out] = max(new.get(out, w), w)
        found = new
    return min((-w, out) for out, w in found.items())


def test_composition():
    machine = composed()
    for n in range(1, 5):
        for symbols in map("".join, itertools.product("otnrihc", repeat=n)):
            weight, out = machine.best(symbols)
            assert (-weight, out) == one_after_another(symbols), symbols


CLAUSES = {
    "you idiot": [1, 1, 0, 0], "what an idiot": [1, 0, 0, 0], "never an idiot": [0, 0, 1, 0], "You are not an idiot": [0, 0, 1, 0], "She said you are an idiot": [0, 0, 0, 1], "You idiot, he said": [0, 0, 0, 1],
    "She left, he said. You idiot": [1, 1, 0, 0], "not nice, but an idiot": [1, 0, 0, 0], "No, you idiot": [1, 1, 0, 0], "I will kill you": [1, 1, 0, 0], "They will never hurt you": [0, 0, 1, 0],
    "burn the cake in the oven": [0, 0, 0, 0], "I will kill time": [0, 0, 0, 0], "kill": [0, 0, 0, 0], "": [0, 0, 0, 0], "you idiot, you moron": [2, 2, 0, 0],
}


@pytest.mark.parametrize("text", CLAUSES)
def test_clauses(text):
    assert seeded().clauses(text).tolist() == CLAUSES[text]
    assert seeded().clauses(f"{'Some words, at length. ' * 50}{text}. {'More of them ' * 50}").tolist() == CLAUSES[text]


def test_isolated_words_are_not_toxic():
    g = seeded()
    assert all(g.score(t) < 0.5 for t in ("kill", "I will kill time", "burn the cake in the oven", "idiot", "never an idiot", "he called it stupid", ""))
    assert all(g.score(t) >= 0.5 for t in ("You idiot!", "I will kill you.", "You stupid moron, get lost"))


def test_edge_cases(spark):
    """Nulls, empty and long texts, repeated rows and clashing names."""
    ship(spark)
    texts = [None, "", "You idiot, you moron", "You idiot, you moron", "word " * 200_000 + ". you idiot, you moron", "  \n\n "]
    df = spark.createDataFrame([(i, t, 9.0, "x", None) for i, t in enumerate(texts)], "doc_id long, text string, score double, held string, y int")
    out = toxicity(df, seeded())
    assert out.columns == ["doc_id", "held", "y", "score", "predicted"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].predicted for i in range(6)] == [0, 0, 1, 1, 1, 0] and got[2].score == got[3].score == got[4].score
    assert got[0].score == got[1].score == got[5].score


def test_labels(spark):
    """Null and odd labels don't count; seeds that the labels don't bear out go; copies count once."""
    ship(spark)
    rows = [(f"clean words {i} you loser", 0) for i in range(60)] + [(f"other words {i} blorg", 1) for i in range(60)] + [("zzz once", 1)] * 50 + [("x", None), ("blorg", 7), (None, 0)]
    g = fit(spark.createDataFrame(rows, "text string, toxic int"))
    assert "blorg" in g.words and "loser" not in g.words and "zzz" not in g.words
    assert g.score("so blorg") > 0.5 > g.score("you loser")
    none = fit(spark.createDataFrame([], "text string, toxic int"))
    assert isinstance(none, Grammar) and none.score("You idiot") >= 0.5
    docs, labels = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    import zlib

    assert {r.text for r in labelled(docs, labels).collect()} == {f"t{i}" for i in range(50) if zlib.crc32(str(i).encode()) % 5}
