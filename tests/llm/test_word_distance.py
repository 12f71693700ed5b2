"""Long texts with few or no common words are judged by their word histogram."""

from lakeproof.llm.quality_rules import quality_rules


def test_long_texts_without_common_words(spark):
    plain = [" ".join(f"{a} w{i}x{j} v{j}" for j, a in enumerate(["the", "of", "and", "to", "in", "is", "a"] * 6)) for i in range(20)]
    listed = [" ".join(f"u{j}" for j in range(n)) for n in (60, 400)]
    few = " ".join(["der", "die", "und", "das"] + [f"t{j}" for j in range(300)])
    texts = [(i, t, "en") for i, t in enumerate([*plain, *listed, few])] + [(90, listed[1], "zh"), (91, "u1 u2", "en")]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(texts, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept and got[i].word_distance < 0.1 for i in range(20))
    assert [(got[i].base_failed, got[i].word_distance, got[i].kept) for i in (20, 21)] == [(False, 1.0, False)] * 2
    assert got[22].word_distance > 0.5 and not got[22].kept
    # No common word in a language's rows: no reference. Short: not judged.
    assert got[90].word_distance is None and got[90].kept and got[91].word_distance is None
