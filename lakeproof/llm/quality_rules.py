"""Quality rules: how far a text's character-class and common-word histograms lie from its language's.

Only DataFrame functions. One pass over the texts computes counts and both histograms; the references are the
histograms' sums over all rows of a language; a row is judged by its Jensen-Shannon distances (base 2, square
root of the divergence, 0 to 1) to the reference of its own ``lang``. Distances of short texts are noise, so
texts are judged from a least length: in characters, and in words as the number of common words that a text of
that length has in its language, so that texts with few or none are judged too. Without any the word distance is 1.
A language whose rows hold no common word has no word reference, and its rows no word distance.

Edge cases: null and empty texts have no words and fail; texts are read whole, however long; a null ``lang`` counts as an empty one;
repeated rows and null ids count and are judged once each; common words are counted as they are written in lower case, others not at
all; a distance equal to its bound is kept; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeproof.llm.tables import cut

SPACE = r"[\x20\x09-\x0D]+"

# Frequent words of four languages, counted in lower case and without punctuation beside them.
COMMON_WORDS = "the of and to in is de la le et les que der die und zu das ist el en los y un a".split()

# One-byte character classes. Bytes beyond ASCII, white space and all that is left follow them.
CLASSES = {"comma": ",", "stop": ".", "digit": "0123456789", "symbol": "#*$%&|<>"}


#: Texts of fewer words have their windows packed, with 54 bits of hash or more.
PACKED_WORDS = 1_024


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Least characters and least common words for a histogram to be judged.
    min_chars: int = 200
    min_common: int = 40
    #: Texts with fewer common words are judged too where their length leads to expect this many, or the second number where they have none.
    min_expected: float = 12
    min_expected_none: float = 6
    max_char_distance: float = 0.20
    max_word_distance: float = 0.50
    #: Languages up to this number are sent to every executor; beyond, the references are joined by shuffle.
    broadcast_languages: int = 10_000


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_hist, word_hist``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), text.alias("text"))

    def count(marks: str) -> Column:
        """Characters of the text among ``marks``."""
        if len(marks) == 1:
            return (F.length("text") - F.length(F.replace("text", F.lit(marks), F.lit("")))).cast("long")
        return F.length(F.regexp_replace("text", f"[^{marks}]+", "")).cast("long")

    spaced = F.col("text")
    for mark in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(mark), F.lit(" "))
    rows = rows.select(
        id_col,
        "lang",
        F.array_remove(F.split(spaced, " "), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != "").alias("lines"),
        F.length("text").cast("long").alias("n_chars"),
        F.array(*map(count, CLASSES.values()), (F.octet_length("text") - F.length("text")).cast("long")).alias("classes"),
    )
    rows = rows.select(
        id_col,
        "lang",
        "n_chars",
        "classes",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.filter("words", lambda w: w.isin(*COMMON_WORDS)).alias("common"),
    )
    # Each 3-word window with its place: of short texts as one long (a hash, then the place in as few bits as it needs), which sorts
    # fastest; of longer ones, where that would leave the hash too few bits, as a pair.
    right, left = (lambda x, n, f=f: F.call_function(f, x, n) for f in ("shiftright", "shiftleft"))
    short = F.col("n_words") < PACKED_WORDS
    rows = rows.withColumn("bits", F.length(F.bin(F.col("n_words"))))
    starts = F.slice("hashes", 1, F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int"))
    hashed = lambda h, i: F.xxhash64(h, F.get("hashes", i + 1), F.get("hashes", i + 2))
    packed = F.transform(F.when(short, starts), lambda h, i: left(hashed(h, i), F.col("bits")).bitwiseOR(i))
    paired = F.transform(F.when(~short, starts), lambda h, i: F.struct(hashed(h, i).alias("h"), i.cast("long").alias("i")))
    rows = rows.select(id_col, "lang", "n_chars", "classes", "n_words", "word_chars", "n_dup_lines", "common", "bits", F.sort_array(packed).alias("packed"), F.sort_array(paired).alias("paired"))
    beside = lambda name, like, place: F.flatten(F.filter(F.zip_with(name, F.slice(name, 2, F.greatest(F.size(name), F.lit(1))), lambda a, b: F.when(like(a, b), F.array(place(a), place(b)))), lambda x: x.isNotNull()))
    low = lambda x: x.bitwiseAND(left(F.lit(1).cast("long"), F.col("bits")) - 1)
    twins = F.when(short, beside("packed", lambda a, b: right(a.bitwiseXOR(b), F.col("bits")) == 0, low)).otherwise(beside("paired", lambda a, b: a["h"] == b["h"], lambda x: x["i"]))
    rows = rows.withColumn("places", F.sort_array(F.array_distinct(twins)))
    gaps = F.zip_with("places", F.slice("places", 2, F.greatest(F.size("places"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)).cast("long"))
    total = F.aggregate("classes", F.lit(0).cast("long"), lambda s, x: s + x)
    char_hist = F.concat("classes", F.array(F.col("n_chars") - F.col("word_chars"), F.col("word_chars") - total))
    word_hist = F.array(*[(F.size("common") - F.size(F.array_remove("common", w))).cast("long") for w in COMMON_WORDS])
    return rows.select(
        id_col,
        "lang",
        "n_words",
        "word_chars",
        F.element_at("classes", list(CLASSES).index("symbol") + 1).alias("n_symbols"),
        "n_dup_lines",
        F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_repeat_words"),
        char_hist.alias("char_hist"),
        word_hist.alias("word_hist"),
    )


def references(counts: DataFrame) -> DataFrame:
    """``lang, char_ref, word_ref, ref_words``: each language's histograms and words summed over all its rows."""

    def total(name: str, n: int) -> Column:
        return F.array(*[F.sum(F.col(name)[i]).cast("double") for i in range(n)])

    return counts.groupBy("lang").agg(total("char_hist", len(CLASSES) + 3).alias("char_ref"), total("word_hist", len(COMMON_WORDS)).alias("word_ref"), F.sum("n_words").cast("double").alias("ref_words"))


def js_distance(p: Column | str, q: Column | str) -> Column:
    """Jensen-Shannon distance of two count arrays of equal length; 0 if either sums to 0."""

    def share(x):
        x = F.col(x) if isinstance(x, str) else x
        total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))
        return F.transform(x, lambda v: v / F.greatest(total, F.lit(1.0)))

    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(share(p), share(q), lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2, F.lit(0.0)))


def quality_rules(docs: DataFrame, params: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts, distances and verdict per row: ``base_failed`` (too short or too repetitive), ``char_distance``,
    ``word_distance`` (null where not judged) and ``kept``."""
    counts = cut(text_counts(docs, id_col, text_col, lang_col), "quality-counts")
    refs = references(counts)
    languages = refs.count()
    refs = F.broadcast(refs) if languages <= params.broadcast_languages else refs
    total = lambda name, zero=F.lit(0).cast("long"): F.aggregate(F.col(name), zero, lambda s, v: s + v)
    common, in_language = total("word_hist"), total("word_ref", F.lit(0.0))
    expected = F.col("n_words") * in_language / F.greatest(F.col("ref_words"), F.lit(1.0))
    judged = (common >= params.min_common) | (expected >= F.when(common == 0, params.min_expected_none).otherwise(params.min_expected))
    word_distance = F.when(common == 0, 1.0).otherwise(js_distance("word_hist", "word_ref"))
    rows = counts.join(refs, "lang", "left").select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.max_repeat_percent * F.col("n_words"))).alias("base_failed"),
        F.when(total("char_hist") >= params.min_chars, js_distance("char_hist", "char_ref")).alias("char_distance"),
        F.when((in_language > 0) & judged, word_distance).alias("word_distance"),
    )
    far = reduce(lambda a, b: a | b, [F.coalesce(F.col("char_distance") > params.max_char_distance, F.lit(False)), F.coalesce(F.col("word_distance") > params.max_word_distance, F.lit(False))])
    return rows.withColumn("kept", ~F.col("base_failed") & ~far)
