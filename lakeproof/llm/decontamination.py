"""Benchmark decontamination: an exact prefix-filtered join of word shingles, verified over item-sized windows.

Only DataFrame functions. Every item is cut into windows of ``window`` words (an item of fewer words is one
window) and every window into shingles. Shingles are ordered by how often the documents hold them; an occurring
window holds all its shingles, so its rarest one is the only prefix token it needs. Document places of prefix
tokens become candidates where the window fits between the text's ends (length and position), and the words
around the place, kept with it, decide.

Lower-casing is of A-Z alone; the join key is lower-cased further, which can only add candidates.

Edge cases: null and empty texts have no words, as documents and as items; very long texts are searched whole, in
time and shuffle in proportion to their words; ids are taken as unique, null being one of them, and repeated rows get
equal results; of a window's equally rare shingles the one with the least hash is the prefix; an empty benchmark
leaves all documents clean; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeproof.llm.tables import cut

#: What parts words, before A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class DecontaminationParams:
    window: int = 10
    shingle: int = 5
    #: Distinct benchmark shingles up to this number (16 bytes each) are broadcast; more are joined by shuffle.
    broadcast_shingles: int = 1_000_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")


def _key(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.lower(F.get(words, at + j)) for j in range(n)])


def benchmark_windows(items: DataFrame, params: DecontaminationParams, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, window_id, size, shingle, phrase``: the windows of every item, ``phrase`` in lower case."""
    rows = items.select(F.col(id_col).alias("item_id"), F.split(F.translate(F.array_join(_words(F.col(text_col)), " "), UPPER, LOWER), " ").alias("words"))
    rows = rows.where(F.element_at("words", 1) != "").withColumn("size", F.least(F.size("words"), F.lit(params.window)))
    rows = rows.select("item_id", "words", "size", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))).alias("at"))
    rows = rows.select("item_id", "size", F.least("size", F.lit(params.shingle)).alias("shingle"), F.slice("words", F.col("at") + 1, F.col("size")).alias("window"))
    return rows.select("item_id", F.xxhash64("window", "size").alias("window_id"), "size", "shingle", "window", F.array_join("window", " ").alias("phrase")).dropDuplicates(["item_id", "phrase"])


def window_hits(docs: DataFrame, items: DataFrame, params: DecontaminationParams = DecontaminationParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, item_id, start, size``: each place (words from 0) where a window of an item occurs in a document."""
    windows = cut(benchmark_windows(items, params), "windows")
    reach = params.window - 1
    found = []
    for (n,) in windows.select("shingle").distinct().orderBy("shingle").collect():  # at most ``shingle`` rows
        own = windows.where(F.col("shingle") == n)
        parts = own.select("window_id", "phrase", "item_id", "size", "window", F.explode(F.sequence(F.lit(0), F.col("size") - n)).alias("offset"))
        parts = parts.select("window_id", "phrase", "item_id", "size", "offset", _key(F.col("window"), F.col("offset"), n).alias("key"))
        keys = parts.select("key").distinct()
        texts = docs.select(id_col, _words(F.col(text_col)).alias("words")).where(F.size("words") >= n)
        places = texts.select(id_col, "words", F.posexplode("words").alias("pos", "word"))
        places = places.select(id_col, "pos", "words", _key(F.col("words"), F.col("pos"), n).alias("key"))
        if keys.count() <= params.broadcast_shingles:
            places = places.join(F.broadcast(keys), "key", "left_semi")
        else:  # keys are shuffled without the text, which comes back once for all its places
            held = places.select(F.col(id_col).alias("_own"), "pos", "key").join(keys, "key", "left_semi").groupBy("_own").agg(F.collect_list(F.struct("pos", "key")).alias("places"))
            places = texts.join(held, F.col(id_col).eqNullSafe(F.col("_own"))).select(id_col, "words", F.inline("places"))
        left = F.greatest(F.col("pos") - reach, F.lit(0))
        around = F.translate(F.array_join(F.slice("words", left + 1, F.lit(2 * reach + 1)), " "), UPPER, LOWER)
        places = places.select(id_col, "key", "pos", (F.col("pos") - left).cast("int").alias("before"), (F.size("words") - F.col("pos")).alias("after"), around.alias("around"))
        places = cut(places, "places")
        counts = places.groupBy("key").agg(F.count("*").alias("n"))
        rarest = parts.join(counts, "key").groupBy("phrase", "item_id", "size").agg(F.min_by(F.struct("key", "offset"), F.struct("n", "key", "offset")).alias("token"), F.count("*").alias("held"))
        # A window some shingle of which occurs nowhere is held by no document.
        rarest = rarest.where(F.col("held") == F.col("size") - n + 1).select("phrase", "item_id", "size", "token.key", "token.offset")
        rows = places.join(rarest, "key").where((F.col("before") >= F.col("offset")) & (F.col("after") >= F.col("size") - F.col("offset")))
        same = F.array_join(F.slice(F.split("around", " "), F.col("before") - F.col("offset") + 1, F.col("size")), " ") == F.col("phrase")
        found.append(rows.where(same).select(id_col, "item_id", (F.col("pos") - F.col("offset")).alias("start"), "size"))
    if not found:
        return docs.select(id_col, F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("size")).where(F.lit(False))
    return reduce(DataFrame.unionByName, found)


def contamination(docs: DataFrame, items: DataFrame, params: DecontaminationParams = DecontaminationParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``n_words``, ``n_hit`` (words inside occurring windows), ``n_items``, ``items_sha256`` and ``contaminated``."""
    hits = window_hits(docs, items, params, id_col, text_col)
    spans = hits.groupBy(id_col).agg(F.collect_set(F.struct("start", "size")).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    inside = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))
    spans = spans.select(F.col(id_col).alias("_own"), F.size(inside).cast("long").alias("hit"), F.array_sort("ids").alias("ids"))
    sizes = docs.select(id_col, F.size(_words(F.col(text_col))).cast("long").alias("n_words"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    hit = F.coalesce("hit", F.lit(0).cast("long"))
    return sizes.join(spans, F.col(id_col).eqNullSafe(F.col("_own")), "left").select(
        id_col, "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )
