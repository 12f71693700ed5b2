"""A corpus pipeline of five training-data operators.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``. Stages keep the rows they find no fault
with as they are. What a stage has written on its way is deleted when the next one starts, since its result has been
written by then.

Edge cases, in every stage: null and empty texts have no words and stay; a row without an id can't be named and stays;
texts are read whole, however long; rows of equal text are one group, of which the smallest id stays; other columns,
whatever their names and nulls, are passed on as they are; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeproof.llm.decontamination import contamination
from lakeproof.llm.near_duplicates import near_duplicates
from lakeproof.llm.sentence_pieces import encode_documents, read_model
from lakeproof.llm.substrings import kept_words, repeated_ranges
from lakeproof.llm.tables import cut, free_name, release, scope, table, tokenizer_path
from lakeproof.llm.toxicity import fit, labelled, toxic_score

#: Ids up to this number (8 bytes each) are sent to every executor to drop rows; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _stage(f):
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, "stage")
        with scope("stage"):
            return f(spark, docs, sf_dir)

    return run_stage


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    gone = cut(gone.select("doc_id").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti")


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores below one half; it learns from the labels of ``sf_dir`` whose id isn't held out."""
    grammar = fit(labelled(docs, table(spark, sf_dir, "labels")))
    return docs.where(toxic_score(grammar, F.col("text")) < 0.5)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every group of near duplicates; of equal rows that repeat an id one stays."""
    found = cut(near_duplicates(docs.select("doc_id", "text")), "near")
    kept = _without(docs, found.where("not kept"))
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null")
    if not twice.head(1):
        return kept
    own = cut(kept.join(twice.select("doc_id"), "doc_id", "left_semi"), "repeated")
    return _without(kept, own).unionByName(own.dropDuplicates(["doc_id", "text"]).select(docs.columns))


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows that stand elsewhere too; a text of which nothing is left goes, others stay unchanged."""
    spare, held = free_name(docs, "ranges"), free_name(docs, "held")
    ranges = repeated_ranges(docs.select("doc_id", "text")).select(F.col("id").alias("doc_id"), F.col("ranges").alias(spare))
    rows = docs.join(ranges, "doc_id", "left").withColumn(held, kept_words(F.col("text"), F.col(spare)))
    cut_some = F.col(held)["n_removed"] > 0
    rows = rows.where(~cut_some | (F.col(held)["kept_text"] != ""))
    changed = {"text": F.when(cut_some, F.col(held)["kept_text"]).otherwise(F.col("text")), "n_chars": F.when(cut_some, F.length(F.col(held)["kept_text"]).cast("long")).otherwise(F.col("n_chars"))}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return _without(docs, contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).where("contaminated"))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` with its SentencePiece ids."""
    return encode_documents(docs.select("doc_id", "text"), read_model(tokenizer_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("sentence_pieces", encode),
]

#: Learned weights and byte-pair merges are beyond SQL; ``tests/llm/test_pipeline.py`` runs the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
