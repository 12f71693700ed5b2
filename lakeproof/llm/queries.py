"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeproof.llm import sql
from lakeproof.llm.decontamination import contamination
from lakeproof.llm.html_text import extract_text
from lakeproof.llm.license_scan import license_scan
from lakeproof.llm.lm_scoring import lm_scores
from lakeproof.llm.merkle import dataset_manifest
from lakeproof.llm.near_duplicates import near_duplicates
from lakeproof.llm.periodic_runs import periodic_runs, planted
from lakeproof.llm.quality_rules import quality_rules
from lakeproof.llm.secret_scan import secret_scan
from lakeproof.llm.sentence_pieces import encode_documents, read_model
from lakeproof.llm.sharding import shard_documents
from lakeproof.llm.substrings import remove_repeats
from lakeproof.llm.tables import held_out, table, tokenizer_path
from lakeproof.llm.toxicity import fit, labelled, toxicity


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = fit(labelled(docs, table(spark, sf_dir, "labels")))
    return toxicity(docs.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "text"), grammar)


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), read_model(tokenizer_path()))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("collapsed_text")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_manifest(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_html_extraction,
        op3_quality_rules,
        op4_toxicity,
        op5_sentence_pieces,
        op6_lm_scoring,
        op7_sharding,
        op8_near_duplicates,
        op9_decontamination,
        op10_substring_dedup,
        op11_periodic_runs,
        op12_secret_scan,
        op13_merkle_manifest,
        pipeline,
    )
}
ORACLE = sql.ORACLE
