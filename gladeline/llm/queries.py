"""One query per operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gladeline.llm import (
    alignment, conversations, covertree, fmindex, language, licenses, packing, quality, records, simhash, surrogates, tokencounts,
    toolcalls,
)
from gladeline.llm.tables import held_out, table

#: A run's own key comes from its caller; this one makes the query's result repeatable.
SURROGATE_KEY = "gladeline"


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.classify(docs, labels, held_out(F.col("doc_id"), 5, 0))


def op2_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    return toolcalls.link(toolcalls.calls_of(said), toolcalls.results_of(said), toolcalls.described_tools(spark))


def op3_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 4, 2)
    return language.predict(docs, language.fit(docs.filter(~out)), out)


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_mentions(docs, SURROGATE_KEY, "n_mentions")


def op6_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = records.round_trip(table(spark, sf_dir, "documents"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(table(spark, sf_dir, "documents"))


def op8_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digest(packing.pack(table(spark, sf_dir, "documents")))


def op9_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pigeonhole_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    return conversations.repair_report(said, conversations.damage(said))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_rule_ensemble, op2_tool_call_linking, op3_output_codes, op4_cover_tree, op5_surrogates, op6_binary_records,
        op7_trie_counts, op8_concat_and_cut, op9_fm_index, op10_pigeonhole_simhash, op11_conversation_repair, op12_license_scan,
        op13_tokenizer_alignment,
    )
}
