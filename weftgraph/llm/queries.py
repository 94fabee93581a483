"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.llm import oracles
from weftgraph.llm.byte_bpe import round_trip
from weftgraph.llm.decontaminate import find_leaks
from weftgraph.llm.divergence import source_divergence
from weftgraph.llm.notices import scan_notices
from weftgraph.llm.part_enum import jaccard_components
from weftgraph.llm.phrases import collocations
from weftgraph.llm.quality import judge_quality
from weftgraph.llm.quotes import link_quotes
from weftgraph.llm.scratch import Scratch
from weftgraph.llm.simhash import compare_with_edits, near_fingerprints
from weftgraph.llm.suffixes import repeated_passages
from weftgraph.llm.token_store import read_all, write_shards
from weftgraph.llm.toxicity import judge_toxicity
from weftgraph.llm.urls import judge_urls, starting_labels
from weftgraph.session import tune

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(_table(spark, sf_dir, "conversations"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(_table(spark, sf_dir, "documents"), min_words=50)
    return found.select("doc_id", "n_words", "first_word", "end_word", "source_doc_id", "source_word")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES, starting_labels(spark))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_near: documents within 3 bits of it, itself included, for every 50th doc_id; null for others."""
    rows = Scratch(spark, "op6").save(compare_with_edits(_table(spark, sf_dir, "documents")), "rows")
    number = F.conv("fingerprint", 16, -10).cast("long")
    counts = rows.groupBy(number.alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))
    asked = rows.where("doc_id % 50 = 0").select(number.alias("fingerprint"))
    near = (near_fingerprints(asked, counts, radius=3).join(counts, "fingerprint")
            .groupBy("query").agg(F.sum("n").alias("n_near")))
    query = F.when(F.col("doc_id") % 50 == 0, number)
    return rows.withColumn("query", query).join(near, "query", "left").drop("query")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return read_all(Scratch(spark, "op8").save(write_shards(docs, public_tokenizers.path(WORD_BPE), end_id=2), "shards"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_notices(_table(spark, sf_dir, "documents"), PHRASES).drop("spans")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.5)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"), min_docs=30, top=50)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"), support=30, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quotation_linking, op2_decontamination, op3_quality_attention, op4_suffix_array, op5_url_filter,
        op6_simhash, op7_byte_bpe, op8_token_store, op9_license_scan, op10_jaccard_join, op11_toxicity,
        op12_source_divergence, op13_collocations)
}

ORACLES: dict[str, str] = {"op12_source_divergence": oracles.SOURCE_DIVERGENCE, "op13_collocations": oracles.COLLOCATIONS}
