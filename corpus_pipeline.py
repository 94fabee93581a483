"""A corpus made ready for training: five stages, each written before the next reads it.

A stage applies the session settings itself, as ``STAGES`` may be run one by one.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession, Window, functions as F  # noqa: E402

from weftgraph.llm.byte_bpe import encode_documents  # noqa: E402
from weftgraph.llm.decontaminate import drop_leaks  # noqa: E402
from weftgraph.llm.part_enum import jaccard_groups, with_set_keys  # noqa: E402
from weftgraph.llm.quality import keep_quality  # noqa: E402
from weftgraph.llm.scratch import Scratch, free_name  # noqa: E402
from weftgraph.llm.suffixes import cut_passages, repeated_passages  # noqa: E402
from weftgraph.session import tune  # noqa: E402


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more, by a model of the labelled ones.

    Null and empty texts are judged as empty ones; repeated rows are judged alike.
    """
    tune(spark)
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by 5-word shingles at 0.8.

    Documents without words are in no group and stay. Rows of one doc_id and one
    text are one document. A null doc_id stays where its group has no other; of
    a group's documents with the smallest doc_id that of the smallest set stays.
    """
    tune(spark)
    groups = jaccard_groups(docs, words=5, percent=80, slices=3)  # more signatures than at a higher percent
    own, kind, text, row = (free_name(docs, x) for x in ("_own", "_kind", "_text", "_row"))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias(own)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), doc, "set_key")).alias("first")
    keep = groups.where("group_key is not null").groupBy("group_key").agg(first).select(f"first.{own}", F.col("first.set_key").alias(kind))
    # Rows of one set are in one group, so one of them stays; texts without words are told apart by themselves.
    wordless = groups.where("group_key is null").select(doc, F.lit(0).cast("long").alias(kind)).distinct()
    rows = with_set_keys(docs, 5, kind).select("*", doc)
    rows = (rows.withColumn(text, F.when(F.col(kind).isNull(), F.xxhash64("text"))).withColumn(kind, F.coalesce(kind, F.lit(0).cast("long")))
            .join(keep.unionByName(wordless), [own, kind], "left_semi"))
    once = Window.partitionBy(own, kind, text).orderBy(F.xxhash64("text"), "text")
    return rows.withColumn(row, F.row_number().over(once)).where(F.col(row) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that stand earlier in the corpus.

    A document that had words and keeps none goes; null, empty and short texts
    stay, and repeated long rows go but for one.
    """
    tune(spark)
    return cut_passages(docs, repeated_passages(docs, min_words=50))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and repeated rows go or stay together."""
    tune(spark)
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of each document; ids are little-endian unsigned 32-bit numbers, none for null and empty texts."""
    tune(spark)
    ids = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return ids.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_array", suffix_array),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: No SQL says what the model, the tokenizer and the verified search decide; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
