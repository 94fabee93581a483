"""Substring containment between two tables, as an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.operators.scale import lookup_join
from weftgraph.session import materialise

GRAM = 4


def grams(text: Column, size: Column) -> Column:
    """Distinct character runs of one size; empty for shorter texts."""
    n = F.length(text) - size + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, size))
    return F.when(n > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def literal_runs(needle: Column) -> Column:
    """Parts of a LIKE needle between its wildcards."""
    return F.filter(F.split(needle, "[%_]"), lambda x: x != "")


def like_anywhere(text: Column, needle: Column) -> Column:
    """Whether a LIKE needle, which has no escape sign, stands anywhere in the text."""
    return F.like(text, F.concat(F.lit("%"), F.replace(needle, F.lit("\\"), F.lit("\\\\")), F.lit("%")), F.lit("\\"))


def contains_join(texts: DataFrame, needles: DataFrame, wildcards: bool = False) -> DataFrame:
    """``texts(text_id, text)`` × ``needles(needle)`` → pairs where the text
    contains the needle, without comparing every pair.

    A text that contains a needle has all of its grams, so each needle is
    looked up under its rarest gram only and the candidates are then verified.
    Needles shorter than four characters use grams of their own length. With
    ``wildcards``, ``_`` and ``%`` in a needle are those of LIKE, and the grams
    come from what stands between them; a needle of wildcards alone finds nothing.
    """
    runs = literal_runs(F.col("needle")) if wildcards else F.filter(F.array("needle"), lambda x: x != "")
    wanted = materialise(needles.select("needle", runs.alias("runs")).where(F.size("runs") > 0).distinct(), "needles")
    parts = wanted.select("needle", F.explode("runs").alias("run")).select(
        "needle", "run", F.least(F.length("run"), F.lit(GRAM)).alias("size")).select(
        "needle", "size", F.explode(grams(F.col("run"), F.col("size"))).alias("gram")).distinct()
    sizes = parts.select(F.collect_set("size")).scalar()
    per_text = texts.select("text_id", "text", F.explode(sizes).alias("size")).select(
        "text_id", F.explode(grams(F.col("text"), F.col("size"))).alias("gram"))
    hits = materialise(lookup_join(per_text, parts.select("gram").distinct(), ["gram"], "left_semi", ["text_id"]), "grams")
    weight = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    # every gram of the needle must occur somewhere; the rarest one is kept
    rarest = parts.join(weight, "gram", "left").groupBy("needle").agg(
        F.min_by("gram", F.struct("texts", "gram")).alias("gram"), F.bool_or(F.col("texts").isNull()).alias("absent"),
    ).where(~F.col("absent")).select("needle", "gram")
    candidates = lookup_join(hits, rarest, ["gram"], "inner", ["text_id"]).select("text_id", "needle")
    holds = like_anywhere(F.col("text"), F.col("needle")) if wildcards else F.col("text").contains(F.col("needle"))
    return candidates.join(texts.select("text_id", "text"), "text_id").where(holds).select("text_id", "needle")
