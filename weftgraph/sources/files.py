"""Source files as a table ``(repo, file_path, content)``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from weftgraph.functions.routes import repo_name
from weftgraph.operators import rules
from weftgraph.operators.scale import broadcast_if_small, first_rows
from weftgraph.schema import NODES, conform, node_id

LINE_END = "(?<=[\\n\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029])|(?<=\\r)(?!\\n)"


def extension(path: Column) -> Column:
    """Lower-cased suffix of the file name with its dot, or an empty text."""
    return F.lower(F.regexp_extract(path, r"[^/]+(\.[^./]+)$", 1))


def language_of(path: Column) -> Column:
    ext = F.substring(extension(path), 2, 64)
    lang = F.lit("generic")
    for name, exts in rules.LANGUAGE_EXTENSIONS.items():
        lang = F.when(ext.isin(*exts), name).otherwise(lang)
    return lang


def is_source_path(path: Column, include_all: bool = True) -> Column:
    """Whether a relative path would be read: folders first, then extension."""
    folders = F.split(path, "/")
    folders = F.slice(folders, 1, F.size(folders) - 1)
    ignored = rules.IGNORED_DIRS + (() if include_all else rules.EXTRA_IGNORED_DIRS)
    parts = rules.IGNORED_DIR_PARTS + (() if include_all else rules.EXTRA_IGNORED_DIR_PARTS)

    def skipped(d: Column) -> Column:
        low = F.lower(d)
        hit = low.isin(*ignored) | d.startswith(".")
        for part in parts:
            hit = hit | low.contains(part)
        return hit

    return extension(path).isin(*rules.SOURCE_EXTENSIONS) & ~F.exists(folders, skipped)


def filter_source_files(files: DataFrame, include_all: bool = True) -> DataFrame:
    return files.where(is_source_path(F.col("file_path"), include_all))


def read_files(spark: SparkSession, root: str, include_all: bool = True, only_sources: bool = True) -> DataFrame:
    """Every file below ``root/<repo>/…``; bytes that are not UTF-8 become
    replacement characters. Folders are listed by a few tasks for each core."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, spark.sparkContext.defaultParallelism * 4)
    try:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    finally:
        spark.conf.set(name, before)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    inner = F.col("path").substr(F.lit(len(base) + 2), F.length("path"))
    named = raw.withColumn("inner", inner).select(
        repo_name(F.substring_index("inner", "/", 1)).alias("repo"),
        F.expr("substring(inner, locate('/', inner) + 1)").alias("file_path"), "content")
    kept = filter_source_files(named, include_all) if only_sources else named
    return kept.select("repo", "file_path", _utf8(F.col("content")).alias("content"))


def _utf8(data: Column) -> Column:
    """Decode with replacement; only invalid rows pay for the Python path."""
    @F.pandas_udf(T.StringType())
    def lenient(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))

    text = data.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(lenient(F.when(~F.is_valid_utf8(text), data)))


def split_lines(content: Column) -> Column:
    """Lines with their line ends, cut where Python's ``splitlines`` cuts."""
    pieces = F.split(content, LINE_END)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def explode_lines(files: DataFrame) -> DataFrame:
    """``(repo, file_path, line_no, line)`` without line ends."""
    return files.select("repo", "file_path", F.posexplode(split_lines(F.col("content"))).alias("i", "raw")).select(
        "repo", "file_path", (F.col("i") + 1).alias("line_no"),
        F.regexp_replace("raw", "(\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029])$", "").alias("line"))


def line_count(content: Column) -> Column:
    return F.size(split_lines(content))


def list_files(nodes: DataFrame, repo: str | None = None, search: str = "") -> DataFrame:
    """Distinct paths, optionally of one repository and containing a text."""
    paths = nodes.select("repo", "file_path").distinct()
    if repo is not None:
        paths = paths.where(F.col("repo") == repo)
    return paths.where(F.lower("file_path").contains(search.lower())) if search else paths


def file_content(files: DataFrame, asked: DataFrame) -> DataFrame:
    """Text and number of lines of each file in ``asked(repo, file_path)``; a path that isn't there has no row."""
    wanted = broadcast_if_small(asked.select("repo", "file_path").distinct())
    return files.join(wanted, ["repo", "file_path"], "left_semi").select(
        "repo", "file_path", "content", line_count(F.col("content")).alias("total_lines"))


def doc_only_repo_rows(all_files: DataFrame, nodes: DataFrame) -> DataFrame:
    """One ``variable`` row for every repository without any symbol.

    Its text is the best README: profile/README*, README*, then any *.md at
    the top; the first 1,000 characters.
    """
    empty = all_files.select("repo").distinct().join(nodes.select("repo").distinct(), "repo", "left_anti")
    path = F.col("file_path")
    rank = F.when(path.rlike("^profile/README[^/]*$"), 0).when(path.rlike("^README[^/]*$"), 1).when(path.rlike(r"^[^/]*\.md$"), 2)
    ranked = all_files.select("repo", "file_path", rank.alias("rank"), F.left("content", F.lit(1000)).alias("text")).where(F.col("rank").isNotNull())
    best = first_rows(ranked, ["repo"], ["rank", "file_path"])
    rows = empty.join(best, "repo", "left").withColumn("text", F.coalesce("text", F.lit(""))).withColumn(
        "file_path", F.coalesce("file_path", F.lit("README.md")))
    return conform(rows.select(
        node_id(F.col("repo"), F.col("file_path"), F.col("repo"), F.lit(1)).alias("id"), "repo", "file_path",
        F.col("repo").alias("symbol_name"), F.lit("variable").alias("symbol_type"), F.lit(1).alias("start_line"),
        F.greatest(F.lit(1), line_count(F.col("text"))).alias("end_line"), F.concat(F.lit("repository "), "repo").alias("signature"),
        F.regexp_replace(F.left("text", F.lit(200)), r"^\s+|\s+$", "").alias("docstring"), F.col("text").alias("code_content"),
        F.lit(True).alias("is_documentation_repo")), NODES)
