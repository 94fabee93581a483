"""Where a declaration's block ends, as a window over depth levels.

``depth`` runs over a file's lines; a block that starts at line *s* ends at
the first line from *s* on where a closer brings the depth back to its value
before *s*. Looking that up is a match on (file, depth level), so it is one
running window per level instead of a scan per declaration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftgraph.operators.rules import BRACE_FALLBACK, OTHER_FALLBACK

UNIT = ["repo", "file_path", "unit"]

# The line forms that open and close a Ruby block.
RUBY_OPEN = r"^(?:class|module|def|if|unless|while|until|for|case)\b"
RUBY_DO = r"\bdo\s*(?:\|[^|]*\|)?$"
RUBY_CLOSE = r"^end\b"


def block_style(lang: Column) -> Column:
    return F.when(lang == "clojure", "paren").when(lang == "ruby", "ruby").otherwise("brace")


def line_brackets(line: Column, style: Column) -> Column:
    """Only the brackets that count on a line, as a text of ``{`` and ``}``."""
    brace = F.regexp_replace(F.regexp_replace(line, r"(?d)//.*$|/\*.*?\*/", ""), r"[^{}]", "")
    paren = F.translate(F.regexp_replace(F.regexp_replace(line, r"(?d);.*$", ""), r"[^()]", ""), "()", "{}")
    bare = F.trim(F.regexp_replace(F.regexp_replace(line, r"(?d)#.*$", ""), r"^\s+|\s+$", ""))
    opened = bare.rlike(RUBY_OPEN) | bare.rlike(RUBY_DO)
    # an opener on the closing line counts first, as the depth test comes last
    ruby = F.concat(F.when(opened, "{").otherwise(""), F.when(bare.rlike(RUBY_CLOSE), "}").otherwise(""))
    return F.when(style == "paren", paren).when(style == "ruby", ruby).otherwise(brace)


def line_delta(brackets: Column) -> Column:
    return F.length(F.replace(brackets, F.lit("}"), F.lit(""))) * 2 - F.length(brackets)


def closing_levels(brackets: Column, depth_before: Column) -> Column:
    """Distinct depths that the closers of a line bring the file to."""
    each = F.transform(F.sequence(F.lit(1), F.length(brackets)), lambda i: F.struct(
        F.substring(brackets, i, F.lit(1)).alias("mark"), line_delta(F.left(brackets, i)).alias("rise")))
    closers = F.filter(each, lambda e: e["mark"] == "}")
    levels = F.array_distinct(F.transform(closers, lambda e: depth_before + e["rise"]))
    return F.when(brackets.contains("}"), levels).otherwise(F.array().cast("array<bigint>"))


def block_ends(lines: DataFrame, starts: str = "starts") -> DataFrame:
    """``lines(repo, file_path, unit, lang, line_no, line, starts)`` → one row
    per element of ``starts`` with ``start_line``, ``block_end`` (null when the
    block never closes) and ``style``.

    All windows are keyed by the file, so with the files partitioned by
    (repo, file_path) no further shuffle is planned.
    """
    order = Window.partitionBy(*UNIT).orderBy("line_no")
    marked = lines.withColumn("style", block_style(F.col("lang"))).withColumn(
        "brackets", line_brackets(F.col("line"), F.col("style")))
    before = F.coalesce(F.sum(line_delta(F.col("brackets"))).over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    deep = marked.withColumn("depth", before).select(
        *UNIT, "lang", "style", "line_no", "depth", starts,
        closing_levels(F.col("brackets"), F.col("depth")).alias("levels"))
    started = F.transform(starts, lambda s: F.struct(F.col("depth").alias("level"), F.lit(False).alias("closes"), s.alias("start")))
    closed = F.transform("levels", lambda v: F.struct(v.alias("level"), F.lit(True).alias("closes"), F.lit(None).alias("start")))
    closed = closed.cast(_typed(deep, starts))
    events = deep.select(*UNIT, "lang", "style", "line_no", F.explode(F.concat(started.cast(_typed(deep, starts)), closed)).alias("e")).select(
        *UNIT, "lang", "style", "line_no", "e.*")
    # from the end backwards, the last closer seen is the nearest one at or after
    upward = Window.partitionBy(*UNIT, "level").orderBy(F.desc("line_no"), F.desc("closes")).rowsBetween(Window.unboundedPreceding, 0)
    nearest = F.last(F.when(F.col("closes"), F.col("line_no")), ignorenulls=True).over(upward)
    return events.withColumn("block_end", nearest).where(~F.col("closes")).select(
        *UNIT, "lang", "style", F.col("line_no").alias("start_line"), "start", "block_end")


def _typed(deep: DataFrame, starts: str) -> str:
    element = deep.schema[starts].dataType.elementType.simpleString()
    return f"array<struct<level:bigint,closes:boolean,start:{element}>>"


def end_line(start: Column, block_end: Column, style: Column, n_lines: Column, rule: Column, near_open: Column) -> Column:
    """Last line of a block: its closer, else a fixed number of lines."""
    fallback = start + F.when(style == "brace", BRACE_FALLBACK).otherwise(OTHER_FALLBACK)
    block = F.coalesce(block_end, F.least(fallback, n_lines))
    return (
        F.when(rule == "plus5", F.least(start + 5, n_lines))
        .when((rule == "window20") & ~near_open, F.least(start + 20, n_lines))
        .when((rule == "window25") & ~near_open, F.least(start + 25, n_lines))
        .otherwise(block))
