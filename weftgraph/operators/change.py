"""Change plans: from a directive to per-file patches grouped by repository."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from weftgraph.operators.scale import first_rows, lookup_join
from weftgraph.operators.substring import contains_join
from weftgraph.operators.traverse import blast_radius
from weftgraph.session import materialise

# Words of a directive that are never its target, the target
# used when nothing else is named, and the patterns of routes and names.
DIRECTIVE_WORDS = (
    "deprecate", "update", "migrate", "remove", "endpoint", "function",
    "cross", "repo", "repository", "downstream", "upstream", "consumers", "callers",
)
DEFAULT_TARGET = "verify_legacy_auth"
ROUTE = r"(/[a-zA-Z0-9_\-\./]+)"
NAME = r"(?U)\b([a-zA-Z_][a-zA-Z0-9_]{3,})\b"
SUNSET = "Thu, 31 Dec 2026 23:59:59 GMT"


def parse_directive(query: Column) -> Column:
    """Struct ``(target, replacement)``: the first two routes, else names."""
    paths = F.regexp_extract_all(query, F.lit(ROUTE), F.lit(1))
    names = F.filter(F.regexp_extract_all(query, F.lit(NAME), F.lit(1)), lambda n: ~F.lower(n).isin(*DIRECTIVE_WORDS))
    by_path = F.size(paths) > 0
    return F.struct(
        F.when(by_path, F.get(paths, F.lit(0))).otherwise(F.coalesce(F.get(names, F.lit(0)), F.lit(DEFAULT_TARGET))).alias("target"),
        F.when(by_path, F.get(paths, F.lit(1))).otherwise(F.get(names, F.lit(1))).alias("replacement"))


def resolve_roots(nodes: DataFrame, directives: DataFrame) -> DataFrame:
    """``directives(directive_id, target)`` → the first node, by repository,
    path and line, whose name or endpoint route contains the target."""
    texts = nodes.select(
        F.col("id").alias("node_id"), "repo", "file_path", "start_line",
        F.explode(F.array_compact(F.array("symbol_name", F.nullif("endpoint_route", F.lit(""))))).alias("text"))
    # a text is matched once however many symbols share it
    distinct = texts.groupBy("text").agg(F.min(F.struct("repo", "file_path", "start_line", "node_id")).alias("best")).withColumn(
        "text_id", F.col("text"))
    pairs = contains_join(distinct.select("text_id", "text"), directives.select(F.col("target").alias("needle")))
    best = pairs.join(distinct.select("text_id", "best"), "text_id").groupBy(F.col("needle").alias("target")).agg(
        F.min("best").alias("best"))
    return directives.join(best, "target").select("directive_id", "target", F.col("best.node_id").alias("root_id"))


def producer_rewrite(code: Column, name: Column, replacement: Column, author: str = "the migration tool") -> Column:
    """Deprecates an ``@app.`` handler and adds its successor; any other code
    gets a comment line on top."""
    successor = F.coalesce(F.nullif(replacement, F.lit("")), F.concat(name, F.lit("_v2")))
    marked = F.when(code.contains("deprecated=True"), code).otherwise(_replace_first_call(code))
    headers = (f"\n    # {author}: tells callers that this endpoint ends, and when\n"
               f'    response.headers["Sunset"] = "{SUNSET}"\n'
               '    response.headers["Deprecation"] = "true"\n')
    with_headers = F.replace(marked, F.lit("return {"), F.lit(headers + "    return {"))
    function = F.regexp_replace(F.replace(successor, F.lit("/"), F.lit("_")), "^_+|_+$", "")
    added = F.concat(
        F.lit('\n\n@app.post("/'), F.regexp_replace(successor, "^/+", ""), F.lit('")\ndef '), function, F.lit('(req: dict):\n    """Takes the place of '),
        name, F.lit('."""\n    return {"replaces": "'), name, F.lit('"}\n'))
    comment = F.concat(F.lit("# Replaced by "), successor, F.lit(f" ({author})\n"), code)
    return F.when(code.contains("@app."), F.concat(with_headers, added)).otherwise(comment)


def _replace_first_call(code: Column) -> Column:
    """Adds ``deprecated=True`` to the first ``@app.verb(…`` only."""
    call = F.regexp_extract(code, r"@app\.[a-z]+\([^)]+", 0)
    at = F.instr(code, call)
    return F.when(call == "", code).otherwise(F.concat(
        F.left(code, at - 1), call, F.lit(", deprecated=True"), F.substring(code, at + F.length(call), F.length(code))))


def consumer_rewrite(code: Column, producer_name: Column, producer_route: Column, replacement: Column,
                     author: str = "the migration tool") -> Column:
    """Points a caller at the new target: by route, by name, or by a comment."""
    route = F.coalesce(producer_route, F.lit(""))
    target = F.coalesce(F.nullif(replacement, F.lit("")), F.when(
        route.contains("v1"), F.replace(route, F.lit("v1"), F.lit("v2"))).otherwise(F.concat(producer_name, F.lit("_v2"))))
    return (
        F.when((route != "") & code.contains(route), F.replace(code, route, target))
        .when(code.contains(producer_name), F.replace(code, producer_name, target))
        .otherwise(F.concat(F.lit("// Now meant to call "), target, F.lit(f" ({author})\n"), code)))


@F.pandas_udf(T.StringType())
def unified_diff(path: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    def one(p, a, b):
        return "".join(difflib.unified_diff(
            a.splitlines(keepends=True), b.splitlines(keepends=True), fromfile=f"a/{p}", tofile=f"b/{p}"))

    return pd.Series([one(*row) for row in zip(path, old, new)])


def diff_stats(diff: Column) -> Column:
    """Struct of added and removed lines."""
    lines = F.split(diff, "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]")
    return F.struct(
        F.size(F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++"))).alias("additions"),
        F.size(F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---"))).alias("deletions"))


def change_patches(nodes: DataFrame, edges: DataFrame, directives: DataFrame, max_depth: int = 3) -> DataFrame:
    """``directives(directive_id, query)`` → one row per patched file.

    The producer's file comes from the root; every upstream file of another
    repository gives one patch, from its first caller. A repository's rows
    share ``repo``: together they are one pull request.
    """
    parsed = directives.select("directive_id", "query", parse_directive(F.col("query")).alias("p")).select("directive_id", "query", "p.*")
    roots = materialise(resolve_roots(nodes, parsed), "plan-roots")
    asked = roots.join(parsed.select("directive_id", "replacement"), "directive_id")
    head = nodes.select(
        F.col("id").alias("root_id"), F.col("repo").alias("producer_repo"), F.col("symbol_name").alias("root_name"),
        F.col("endpoint_route").alias("root_route"))
    plan = materialise(asked.join(head, "root_id"), "plan")

    producer = plan.join(nodes.select(F.col("id").alias("root_id"), "file_path", "code_content"), "root_id").select(
        "directive_id", F.lit("producer").alias("side"), F.col("producer_repo").alias("repo"), "file_path", "root_id",
        F.coalesce(F.nullif("code_content", F.lit("")), F.concat(F.lit("# Definition for "), "root_name")).alias("old_content"),
        producer_rewrite(F.coalesce("code_content", F.lit("")), F.col("root_name"), F.col("replacement")).alias("new_content"))

    walk = blast_radius(nodes, edges, plan.select(F.col("root_id").alias("root")).distinct(), max_depth, directions=("upstream",))
    upstream = walk.where("depth > 0").select("root_id", "depth", F.col("node_id").alias("id"))
    place = nodes.select("id", "repo", "file_path", "start_line")
    # the walk can be long and many directives can share a root: place first, then join the short plan
    callers = lookup_join(lookup_join(upstream, place, ["id"], "inner", ["root_id"], by_id=True), plan, ["root_id"], "inner", ["id"]).where(F.col("repo") != F.col("producer_repo"))
    first = first_rows(
        callers.select("directive_id", "repo", "file_path", "depth", "start_line", "id"),
        ["directive_id", "repo", "file_path"], ["depth", "start_line", "id"])
    consumer = first.join(nodes.select("id", "symbol_name", "code_content"), "id").join(
        plan.select("directive_id", "root_id", "root_name", "root_route", "replacement"), "directive_id").select(
        "directive_id", F.lit("consumer").alias("side"), "repo", "file_path", "root_id",
        F.coalesce(F.nullif("code_content", F.lit("")), F.concat(F.lit("# Implementation of "), "symbol_name")).alias("old_content"),
        consumer_rewrite(F.coalesce("code_content", F.lit("")), F.col("root_name"), F.col("root_route"), F.col("replacement")).alias("new_content"))
    both = producer.unionByName(consumer)
    diffed = both.withColumn("unified_diff", unified_diff("file_path", "old_content", "new_content"))
    return diffed.withColumn("s", diff_stats(F.col("unified_diff"))).select("*", "s.*").drop("s")


def pull_requests(patches: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per directive and repository, with its texts and totals.

    Cross-links stay in long form (``cross_links``); patches stay rows.
    """
    name = nodes.select(F.col("id").alias("root_id"), F.col("symbol_name").alias("root_name"))
    grouped = patches.groupBy("directive_id", "side", "repo", "root_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    producer = F.col("side") == "producer"
    return grouped.join(name, "root_id").select(
        "directive_id", "side", "repo", "files", "additions", "deletions",
        F.when(producer, F.concat(F.lit("feat/deprecate-"), "root_name")).otherwise(
            F.concat(F.lit("fix/migrate-to-"), "root_name", F.lit("-v2"))).alias("branch_name"),
        F.when(producer, F.concat(F.lit("feat("), "repo", F.lit("): deprecate "), "root_name", F.lit(" and publish migration contract"))).otherwise(
            F.concat(F.lit("fix("), "repo", F.lit("): migrate consumer calls from deprecated "), "root_name")).alias("pr_title"))


def cross_links(prs: DataFrame) -> DataFrame:
    """Producer ↔ consumer links of each change set."""
    producer = prs.where("side = 'producer'").select("directive_id", F.col("repo").alias("producer_repo"))
    consumer = prs.where("side = 'consumer'").select("directive_id", F.col("repo").alias("consumer_repo"))
    pairs = producer.join(consumer, "directive_id")
    return pairs.select("directive_id", F.explode(F.array(
        F.struct(F.col("producer_repo").alias("repo"), F.concat("consumer_repo", F.lit("#migration")).alias("linked")),
        F.struct(F.col("consumer_repo").alias("repo"), F.concat("producer_repo", F.lit("#migration")).alias("linked")),
    )).alias("l")).select("directive_id", "l.*")


def change_totals(prs: DataFrame) -> DataFrame:
    return prs.groupBy("directive_id").agg(
        F.count(F.lit(1)).alias("total_repositories"), F.sum("files").alias("total_files_affected"),
        F.sum("additions").alias("total_additions"), F.sum("deletions").alias("total_deletions"))
