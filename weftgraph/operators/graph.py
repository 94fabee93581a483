"""Lookups, neighbours, projections and rankings over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.operators.scale import edges_with_ends, first_rows, lookup_join, numbered, top_rows

NODE_ORDER = ("repo", "file_path", "start_line", "id")


def node_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def nodes_by_name(nodes: DataFrame, name: str, repo: str | None = None) -> DataFrame:
    found = nodes.where(F.col("symbol_name") == name)
    return found if repo is None else found.where(F.col("repo") == repo)


def callers(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """One row per edge into ``node_id``: two edge types give two rows."""
    into = edges.where(F.col("callee_id") == node_id).select(F.col("caller_id").alias("id"), "edge_type")
    return into.join(nodes, "id")


def callees(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    out = edges.where(F.col("caller_id") == node_id).select(F.col("callee_id").alias("id"), "edge_type")
    return out.join(nodes, "id")


def resolve_targets(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets(target)`` → the node with that id, else the first of that name."""
    slim = nodes.select("id", "symbol_name", "repo", "file_path", "start_line")
    by_id = targets.join(slim.select(F.col("id").alias("target"), F.col("id")), "target")
    rest = targets.join(by_id.select("target"), "target", "left_anti")
    named = rest.join(slim, rest.target == slim.symbol_name).select("target", *NODE_ORDER)
    return by_id.select("target", "id").unionByName(
        first_rows(named, ["target"], list(NODE_ORDER)).select("target", "id"))


def usage_links(nodes: DataFrame, edges: DataFrame, targets: DataFrame, distinct: bool = False) -> DataFrame:
    """Callers and callees of each target, long form with a direction."""
    hit = resolve_targets(nodes, targets)
    # both ends of an edge in one pass, so that the edges are computed once
    ends = edges.select("edge_type", F.explode(F.array(
        F.struct(F.col("callee_id").alias("id"), F.lit("upstream").alias("direction"), F.col("caller_id").alias("node_id")),
        F.struct(F.col("caller_id").alias("id"), F.lit("downstream").alias("direction"), F.col("callee_id").alias("node_id")),
    )).alias("e")).select("edge_type", "e.*")
    links = lookup_join(ends, hit.select("target", "id"), ["id"], "inner", ["node_id"]).select("target", "direction", "node_id", "edge_type")
    if distinct:
        links = links.select("target", "direction", "node_id").distinct()
    place = nodes.select(F.col("id").alias("node_id"), "repo", "file_path", "symbol_name")
    return lookup_join(links, place, ["node_id"], "inner", ["target"], by_id=True)


def usage_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("target").agg(
        F.count_if(F.col("direction") == "upstream").alias("upstream_callers_count"),
        F.count_if(F.col("direction") == "downstream").alias("downstream_callees_count"),
    )


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One long-form row per figure; repositories are counted, not collected."""
    n = nodes.agg(F.count(F.lit(1)).alias("total_symbols"), F.count_distinct("repo").alias("repositories"))
    e = edges.agg(
        F.count(F.lit(1)).alias("total_edges"),
        F.count_if(F.col("edge_type") == "consumes_api").alias("cross_repo_edges"),
    )
    stack_n = n.select(F.expr("stack(2, 'total_symbols', total_symbols, 'repositories', repositories) AS (metric, value)"))
    stack_e = e.select(F.expr("stack(2, 'total_edges', total_edges, 'cross_repo_edges', cross_repo_edges) AS (metric, value)"))
    return stack_n.unionByName(stack_e)


def repositories(nodes: DataFrame) -> DataFrame:
    return nodes.select("repo").distinct()


def code_chunk(nodes: DataFrame, node_id: str) -> DataFrame:
    return node_by_id(nodes, node_id).select(
        "id", "repo", "file_path",
        F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("lines"),
        "signature", "code_content")


def code_chunks(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """``code_chunk`` for a table of ids."""
    return nodes.join(ids, "id", "left_semi").select(
        "id", "repo", "file_path",
        F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("lines"),
        "signature", "code_content")


def induced_nodes(nodes: DataFrame, repos: list[str]) -> DataFrame:
    return nodes.where(F.col("repo").isin(*repos))


def induced_edges(nodes: DataFrame, edges: DataFrame, repos: list[str]) -> DataFrame:
    """Edges with both ends inside the chosen repositories."""
    inside = induced_nodes(nodes, repos)
    return edges.join(inside.select(F.col("id").alias("caller_id")), "caller_id", "left_semi").join(
        inside.select(F.col("id").alias("callee_id")), "callee_id", "left_semi")


def one_hop(edges: DataFrame, node_id: str) -> DataFrame:
    up = edges.where(F.col("callee_id") == node_id).select(
        F.lit("caller").alias("side"), F.col("caller_id").alias("node_id"))
    down = edges.where(F.col("caller_id") == node_id).select(
        F.lit("callee").alias("side"), F.col("callee_id").alias("node_id"))
    return up.unionByName(down).distinct()


def node_kind(symbol_type: Column) -> Column:
    return F.when(symbol_type.isin("endpoint", "class"), symbol_type).otherwise(F.lit("function"))


def edge_kind(edge_type: Column) -> Column:
    return (
        F.when(edge_type == "consumes_api", F.lit("http"))
        .when(edge_type == "imports", F.lit("imports"))
        .otherwise(F.lit("calls"))
    )


def edge_list(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("caller_id").alias("from_id"), F.col("callee_id").alias("to_id"),
                        edge_kind(F.col("edge_type")).alias("kind"), "edge_type")


def degree_ranking(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Inbound, outbound and total edges per node and a cross-repo flag.

    The ends of an edge are known by the numbers of their nodes once they are
    met, and are summed by those; a hub adds up in map-side partial aggregates.
    """
    ids = numbered(nodes)
    repo = nodes.select("id", "repo").join(ids, "id")
    pairs = edges_with_ends(edges.select("caller_id", "callee_id"), *(repo.select(
        F.col("id").alias(f"{end}_id"), F.col("repo").alias(f"{end}_repo"), F.col("number").alias(f"{end}_number"))
        for end in ("caller", "callee")), "left")
    crosses = F.coalesce(F.col("caller_repo") != F.col("callee_repo"), F.lit(False))
    ends = pairs.select(
        F.explode(F.array(
            F.struct(F.col("callee_number").alias("number"), F.lit(1).alias("i"), F.lit(0).alias("o"), crosses.alias("x")),
            F.struct(F.col("caller_number").alias("number"), F.lit(0).alias("i"), F.lit(1).alias("o"), crosses.alias("x")),
        )).alias("e")).select("e.*").where(F.col("number").isNotNull())
    degree = ends.groupBy("number").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"), F.bool_or("x").alias("is_cross_repo"))
    zero = F.lit(0).cast("long")
    return nodes.select("id", F.col("symbol_name").alias("label"), "repo", "file_path",
                        node_kind(F.col("symbol_type")).alias("kind")).join(
        ids.join(degree, "number").drop("number"), "id", "left").select(
        "id", "label", "repo", "file_path", "kind",
        F.coalesce("inbound", zero).alias("inbound"),
        F.coalesce("outbound", zero).alias("outbound"),
        (F.coalesce("inbound", zero) + F.coalesce("outbound", zero)).alias("total_relations"),
        F.coalesce("is_cross_repo", F.lit(False)).alias("is_cross_repo"),
    )


def ranked_filter(ranking: DataFrame, kind: str, text: str = "") -> DataFrame:
    q = text.strip().lower()
    kept = ranking.where(F.col("kind") == kind)
    if not q:
        return kept
    return kept.where(F.lower("label").contains(q) | F.lower("repo").contains(q) | F.lower("file_path").contains(q))


def display_nodes(nodes: DataFrame, edges: DataFrame, per_repo: int = 72) -> DataFrame:
    """Best ``per_repo`` nodes of a repository: connected first, then by kind."""
    linked = edges.select(F.explode(F.array("caller_id", "callee_id")).alias("id")).distinct().withColumn("linked", F.lit(0))
    kind = node_kind(F.col("symbol_type"))
    ranked = nodes.join(linked, "id", "left").select(
        "id", F.col("symbol_name").alias("label"), "repo", "file_path", "start_line", "end_line",
        kind.alias("kind"), F.coalesce("linked", F.lit(1)).alias("unlinked"),
        F.when(kind == "endpoint", 0).when(kind == "class", 1).otherwise(2).alias("weight"))
    return top_rows(ranked, ["repo"], [F.col("unlinked"), F.col("weight"), F.col("file_path"), F.col("start_line"), F.col("id")],
                    per_repo, "position").drop("unlinked", "weight")


def _has_any(name: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | name.contains(word)
    return found


def repo_order(nodes: DataFrame) -> DataFrame:
    """Repositories with their column rank, then by name."""
    repo = F.col("repo")
    # The keywords of each rank.
    return repositories(nodes).select(
        "repo",
        F.when(_has_any(repo, ("auth", "core", "backend")), 0)
        .when(_has_any(repo, ("sdk", "shared", "common")), 1)
        .when(_has_any(repo, ("front", "portal", "ui")), 2)
        .otherwise(3).alias("lane"),
    ).orderBy("lane", "repo")
