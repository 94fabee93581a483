"""Cross-repository edges after a change: only callers that the change can reach are linked again.

A change is the old and the new symbols of some files. Their difference gives
touched endpoints and touched names. A consumer is reached if its route, or its
route under the mask of a touched endpoint, is a touched one; an importer, if it
imports a repository with touched names and uses one of them. Everything else
keeps its edges. The node table is read where it lies: what is shuffled are
the rows that match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftgraph.functions import routes as r
from weftgraph.functions import words as w
from weftgraph.operators import link
from weftgraph.operators.scale import broadcast_if_small
from weftgraph.session import materialise


def _difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of one side only."""
    return old.exceptAll(new).unionByName(new.exceptAll(old))


def touched_endpoints(old: DataFrame, new: DataFrame) -> DataFrame:
    """Shaped endpoints that are gone, new or different; both inputs hold the changed files' nodes with an ``ordinal``."""
    columns = ["callee_id", "target_repo", "endpoint_route", "method", "route", "ordinal"]
    both = _difference(*(link.endpoint_table(x).select(*columns) for x in (old, new)))
    return materialise(link.shaped_endpoints(both).select("route", "mask", "key", "n_segments").distinct(), "touched-endpoints")


def touched_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """(target_repo, symbol) of nodes that are gone, new or different to whoever refers to them."""
    both = _difference(*(x.select("id", "repo", "symbol_name", "symbol_type", "ordinal") for x in (old, new)))
    return materialise(both.select(F.col("repo").alias("target_repo"), F.col("symbol_name").alias("symbol")).distinct(), "touched-names")


def reached_consumers(nodes: DataFrame, touched: DataFrame) -> DataFrame:
    """(id) of consumers whose route meets a touched endpoint's, as it is or under its mask."""
    consumers = link.consumer_table(nodes).select("caller_id", "route")
    routes = broadcast_if_small(touched.select("route").distinct())
    direct = consumers.join(routes, "route", "left_semi").select("caller_id")
    masks = broadcast_if_small(touched.where("n_segments > 0").select("n_segments", "mask").distinct())
    keys = broadcast_if_small(touched.where("n_segments > 0").select("mask", "key").distinct())
    sized = consumers.where("route <> '/'").withColumn("segments", r.route_segments(F.col("route")))
    probes = sized.withColumn("n_segments", F.size("segments")).join(masks, "n_segments").select(
        "caller_id", "mask", r.masked_key(F.col("segments"), F.col("mask")).alias("key"))
    return direct.unionByName(probes.join(keys, ["mask", "key"], "left_semi").select("caller_id")).select(F.col("caller_id").alias("id"))


def reached_importers(nodes: DataFrame, touched: DataFrame) -> DataFrame:
    """(id) of nodes that import a repository of touched names and use one of them, in the import or in their code."""
    aliases = link.repo_aliases(touched.select(F.col("target_repo").alias("repo")))
    used = nodes.where(F.size("file_imports") > 0).select(
        F.col("id").alias("caller_id"), F.col("repo").alias("caller_repo"), F.explode("file_imports").alias("import_text"))
    mentions = materialise(link.import_repos(used, aliases, few=True), "mentions")
    met = materialise(used.join(broadcast_if_small(mentions), "import_text").where("target_repo <> caller_repo")
                      .select("caller_id", "import_text", "target_repo"), "importers")
    names = broadcast_if_small(touched)
    named = met.select("import_text", "target_repo").distinct().select("import_text", "target_repo", F.explode(w.identifiers(F.col("import_text"))).alias("symbol"))
    named = named.join(names, ["target_repo", "symbol"], "left_semi").select("import_text", "target_repo").distinct()
    by_import = met.join(named, ["import_text", "target_repo"], "left_semi").select("caller_id")
    code = nodes.join(broadcast_if_small(met.select(F.col("caller_id").alias("id")).distinct()), "id", "left_semi")
    tokens = link.code_symbols(code).select("caller_id", "symbol")
    by_code = (tokens.join(met.select("caller_id", "target_repo").distinct(), "caller_id")
               .join(names, ["target_repo", "symbol"], "left_semi").select("caller_id"))
    return by_import.unionByName(by_code).select(F.col("caller_id").alias("id"))


def link_callers(callers: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cross-repository edges of ``callers``, some of ``nodes``: the rows that ``link_repositories(nodes)`` has for them.

    Endpoints and symbols are narrowed to those that the callers can refer to
    before anything is grouped.
    """
    endpoints = link.endpoint_table(nodes)
    asked = materialise(link.consumer_table(callers).select("route").distinct(), "asked")
    shaped = link.shaped_endpoints(endpoints)
    masks = broadcast_if_small(materialise(shaped.where("n_segments > 0").select("n_segments", "mask").distinct(), "masks"), link.MAX_MASKS)
    probes = asked.where("route <> '/'").withColumn("segments", r.route_segments(F.col("route"))).withColumn(
        "n_segments", F.size("segments")).join(masks, "n_segments").select(
        "mask", r.masked_key(F.col("segments"), F.col("mask")).alias("key")).distinct()
    routes = broadcast_if_small(asked)
    near = shaped.join(routes, "route", "left_semi").unionByName(
        shaped.join(routes, "route", "left_anti").join(broadcast_if_small(materialise(probes, "probes")), ["mask", "key"], "left_semi").select(*shaped.columns))
    by_route = link.consumes_api_edges(callers, endpoints=materialise(near.select(*endpoints.columns), "near-endpoints"))

    imported = materialise(link.imported_repos(callers, repos=nodes.select("repo").distinct()), "imported")
    targets = nodes.select(*[c for c in nodes.columns if c not in ("code_content", "file_imports")])
    in_import = imported.select("import_text", "target_repo").distinct().select(
        F.col("target_repo").alias("repo"), F.explode(w.identifiers(F.col("import_text"))).alias("symbol_name")).distinct()
    in_code = link.code_symbols(callers).select("caller_id", F.col("symbol").alias("symbol_name")).join(
        imported.select("caller_id", F.col("target_repo").alias("repo")).distinct(), "caller_id").select("repo", "symbol_name").distinct()
    wanted = broadcast_if_small(materialise(in_import.unionByName(in_code).distinct(), "wanted"))
    targets = materialise(targets.join(wanted, ["repo", "symbol_name"], "left_semi"), "targets")
    return by_route.unionByName(link.imports_edges(targets, imported)).unionByName(link.calls_edges(targets, imported, callers))


def reached_callers(nodes: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(id) of all callers in ``nodes``, the state after the change, whose edges may differ: those of the
    changed files (``old`` and ``new`` are their nodes before and after) and those that the change reaches."""
    endpoints, names = touched_endpoints(old, new), touched_names(old, new)
    return materialise(new.select("id").unionByName(reached_consumers(nodes, endpoints)).unionByName(reached_importers(nodes, names)).distinct(), "reached")
