"""Cross-repository edges: HTTP contracts, imports and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.functions import routes as r
from weftgraph.functions import words as w
from weftgraph.operators.scale import ROWS_PER_TASK, broadcast_if_small, in_slices, looked_up, lookup_join, salted_join, slices_for, top_rows
from weftgraph.schema import EDGES, conform
from weftgraph.session import materialise

MAX_MASKS = 20_000


def _method(col: Column) -> Column:
    return F.upper(F.coalesce(F.nullif(col, F.lit("")), F.lit("GET")))


def endpoint_table(nodes: DataFrame) -> DataFrame:
    """Endpoint rows with normal route, method and input order."""
    return nodes.where((F.col("symbol_type") == "endpoint") & (F.coalesce("endpoint_route", F.lit("")) != "")).select(
        F.col("id").alias("callee_id"), F.col("repo").alias("target_repo"), "endpoint_route",
        _method(F.col("http_method")).alias("method"), r.normalize_route(F.col("endpoint_route")).alias("route"), "ordinal")


def consumer_table(nodes: DataFrame) -> DataFrame:
    """Consumer rows; a bare ``/`` without a base URL is dropped."""
    base = F.lower(F.coalesce("target_base_url", F.lit("")))
    route = r.normalize_route(F.col("consumes_endpoint"))
    return nodes.where(F.coalesce("consumes_endpoint", F.lit("")) != "").select(
        F.col("id").alias("caller_id"), F.col("repo").alias("caller_repo"), route.alias("route"),
        _method(F.col("consumes_http_method")).alias("method"), base.alias("base")
    ).where((F.col("route") != "/") | (F.col("base") != ""))


def _target() -> Column:
    return F.struct("callee_id", "target_repo", "endpoint_route")


def _best_two(endpoints: DataFrame, keys: list[str]) -> DataFrame:
    """First endpoint per key, and the first one of another repository.

    That is all "first endpoint outside the consumer's repository" can ever
    need, so a route defined a million times is still one build row.
    """
    per_repo = endpoints.groupBy(*keys, "target_repo").agg(
        F.min("ordinal").alias("ordinal"), F.min_by(_target(), "ordinal").alias("target"))
    ranked = top_rows(per_repo, keys, [F.col("ordinal"), F.col("target_repo")], 2)
    return ranked.groupBy(*keys).agg(
        F.min(F.when(F.col("rank") == 1, F.col("target"))).alias("first"),
        F.min(F.when(F.col("rank") == 2, F.col("target"))).alias("second"))


def _outside(first: str, second: str) -> Column:
    """The earlier of two endpoints that is not in the consumer's repository."""
    return F.when(F.col(f"{first}.target_repo") != F.col("caller_repo"), F.col(first)).otherwise(F.col(second))


def exact_match(keys: DataFrame, endpoints: DataFrame, exclude_own_repo: bool = False) -> DataFrame:
    """``keys(caller_repo, method, route)`` joined on (method, route).

    The last endpoint in input order wins, and an endpoint of the consumer's
    own repository hides the others unless ``exclude_own_repo`` is set.
    """
    if exclude_own_repo:
        latest = endpoints.withColumn("ordinal", -F.col("ordinal"))
        pair = _best_two(latest, ["method", "route"])
        return keys.join(pair, ["method", "route"]).select(*keys.columns, _outside("first", "second").alias("target")).where(
            F.col("target").isNotNull())
    last = endpoints.groupBy("method", "route").agg(F.max_by(_target(), "ordinal").alias("target"))
    return keys.join(last, ["method", "route"]).select(*keys.columns, "target")


def route_only_match(keys: DataFrame, endpoints: DataFrame) -> DataFrame:
    """First endpoint of another repository on the route, whatever its method."""
    pair = _best_two(endpoints, ["route"])
    return keys.join(pair, "route").select(*keys.columns, _outside("first", "second").alias("target")).where(
        F.col("target").isNotNull())


def shaped_endpoints(endpoints: DataFrame) -> DataFrame:
    """Endpoints with the mask and key of their route's segments."""
    return endpoints.select(
        "*", r.route_mask(F.col("route")).alias("mask"), r.route_key(F.col("route")).alias("key"),
    ).withColumn("n_segments", F.length("mask"))


def _with_masks(asked: DataFrame, shaped: DataFrame) -> DataFrame:
    """One row per mask in use for the row's segment count; at least one row.

    ``asked`` needs ``route`` and ``open``; closed rows and rows without a
    mask keep a null one.
    """
    masks = materialise(shaped.where("n_segments > 0").select("n_segments", "mask").distinct(), "masks")
    sized = asked.withColumn("segments", r.route_segments(F.col("route"))).withColumn(
        "n_segments", F.when(F.col("open"), F.size("segments")))
    small = broadcast_if_small(masks, MAX_MASKS)
    if small is masks:
        return salted_join(sized, masks, ["n_segments"], "left", ["route", "caller_repo", "method"])
    return sized.join(small, "n_segments", "left")


def _match_shapes(asked: DataFrame, shaped: DataFrame) -> DataFrame:
    """Adds ``by_shape``: the endpoint met under each row's mask, if any."""
    leaf = ["mask", "key"]
    any_method = _best_two(shaped, leaf).select(*leaf, F.col("first").alias("any_first"), F.col("second").alias("any_second"))
    same_method = _best_two(shaped, [*leaf, "method"]).select(
        *leaf, "method", F.col("first").alias("same_first"), F.col("second").alias("same_second"))
    probes = _with_masks(asked, shaped).withColumn("key", r.masked_key(F.col("segments"), F.col("mask")))
    found = probes.join(any_method, leaf, "left").join(same_method, [*leaf, "method"], "left")
    return found.withColumn("by_shape", F.coalesce(
        _outside("same_first", "same_second"), _outside("any_first", "any_second")))


def parameterised_match(keys: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Match by segments, where an endpoint segment may be a parameter.

    Endpoints are keyed by (mask, key); a consumer builds its key under every
    mask in use for its segment count, so the match is an equi-join. The
    smallest mask wins, then the consumer's method, then input order.
    """
    shaped = materialise(shaped_endpoints(endpoints), "endpoints")
    found = _match_shapes(keys.withColumn("open", F.col("route") != "/"), shaped)
    return found.where(F.col("by_shape").isNotNull()).groupBy(*keys.columns).agg(
        F.min_by("by_shape", "mask").alias("target"))


def root_guard(target_repo: Column, base: Column) -> Column:
    """A consumer of ``/`` must name the producer in its base URL."""
    short = F.replace(F.lower(F.regexp_replace(target_repo, "^repo[_-]", "")), F.lit("_"), F.lit("-"))
    return base.contains(short) | base.contains(F.lower(target_repo))


def resolve_routes(consumers: DataFrame, endpoints: DataFrame, exclude_own_repo: bool = False) -> DataFrame:
    """Target per distinct (repo, method, route) of the consumers.

    Exact match first, then route only, then by shape. The three lookups are
    chained over one pass of the distinct keys, so a route that a third of all
    consumers call is resolved once per repository.
    """
    names = ["caller_repo", "method", "route"]
    shaped = materialise(shaped_endpoints(endpoints), "endpoints")
    pair = _best_two(shaped, ["route"]).select(
        "route", F.col("first").alias("route_first"), F.col("second").alias("route_second"))
    if exclude_own_repo:
        exact = _best_two(shaped.withColumn("ordinal", -F.col("ordinal")), ["method", "route"]).select(
            "method", "route", F.col("first").alias("exact_first"), F.col("second").alias("exact_second"))
        by_exact = _outside("exact_first", "exact_second")
    else:
        exact = shaped.groupBy("method", "route").agg(F.max_by(_target(), "ordinal").alias("exact_first"))
        by_exact = F.col("exact_first")
    keys = consumers.select(*names).distinct()
    direct = keys.join(exact, ["method", "route"], "left").join(pair, "route", "left").select(
        *names, by_exact.alias("by_exact"), _outside("route_first", "route_second").alias("by_route"))
    asked = direct.withColumn("open", F.coalesce("by_exact", "by_route").isNull() & (F.col("route") != "/"))
    found = _match_shapes(asked, shaped)
    target = F.coalesce("by_exact", "by_route", "by_shape")
    rule = (F.when(F.col("by_exact").isNotNull(), "exact").when(F.col("by_route").isNotNull(), "route").otherwise("shape"))
    return found.where(target.isNotNull()).groupBy(*names).agg(
        F.min_by(F.struct(target.alias("target"), rule.alias("rule")), F.coalesce("mask", F.lit(""))).alias("m")
    ).select(*names, "m.target", "m.rule")


def consumes_api_edges(
    nodes: DataFrame, exclude_own_repo: bool = False, rows_per_task: int = ROWS_PER_TASK, endpoints: DataFrame | None = None, slices: int = 1,
) -> DataFrame:
    """One edge per consumer whose route is served by another repository.

    ``endpoints``, if given, stands for the endpoints of ``nodes``. The callers
    are linked in ``slices``, each written before the next.
    """
    consumers = consumer_table(nodes)
    endpoints = endpoint_table(nodes) if endpoints is None else endpoints
    resolved = resolve_routes(consumers, endpoints, exclude_own_repo)
    table = materialise(resolved, "lookup")

    def linked(part) -> DataFrame:
        hit = looked_up(part(consumers, "caller_id"), table, ["caller_repo", "method", "route"], "inner", ["caller_id"], rows_per_task)
        kept = hit.select("caller_id", "caller_repo", "route", "method", "base", "target.*").where(
            (F.col("target_repo") != F.col("caller_repo"))
            & ((F.col("route") != "/") | root_guard(F.col("target_repo"), F.col("base"))))
        return conform(kept.select(
            "caller_id", "callee_id", F.lit("consumes_api").alias("edge_type"), F.lit(1.0).alias("confidence"), "route",
            F.col("endpoint_route").alias("target_endpoint_route"), F.col("method").alias("http_method"), "caller_repo", "target_repo",
        ).dropDuplicates(["caller_id", "callee_id"]), EDGES)

    return in_slices(slices, linked, "consumes-api")


# --- imports and calls ------------------------------------------------------

DELIMITERS = r"[\s'\"`/@]"


def repo_aliases(nodes: DataFrame) -> DataFrame:
    """Lower-cased names under which a repository may be imported."""
    repos = nodes.select(F.col("repo").alias("target_repo")).distinct()
    short = F.regexp_replace("target_repo", "^repo[_-]", "")
    usable = (F.length(short) >= 4) & ~F.lower(short).isin(*w.THIRD_PARTY)
    return repos.select("target_repo", F.explode(F.array_distinct(F.array_compact(F.array(
        F.lower("target_repo"), F.when(usable, F.lower(short)))))).alias("alias"))


def import_repos(imports: DataFrame, aliases: DataFrame, few: bool = False) -> DataFrame:
    """``imports(import_text)`` → the repositories each text mentions.

    A mention is delimited text, so the candidates of an import are its
    delimited chunks and, for names with dots, the runs of their dot parts.
    With ``few`` aliases, texts are compared where they are, before any is shuffled.
    """
    aliases = materialise(aliases, "aliases")
    longest = aliases.agg(F.max(F.size(F.split("alias", r"\.")))).first()[0] or 1
    distinct = imports.select("import_text")
    if few:
        aliases = broadcast_if_small(aliases)
    else:
        distinct = distinct.distinct()
    clean = F.translate(r.strip(F.col("import_text")), "\\", "/")
    parts = F.filter(F.split(F.lower(clean), r"[\s./'\"`]"), lambda p: p != "")
    root = F.when((F.size(parts) > 1) & F.get(parts, F.lit(0)).isin(*w.IMPORT_WORDS), F.get(parts, F.lit(1)))
    chunks = distinct.select(
        "import_text", F.when(root.isin(*w.THIRD_PARTY), root).alias("package"),
        F.explode(F.split(F.lower(clean), DELIMITERS)).alias("chunk")).withColumn("dots", F.split("chunk", r"\."))
    sizes = F.sequence(F.lit(1), F.least(F.size("dots"), F.lit(longest)))
    runs = F.flatten(F.transform(sizes, lambda k: F.transform(
        F.sequence(F.lit(1), F.size("dots") - k + 1), lambda i: F.array_join(F.slice("dots", i, k), "."))))
    named = chunks.select("import_text", "package", F.explode(F.array_distinct(runs)).alias("alias"))
    return (named if few else named.distinct()).join(aliases, "alias").where(
        F.col("package").isNull() | (F.col("package") == F.col("alias"))).select("import_text", "target_repo").distinct()


def _node_imports(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.size("file_imports") > 0).select(
        F.col("id").alias("caller_id"), F.col("repo").alias("caller_repo"), F.posexplode("file_imports").alias("position", "import_text"))


def imported_repos(nodes: DataFrame, rows_per_task: int = ROWS_PER_TASK, repos: DataFrame | None = None) -> DataFrame:
    """(caller, import, other repository it names); ``repos(repo)``, if given, are all repositories there are."""
    used = _node_imports(nodes)
    mentions = import_repos(used, repo_aliases(nodes if repos is None else repos))
    return lookup_join(used, mentions, ["import_text"], "inner", ["caller_id", "position"], rows_per_task).where(
        F.col("target_repo") != F.col("caller_repo"))


def imports_edges(nodes: DataFrame, imported: DataFrame, rows_per_task: int = ROWS_PER_TASK, slices: int = 1) -> DataFrame:
    """Edges to the symbols an import statement names in the other repository; the callers are linked in ``slices``."""
    last = nodes.groupBy(F.col("repo").alias("target_repo"), F.col("symbol_name").alias("symbol")).agg(
        F.max_by("id", "ordinal").alias("callee_id"))
    names = imported.select("import_text", "target_repo").distinct().select(
        "import_text", "target_repo", F.explode(w.identifiers(F.col("import_text"))).alias("symbol")
    ).where(~w.is_generic(F.col("symbol"))).join(last, ["target_repo", "symbol"])
    table = materialise(names, "lookup")

    def linked(part) -> DataFrame:
        hit = looked_up(part(imported, "caller_id"), table, ["import_text", "target_repo"], "inner", ["caller_id", "position"], rows_per_task)
        first = hit.groupBy("caller_id", "callee_id").agg(F.min_by(
            F.struct("import_text", "symbol", "caller_repo", "target_repo"), F.struct("position", "symbol")).alias("m"))
        return conform(first.select("caller_id", "callee_id", F.lit("imports").alias("edge_type"), F.lit(0.98).alias("confidence"), "m.*"), EDGES)

    return in_slices(slices, linked, "imports")


def code_symbols(code: DataFrame) -> DataFrame:
    """(caller_id, symbol, by_client): what the code of each node names, but for itself and generic words."""
    return code.where(F.col("code_content") != "").select(
        F.col("id").alias("caller_id"), "symbol_name", w.client_calls(F.col("code_content")).alias("clients"),
        F.explode(w.identifiers(F.col("code_content"))).alias("symbol"),
    ).where((F.col("symbol") != F.col("symbol_name")) & ~w.is_generic(F.col("symbol"))).select(
        "caller_id", "symbol", F.array_contains("clients", F.col("symbol")).alias("by_client"))


def calls_edges(nodes: DataFrame, imported: DataFrame, callers: DataFrame | None = None, slices: int = 1) -> DataFrame:
    """Edges to functions, methods and classes used from an imported repository.

    ``callers``, if given, are the nodes whose code is read; ``nodes`` are the
    targets. The callers are linked in ``slices``, each written before the next.
    """
    table = materialise(nodes.where(F.col("symbol_type").isin("function", "method", "class")).select(
        F.col("id").alias("callee_id"), F.col("repo").alias("target_repo"), F.col("symbol_name").alias("symbol")), "lookup")

    def linked(part) -> DataFrame:
        here = part(imported, "caller_id")
        per_repo = here.groupBy("caller_id", "caller_repo", "target_repo").agg(F.collect_set("import_text").alias("import_texts"))
        code = part(nodes if callers is None else callers, "id").join(here.select(F.col("caller_id").alias("id")).distinct(), "id", "left_semi")
        named = F.exists("import_texts", lambda i: i.contains(F.col("symbol")))
        hit = code_symbols(code).join(per_repo, "caller_id").where(F.col("by_client") | named)
        hit = looked_up(hit, table, ["target_repo", "symbol"], "inner", ["caller_id"])
        return conform(hit.select(
            "caller_id", "callee_id", F.lit("calls").alias("edge_type"), F.lit(0.95).alias("confidence"),
            "symbol", "caller_repo", "target_repo").dropDuplicates(["caller_id", "callee_id"]), EDGES)

    return in_slices(slices, linked, "calls")


def link_repositories(nodes: DataFrame) -> DataFrame:
    """All cross-repository edges of a node table with an ``ordinal`` column."""
    imported = materialise(imported_repos(nodes), "imported")
    slices = slices_for(imported.count())
    return consumes_api_edges(nodes, slices=slices).unionByName(imports_edges(nodes, imported, slices=slices)).unionByName(
        calls_edges(nodes, imported, slices=slices))
