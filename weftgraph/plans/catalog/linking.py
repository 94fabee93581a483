"""Route matching, imports and calls between repositories."""

from pyspark.sql import functions as F

from weftgraph.functions import routes as rt
from weftgraph.functions import words as w
from weftgraph.operators import link as k
from weftgraph.operators.scale import slices_for
from weftgraph.plans.catalog.book import Book
from weftgraph.session import materialise
from weftgraph.sources import views

BOOK = Book()


def norm_sql(u: str) -> str:
    """Route normalisation in DuckDB terms."""
    path = f"regexp_replace(trim(split_part({u}, '?', 1)), '^https?://[^/]+', '')"
    path = f"CASE WHEN starts_with({path}, '/') THEN {path} ELSE '/' || {path} END"
    path = f"CASE WHEN starts_with({path}, '/api/') THEN substr({path}, 5) ELSE {path} END"
    return f"CASE WHEN rtrim({path}, '/') = '' THEN '/' ELSE rtrim({path}, '/') END"


@BOOK.query(f"SELECT page_id, {norm_sql('url')} AS route FROM pages")
def normalize_route(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", rt.normalize_route(F.col("url")).alias("route"))


SHAPED_URLS = """SELECT page_id, replace(replace(replace(url, '/en/', '/<str:lang>/{{id}}/'), '/fr/', '/:lang-1/'), '/de/', concat('/$', '{{lang}}/')) AS url FROM {pages}"""


@BOOK.query(f"""WITH u AS (SELECT page_id, {norm_sql('url')} AS p FROM {views.duck(SHAPED_URLS)})
SELECT page_id, replace(replace(replace(replace(p, '<str:lang>', '{{_param_}}'), '/{{id}}', '/{{_param_}}'), '${{lang}}', '{{_param_}}'), ':lang-1', '{{_param_}}') AS route FROM u""")
def canonical_route(spark, sf):
    return views.view(spark, sf, SHAPED_URLS).select("page_id", rt.canonical_route(F.col("url")).alias("route"))


@BOOK.query(f"""WITH u AS (SELECT page_id, {norm_sql('url')} AS p FROM {views.duck(SHAPED_URLS)}),
s AS (SELECT page_id, generate_subscripts(string_split(p, '/'), 1) AS i, unnest(string_split(p, '/')) AS seg FROM u)
SELECT page_id, i - 1 AS position, seg AS segment, (seg LIKE ':%' OR seg LIKE '{{%}}' OR seg LIKE '<%>' OR seg = '*') AS wildcard FROM s WHERE seg <> ''""")
def route_segments(spark, sf):
    segs = rt.route_segments(rt.normalize_route(F.col("url")))
    return views.view(spark, sf, SHAPED_URLS).select("page_id", F.posexplode(segs).alias("position", "segment")).select(
        "page_id", (F.col("position") + 1).alias("position"), "segment", rt.is_wildcard(F.col("segment")).alias("wildcard"))


@BOOK.query(r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS host,
trim(split_part(regexp_replace(url, '^https?://[^/]+', ''), '?', 1)) AS path FROM pages)
SELECT page_id, CASE WHEN host <> '' THEN host END AS target_base_url,
CASE WHEN regexp_extract(path, '(/[a-zA-Z0-9_\-/{}:]+)', 1) <> '' THEN regexp_extract(path, '(/[a-zA-Z0-9_\-/{}:]+)', 1) ELSE path END AS consumes_endpoint FROM u""")
def consumer_url_to_route(spark, sf):
    return views.table(spark, sf, "pages").select(
        "page_id", rt.url_host(F.col("url")).alias("target_base_url"), rt.consumed_route(F.col("url")).alias("consumes_endpoint"))


@BOOK.query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(split_part(split_part(url, '?', 1), '#', 1), '\\.(html|png|css|json|js)$')")
def asset_filter(spark, sf):
    path = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    return views.table(spark, sf, "pages").where(
        ~rt.is_asset(path, (".html", ".png", ".css", ".json", ".js"))).select("page_id", "url")


@BOOK.query(r"""SELECT page_id, regexp_replace(list_last(regexp_split_to_array(regexp_replace(regexp_replace(trim(url), '/+$', ''), '\.git$', ''), '[/:\\]')), '[^a-zA-Z0-9_.\-]', '_', 'g') AS repo FROM pages""")
def repo_name(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", rt.repo_name(F.col("url")).alias("repo"))


SOURCE_URLS = """SELECT s_suppkey, CASE WHEN s_acctbal < 2000 THEN concat('https://github.com/orgs/', n_name, '/repositories')
WHEN s_acctbal < 4000 THEN concat('https://github.com/', n_name, '/') WHEN s_acctbal < 6000 THEN concat(' ', n_name, '.x ')
ELSE concat('https://github.com/', n_name, '/s', CAST(s_suppkey AS STRING), '.git') END AS url, n_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""


@BOOK.query("""SELECT s_suppkey, CASE WHEN s_acctbal < 6000 THEN 'owner' ELSE 'repo' END AS kind,
CASE WHEN s_acctbal < 4000 THEN n_name WHEN s_acctbal < 6000 THEN concat(n_name, 'x') ELSE concat('https://github.com/', n_name, '/s', CAST(s_suppkey AS VARCHAR), '.git') END AS value
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def classify_source_url(spark, sf):
    return views.view(spark, sf, SOURCE_URLS).select("s_suppkey", rt.classify_source_url(F.col("url")).alias("c")).select("s_suppkey", "c.*")


# --- routes -----------------------------------------------------------------

def route_nodes(spark, sf):
    """Endpoints and consumers as one node table."""
    ep = views.view(spark, sf, views.ROUTE_ENDPOINTS).withColumn("symbol_type", F.lit("endpoint"))
    co = views.view(spark, sf, views.ROUTE_CONSUMERS).drop("suppkey").withColumn("symbol_type", F.lit("function"))
    return ep.unionByName(co, allowMissingColumns=True)


ROUTES = f"""WITH e AS (SELECT id AS callee_id, repo AS target_repo, endpoint_route, upper(CASE WHEN http_method <> '' THEN http_method ELSE 'GET' END) AS method, {norm_sql('endpoint_route')} AS route, ordinal
  FROM {views.duck(views.ROUTE_ENDPOINTS)}),
c AS (SELECT *, {norm_sql('consumes_endpoint')} AS route, upper(coalesce(consumes_http_method, 'GET')) AS method, coalesce(target_base_url, '') AS base FROM {views.duck(views.ROUTE_CONSUMERS)}),
keys AS (SELECT DISTINCT repo AS caller_repo, method, route FROM c WHERE route <> '/' OR base <> ''),
exact AS (SELECT k.*, x.callee_id, x.target_repo, x.endpoint_route FROM keys k JOIN (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY method, route ORDER BY ordinal DESC) = 1) x USING (method, route)),
by_route AS (SELECT k.*, e.callee_id, e.target_repo, e.endpoint_route FROM keys k JOIN e ON e.route = k.route AND e.target_repo <> k.caller_repo
  WHERE (k.caller_repo, k.method, k.route) NOT IN (SELECT (caller_repo, method, route) FROM exact)
  QUALIFY row_number() OVER (PARTITION BY k.caller_repo, k.method, k.route ORDER BY e.ordinal) = 1),
es AS (SELECT *, list_filter(string_split(route, '/'), lambda s: s <> '') AS segs FROM e),
er AS (SELECT *, list_transform(segs, lambda s: CASE WHEN s LIKE ':%' OR s LIKE '{{%}}' OR s LIKE '<%>' OR s = '*' THEN '1' ELSE '0' END) AS mask FROM es),
left_keys AS (SELECT *, list_filter(string_split(route, '/'), lambda s: s <> '') AS segs FROM keys WHERE route <> '/'
  AND (caller_repo, method, route) NOT IN (SELECT (caller_repo, method, route) FROM exact) AND (caller_repo, method, route) NOT IN (SELECT (caller_repo, method, route) FROM by_route)),
by_shape AS (SELECT k.caller_repo, k.method, k.route, e.callee_id, e.target_repo, e.endpoint_route FROM left_keys k JOIN er e ON len(e.segs) = len(k.segs) AND e.target_repo <> k.caller_repo
  AND len(list_filter(list_zip(e.segs, k.segs, e.mask), lambda z: z[3] = '0' AND lower(z[1]) <> lower(z[2]))) = 0
  QUALIFY row_number() OVER (PARTITION BY k.caller_repo, k.method, k.route ORDER BY array_to_string(e.mask, ''), (e.method <> k.method), e.ordinal) = 1),
resolved AS (SELECT *, 'exact' AS rule FROM exact UNION ALL SELECT *, 'route' FROM by_route UNION ALL SELECT *, 'shape' FROM by_shape)
"""
KEYS = ["caller_repo", "method", "route"]


def _tables(spark, sf):
    n = route_nodes(spark, sf)
    return k.consumer_table(n), k.endpoint_table(n)


@BOOK.query(ROUTES + "SELECT caller_repo, method, route, callee_id, target_repo FROM exact")
def exact_route_join(spark, sf):
    co, ep = _tables(spark, sf)
    return k.exact_match(co.select(*KEYS).distinct(), ep).select(*KEYS, "target.callee_id", "target.target_repo")


@BOOK.query(ROUTES + "SELECT caller_repo, method, route, callee_id, target_repo FROM by_route")
def route_only_join(spark, sf):
    co, ep = _tables(spark, sf)
    keys = co.select(*KEYS).distinct()
    rest = keys.join(k.exact_match(keys, ep).select(*KEYS), KEYS, "left_anti")
    return k.route_only_match(rest, ep).select(*KEYS, "target.callee_id", "target.target_repo")


@BOOK.query(ROUTES + "SELECT caller_repo, method, route, callee_id, endpoint_route, rule FROM resolved WHERE rule = 'shape'")
def parameterised_route_join(spark, sf):
    co, ep = _tables(spark, sf)
    return k.resolve_routes(co, ep).where("rule = 'shape'").select(*KEYS, "target.callee_id", "target.endpoint_route", "rule")


@BOOK.query(ROUTES + """SELECT c.id AS caller_id, e.target_repo, (contains(base, replace(lower(regexp_replace(e.target_repo, '^repo[_-]', '')), '_', '-')) OR contains(base, lower(e.target_repo))) AS allowed
FROM c JOIN exact e ON c.repo = e.caller_repo AND c.method = e.method AND c.route = e.route WHERE c.route = '/' AND base <> ''
UNION ALL SELECT c.id, e.target_repo, (contains(base, replace(lower(regexp_replace(e.target_repo, '^repo[_-]', '')), '_', '-')) OR contains(base, lower(e.target_repo)))
FROM c JOIN by_route e ON c.repo = e.caller_repo AND c.method = e.method AND c.route = e.route WHERE c.route = '/' AND base <> ''""")
def root_guard(spark, sf):
    co, ep = _tables(spark, sf)
    roots = co.where("route = '/'")
    return roots.join(k.resolve_routes(roots, ep), KEYS).select(
        "caller_id", "target.target_repo", k.root_guard(F.col("target.target_repo"), F.col("base")).alias("allowed"))


CONSUMES = ROUTES + """, consumes_api AS (SELECT DISTINCT c.id AS caller_id, r.callee_id, c.route, r.endpoint_route AS target_endpoint_route, c.method AS http_method, c.repo AS caller_repo, r.target_repo
FROM c JOIN resolved r ON c.repo = r.caller_repo AND c.method = r.method AND c.route = r.route
WHERE r.target_repo <> c.repo AND (c.route <> '/' OR (base <> '' AND (contains(base, replace(lower(regexp_replace(r.target_repo, '^repo[_-]', '')), '_', '-')) OR contains(base, lower(r.target_repo))))))
"""


@BOOK.query(CONSUMES + "SELECT * FROM consumes_api")
def consumes_api_edges(spark, sf):
    return k.consumes_api_edges(route_nodes(spark, sf)).select(
        "caller_id", "callee_id", "route", "target_endpoint_route", "http_method", "caller_repo", "target_repo")


PAIRS = f"""SELECT c.id AS caller_id, e.id AS callee_id, c.consumes_endpoint, e.endpoint_route
FROM ({views.ROUTE_CONSUMERS}) c JOIN ({views.ROUTE_ENDPOINTS}) e ON e.ordinal >= c.suppkey * 10 AND e.ordinal < c.suppkey * 10 + 10"""
# one equi-join on the supplier number: the ordinal is suppkey * 10 + k
PAIRS = PAIRS.replace("e.ordinal >= c.suppkey * 10 AND e.ordinal < c.suppkey * 10 + 10", "CAST(floor(e.ordinal / 10) AS BIGINT) = c.suppkey")


@BOOK.query(f"""WITH p AS (SELECT *, {norm_sql('endpoint_route')} AS a, {norm_sql('consumes_endpoint')} AS b FROM {views.duck(PAIRS)}),
s AS (SELECT *, list_filter(string_split(a, '/'), lambda x: x <> '') AS x, list_filter(string_split(b, '/'), lambda x: x <> '') AS y FROM p)
SELECT caller_id, callee_id, (a = b OR (len(x) = len(y) AND len(list_filter(list_zip(x, y), lambda z: NOT (z[1] = z[2] OR z[1] LIKE ':%' OR z[1] LIKE '<%>' OR z[1] LIKE '{{%}}'))) = 0)) AS matches FROM s""")
def route_matches(spark, sf):
    return views.view(spark, sf, PAIRS).select(
        "caller_id", "callee_id", rt.route_matches(F.col("endpoint_route"), F.col("consumes_endpoint")).alias("matches"))


# --- imports and calls ------------------------------------------------------

def import_nodes(spark, sf):
    n = views.view(spark, sf, views.IMPORT_NODES).drop("suppkey")
    empty = F.array().cast("array<string>")
    return n.withColumn("file_imports", F.when(F.col("file_imports")[0] == "", empty).otherwise(F.col("file_imports")))


IMPORTS = f"""WITH n AS (SELECT *, 'svc_' || regexp_extract(array_to_string(file_imports, ';'), '(?i)svc_(nation_[0-9]+)', 1) AS svc FROM {views.duck(views.IMPORT_NODES)}),
t AS (SELECT id AS callee_id, repo AS target_repo, symbol_name, symbol_type FROM n WHERE ordinal < 0),
c AS (SELECT id AS caller_id, repo AS caller_repo, file_imports, code_content, suppkey, 'repo_' || svc AS target_repo, 'supplier_' || suppkey AS symbol,
      CASE WHEN file_imports[1] LIKE './local%' THEN 'symbol' WHEN file_imports[1] LIKE '@acme%' THEN 'repo' ELSE 'none' END AS kind,
      CASE WHEN file_imports[1] LIKE './local%' THEN file_imports[2] ELSE file_imports[1] END AS import_text FROM n WHERE ordinal >= 0),
imports_edges AS (SELECT DISTINCT caller_id, callee_id, import_text, symbol, caller_repo, c.target_repo FROM c JOIN t ON t.symbol_name = c.symbol AND t.target_repo = c.target_repo WHERE kind = 'symbol'),
calls_edges AS (SELECT DISTINCT caller_id, callee_id, symbol, caller_repo, c.target_repo FROM c JOIN t ON t.symbol_name = c.symbol AND t.target_repo = c.target_repo
  WHERE t.symbol_type <> 'endpoint' AND (kind = 'symbol' OR (kind = 'repo' AND code_content LIKE '%SupplierClient%')))
"""


@BOOK.query(IMPORTS + "SELECT DISTINCT caller_id, import_text, target_repo FROM c WHERE kind <> 'none'")
def import_mentions_repo(spark, sf):
    return k.imported_repos(import_nodes(spark, sf)).select("caller_id", "import_text", "target_repo").distinct()


@BOOK.query(IMPORTS + "SELECT * FROM imports_edges")
def imports_edges(spark, sf):
    n = import_nodes(spark, sf)
    return k.imports_edges(n, k.imported_repos(n)).select("caller_id", "callee_id", "import_text", "symbol", "caller_repo", "target_repo")


@BOOK.query(IMPORTS + "SELECT * FROM calls_edges")
def calls_edges(spark, sf):
    # read by several steps; the lines meet their orders once for all of them
    n = materialise(import_nodes(spark, sf), "import-nodes")
    imported = materialise(k.imported_repos(n), "imported")
    return k.calls_edges(n, imported, slices=slices_for(imported.count())).select("caller_id", "callee_id", "symbol", "caller_repo", "target_repo")


_GENERIC = ", ".join(f"'{x}'" for x in w.GENERIC_NAMES)
_PACKAGES = ", ".join(f"'{x}'" for x in w.THIRD_PARTY)


@BOOK.query(f"""WITH t AS (SELECT lower(unnest(string_split(p_name || ' ' || p_type || ' item Next os', ' '))) AS word FROM part)
SELECT word, count(*) AS uses FROM t WHERE word NOT IN ({_GENERIC}) AND word NOT IN ({_PACKAGES}) GROUP BY word""")
def stop_words(spark, sf):
    words = views.table(spark, sf, "part").select(
        F.explode(F.split(F.concat_ws(" ", "p_name", "p_type", F.lit("item Next os")), " ")).alias("word"))
    kept = words.where(~w.is_generic(F.col("word")) & ~F.lower("word").isin(*w.THIRD_PARTY))
    return kept.groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("uses"))


@BOOK.query(CONSUMES + ", im AS (" + IMPORTS + """SELECT caller_id, callee_id, 'imports' AS edge_type, CAST(0.98 AS DOUBLE) AS confidence FROM imports_edges
UNION ALL SELECT caller_id, callee_id, 'calls', 0.95 FROM calls_edges)
SELECT caller_id, callee_id, 'consumes_api' AS edge_type, CAST(1.0 AS DOUBLE) AS confidence FROM consumes_api UNION ALL SELECT * FROM im""")
def link_repositories(spark, sf):
    n = route_nodes(spark, sf).withColumns({"symbol_name": F.lit("route_symbol"), "code_content": F.lit("")}).unionByName(
        import_nodes(spark, sf), allowMissingColumns=True)
    # every rule reads the nodes; the lines meet their orders once for all of them
    return k.link_repositories(materialise(n, "link-nodes")).select("caller_id", "callee_id", "edge_type", "confidence")
