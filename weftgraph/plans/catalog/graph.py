"""Lookups, neighbours, traversal and rankings on the customer/supplier/part graph."""

from pyspark.sql import functions as F

from weftgraph.operators import graph as g
from weftgraph.operators import traverse as t
from weftgraph.plans.catalog.book import GRAPH, Book, edges, nodes, one_column

BOOK = Book()
SUPPLIER_ID = "(SELECT id FROM nodes WHERE symbol_name = 'supplier_3')"
BRIEF = ("id", "repo", "file_path", "symbol_name", "symbol_type", "start_line", "end_line")


def _supplier_id(spark, sf):
    """The id of one named symbol; the request every lookup starts from."""
    return g.nodes_by_name(nodes(spark, sf), "supplier_3").select("id").first()["id"]


@BOOK.query(f"WITH {GRAPH} SELECT id, repo, file_path, symbol_name, symbol_type, start_line, end_line FROM nodes WHERE id = {SUPPLIER_ID}")
def node_by_id(spark, sf):
    return g.node_by_id(nodes(spark, sf), _supplier_id(spark, sf)).select(*BRIEF)


@BOOK.query(f"""WITH {GRAPH} SELECT id, repo, file_path, symbol_name, symbol_type, start_line, end_line
FROM nodes WHERE symbol_name = 'part_100'""")
def nodes_by_name(spark, sf):
    return g.nodes_by_name(nodes(spark, sf), "part_100").select(*BRIEF)


@BOOK.query(f"""WITH {GRAPH} SELECT n.id, e.edge_type, n.repo, n.symbol_name FROM nodes n
JOIN edges e ON n.id = e.caller_id WHERE e.callee_id = {SUPPLIER_ID}""")
def callers(spark, sf):
    return g.callers(nodes(spark, sf), edges(spark, sf), _supplier_id(spark, sf)).select("id", "edge_type", "repo", "symbol_name")


@BOOK.query(f"""WITH {GRAPH} SELECT n.id, e.edge_type, n.repo, n.symbol_name FROM nodes n
JOIN edges e ON n.id = e.callee_id WHERE e.caller_id = {SUPPLIER_ID}""")
def callees(spark, sf):
    return g.callees(nodes(spark, sf), edges(spark, sf), _supplier_id(spark, sf)).select("id", "edge_type", "repo", "symbol_name")


def _all_suppliers(spark, sf):
    return nodes(spark, sf).where(F.col("symbol_type") == "endpoint").select(F.col("symbol_name").alias("target"))


@BOOK.query(f"""WITH {GRAPH}, s AS (SELECT id, symbol_name AS target FROM nodes WHERE symbol_type = 'endpoint')
SELECT target, 'upstream' AS direction, e.caller_id AS node_id, e.edge_type, n.repo FROM s JOIN edges e ON s.id = e.callee_id JOIN nodes n ON n.id = e.caller_id
UNION ALL
SELECT target, 'downstream', e.callee_id, e.edge_type, n.repo FROM s JOIN edges e ON s.id = e.caller_id JOIN nodes n ON n.id = e.callee_id""")
def usage_links(spark, sf):
    n = nodes(spark, sf)
    return g.usage_links(n, edges(spark, sf), _all_suppliers(spark, sf)).select("target", "direction", "node_id", "edge_type", "repo")


@BOOK.query(f"""WITH {GRAPH} SELECT symbol_name AS target,
(SELECT count(*) FROM edges e WHERE e.callee_id = n.id) AS upstream_callers_count,
(SELECT count(*) FROM edges e WHERE e.caller_id = n.id) AS downstream_callees_count FROM nodes n WHERE symbol_type = 'endpoint'""")
def usage_counts(spark, sf):
    n = nodes(spark, sf)
    return g.usage_counts(g.usage_links(n, edges(spark, sf), _all_suppliers(spark, sf)))


def _recursive(roots: str) -> str:
    return f"""WITH RECURSIVE {GRAPH},
roots AS ({roots}),
walk(root, direction, node_id, depth) AS (
  SELECT root, d.direction, id, 0 FROM roots CROSS JOIN (VALUES ('upstream'), ('downstream')) d(direction)
  UNION
  SELECT w.root, w.direction, CASE WHEN w.direction = 'upstream' THEN e.caller_id ELSE e.callee_id END, w.depth + 1
  FROM walk w JOIN edges e ON (CASE WHEN w.direction = 'upstream' THEN e.callee_id ELSE e.caller_id END) = w.node_id
  WHERE w.depth < 3),
reach AS (SELECT root, direction, node_id, min(depth) AS depth FROM walk GROUP BY ALL)
"""


ONE_PART = "SELECT symbol_name AS root, id FROM nodes WHERE symbol_name = 'part_100'"
EVERY_SUPPLIER = "SELECT symbol_name AS root, id FROM nodes WHERE symbol_type = 'endpoint'"


@BOOK.query(_recursive(ONE_PART) + "SELECT root, direction, node_id, depth FROM reach WHERE depth > 0")
def blast_radius(spark, sf):
    walk = t.blast_radius(nodes(spark, sf), edges(spark, sf), one_column(spark, "root", ["part_100"]))
    return walk.where(F.col("depth") > 0).select("root", "direction", "node_id", "depth")


def _supplier_walk(spark, sf):
    n = nodes(spark, sf)
    roots = n.where(F.col("symbol_type") == "endpoint").select(F.col("symbol_name").alias("root"))
    return n, t.blast_radius(n, edges(spark, sf), roots)


@BOOK.query(_recursive(EVERY_SUPPLIER) + "SELECT root, direction, node_id, depth FROM reach WHERE depth > 0")
def blast_radius_all_endpoints(spark, sf):
    return t.blast_union(_supplier_walk(spark, sf)[1])


@BOOK.query(_recursive(EVERY_SUPPLIER) + """SELECT DISTINCT root, concat(repo, ':', file_path) AS file_ref
FROM reach JOIN nodes ON node_id = id""")
def blast_files(spark, sf):
    n, walk = _supplier_walk(spark, sf)
    return t.blast_files(walk, n)


@BOOK.query(_recursive(EVERY_SUPPLIER) + """SELECT root, count(DISTINCT CASE WHEN depth > 0 AND direction = 'upstream' THEN node_id END) AS upstream_callers,
count(DISTINCT CASE WHEN depth > 0 AND direction = 'downstream' THEN node_id END) AS downstream_dependencies,
count(DISTINCT CASE WHEN depth > 0 THEN repo END) AS affected_repositories,
count(DISTINCT concat(repo, ':', file_path)) AS blast_files
FROM reach JOIN nodes ON node_id = id GROUP BY root""")
def traversal_summary(spark, sf):
    n, walk = _supplier_walk(spark, sf)
    return t.traversal_summary(walk, n)


@BOOK.query(f"""WITH {GRAPH} SELECT 'total_symbols' AS metric, count(*) AS value FROM nodes
UNION ALL SELECT 'repositories', count(DISTINCT repo) FROM nodes
UNION ALL SELECT 'total_edges', count(*) FROM edges
UNION ALL SELECT 'cross_repo_edges', count(*) FROM edges WHERE edge_type = 'consumes_api'""")
def graph_stats(spark, sf):
    return g.graph_stats(nodes(spark, sf), edges(spark, sf))


@BOOK.query(f"WITH {GRAPH} SELECT DISTINCT repo FROM nodes")
def repositories(spark, sf):
    return g.repositories(nodes(spark, sf))


@BOOK.query(f"""WITH {GRAPH} SELECT id, repo, file_path, CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR) AS lines, signature, code_content
FROM nodes WHERE symbol_type = 'endpoint'""")
def code_chunk(spark, sf):
    n = nodes(spark, sf)
    return g.code_chunks(n, n.where(F.col("symbol_type") == "endpoint").select("id"))


TWO_REPOS = ["web_nation_1", "svc_nation_1", "svc_nation_2", "web_nation_2", "svc_nation_15", "svc_nation_20"]
_LIST = ", ".join(f"'{r}'" for r in TWO_REPOS)


@BOOK.query(f"""WITH {GRAPH} SELECT e.caller_id, e.callee_id, e.edge_type FROM edges e
JOIN nodes a ON a.id = e.caller_id JOIN nodes b ON b.id = e.callee_id WHERE a.repo IN ({_LIST}) AND b.repo IN ({_LIST})""")
def induced_subgraph(spark, sf):
    return g.induced_edges(nodes(spark, sf), edges(spark, sf), TWO_REPOS).select("caller_id", "callee_id", "edge_type")


@BOOK.query(f"""WITH {GRAPH} SELECT DISTINCT 'caller' AS side, caller_id AS node_id FROM edges WHERE callee_id = {SUPPLIER_ID}
UNION ALL SELECT DISTINCT 'callee', callee_id FROM edges WHERE caller_id = {SUPPLIER_ID}""")
def one_hop_ids(spark, sf):
    return g.one_hop(edges(spark, sf), _supplier_id(spark, sf))


RANKING = f"""WITH {GRAPH},
i AS (SELECT callee_id AS id, count(*) AS inbound FROM edges GROUP BY 1),
o AS (SELECT caller_id AS id, count(*) AS outbound FROM edges GROUP BY 1),
x AS (SELECT unnest([e.caller_id, e.callee_id]) AS id, a.repo <> b.repo AS cross_repo FROM edges e JOIN nodes a ON a.id = e.caller_id JOIN nodes b ON b.id = e.callee_id),
xs AS (SELECT id, bool_or(cross_repo) AS is_cross_repo FROM x GROUP BY id),
ranking AS (SELECT n.id, symbol_name AS label, repo, file_path, CASE symbol_type WHEN 'endpoint' THEN 'endpoint' WHEN 'class' THEN 'class' ELSE 'function' END AS kind,
  coalesce(inbound, 0) AS inbound, coalesce(outbound, 0) AS outbound, coalesce(inbound, 0) + coalesce(outbound, 0) AS total_relations, coalesce(is_cross_repo, false) AS is_cross_repo
  FROM nodes n LEFT JOIN i USING (id) LEFT JOIN o USING (id) LEFT JOIN xs USING (id))
"""


@BOOK.query(RANKING + "SELECT * FROM ranking")
def degree_ranking(spark, sf):
    return g.degree_ranking(nodes(spark, sf), edges(spark, sf))


@BOOK.query(RANKING + "SELECT * FROM ranking WHERE kind = 'class' AND (contains(lower(label), 'brand_1') OR contains(lower(repo), 'brand_1') OR contains(lower(file_path), 'brand_1'))")
def ranked_filter(spark, sf):
    return g.ranked_filter(g.degree_ranking(nodes(spark, sf), edges(spark, sf)), "class", " Brand_1 ")


@BOOK.query(f"""WITH {GRAPH}, linked AS (SELECT caller_id AS id FROM edges UNION SELECT callee_id FROM edges),
ranked AS (SELECT n.id, symbol_name AS label, repo, file_path, start_line, end_line,
  CASE symbol_type WHEN 'endpoint' THEN 'endpoint' WHEN 'class' THEN 'class' ELSE 'function' END AS kind,
  row_number() OVER (PARTITION BY repo ORDER BY (l.id IS NULL), CASE symbol_type WHEN 'endpoint' THEN 0 WHEN 'class' THEN 1 ELSE 2 END, file_path, start_line, n.id) AS position
  FROM nodes n LEFT JOIN linked l ON l.id = n.id)
SELECT * FROM ranked WHERE position <= 72""")
def display_nodes(spark, sf):
    return g.display_nodes(nodes(spark, sf), edges(spark, sf))


@BOOK.query(f"""WITH {GRAPH} SELECT caller_id AS from_id, callee_id AS to_id, edge_type,
CASE edge_type WHEN 'consumes_api' THEN 'http' WHEN 'imports' THEN 'imports' ELSE 'calls' END AS kind FROM edges""")
def edge_kinds(spark, sf):
    return g.edge_list(edges(spark, sf))


@BOOK.query(f"""WITH {GRAPH} SELECT DISTINCT repo, CASE WHEN repo LIKE '%auth%' OR repo LIKE '%core%' OR repo LIKE '%backend%' THEN 0
WHEN repo LIKE '%sdk%' OR repo LIKE '%shared%' OR repo LIKE '%common%' THEN 1
WHEN repo LIKE '%front%' OR repo LIKE '%portal%' OR repo LIKE '%ui%' THEN 2 ELSE 3 END AS lane FROM nodes""")
def repo_order(spark, sf):
    return g.repo_order(nodes(spark, sf))
