"""Organisation reports on the customer/supplier/part graph."""

from weftgraph.operators import report as r
from weftgraph.plans.catalog.book import GRAPH, Book, edges, nodes
from weftgraph.sources import views
from pyspark.sql import functions as F

BOOK = Book()
LANG = """CASE WHEN file_path LIKE '%.py' THEN 'Python' WHEN file_path LIKE '%.ts' THEN 'TypeScript' WHEN file_path LIKE '%.go' THEN 'Go' ELSE upper(regexp_extract(file_path, '([^.]*)$', 1)) END"""
INVENTORY = f"""WITH {GRAPH},
lang AS (SELECT repo, {LANG} AS language, count(*) AS n FROM nodes GROUP BY ALL),
top AS (SELECT repo, language AS primary_language FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, language) AS rn FROM lang) WHERE rn = 1)
"""


@BOOK.query(INVENTORY + """SELECT repo, count(DISTINCT file_path) AS total_files, count(*) AS total_symbols,
count(*) FILTER (symbol_type = 'endpoint') AS endpoints_count, count(*) FILTER (symbol_type = 'class') AS classes_count,
count(*) FILTER (symbol_type IN ('function', 'method')) AS functions_count, any_value(primary_language) AS primary_language
FROM nodes JOIN top USING (repo) GROUP BY repo""")
def repo_inventory(spark, sf):
    return r.repo_inventory(nodes(spark, sf))


@BOOK.query(INVENTORY + "SELECT * FROM top")
def primary_language(spark, sf):
    return r.primary_language(nodes(spark, sf))


@BOOK.query(f"WITH {GRAPH} SELECT DISTINCT repo, file_path FROM nodes")
def repo_files(spark, sf):
    return r.repo_files(nodes(spark, sf))


@BOOK.query(f"WITH {GRAPH} SELECT repo, symbol_name, id FROM nodes WHERE symbol_type = 'endpoint'")
def repo_endpoints(spark, sf):
    return r.repo_endpoints(nodes(spark, sf))


CONTRACTS = f"""WITH {GRAPH}, contracts AS (
SELECT a.repo AS caller_repo, a.file_path AS caller_file, a.symbol_name AS caller_symbol, b.repo AS callee_repo, b.file_path AS callee_file, b.symbol_name AS callee_symbol, e.edge_type,
CASE WHEN a.consumes_endpoint <> '' THEN a.consumes_endpoint WHEN b.endpoint_route <> '' THEN b.endpoint_route ELSE '' END AS route,
CASE WHEN a.consumes_http_method <> '' THEN a.consumes_http_method WHEN b.http_method <> '' THEN b.http_method ELSE 'GET' END AS http_method
FROM edges e JOIN nodes a ON a.id = e.caller_id JOIN nodes b ON b.id = e.callee_id WHERE a.repo <> b.repo)
"""


@BOOK.query(CONTRACTS + "SELECT * FROM contracts")
def contract_matrix(spark, sf):
    return r.contract_matrix(nodes(spark, sf), edges(spark, sf))


@BOOK.query(CONTRACTS + "SELECT caller_repo, callee_repo, count(*) AS links FROM contracts GROUP BY ALL")
def dependency_matrix(spark, sf):
    return r.dependency_matrix(nodes(spark, sf), edges(spark, sf))


@BOOK.query(CONTRACTS + """SELECT caller_repo, CAST(sum(CASE WHEN callee_repo = 'svc_nation_15' THEN 1 END) AS BIGINT) AS svc_nation_15,
CAST(sum(CASE WHEN callee_repo = 'svc_nation_20' THEN 1 END) AS BIGINT) AS svc_nation_20 FROM contracts GROUP BY caller_repo""")
def dependency_matrix_wide(spark, sf):
    return r.dependency_matrix_wide(nodes(spark, sf), edges(spark, sf), ["svc_nation_15", "svc_nation_20"])


@BOOK.query(f"""WITH {GRAPH}, l AS (SELECT a.repo AS x, b.repo AS y FROM edges e JOIN nodes a ON a.id = e.caller_id JOIN nodes b ON b.id = e.callee_id)
SELECT 'total_repositories' AS metric, count(DISTINCT repo) AS value FROM nodes
UNION ALL SELECT 'total_files', count(DISTINCT (repo, file_path)) FROM nodes
UNION ALL SELECT 'total_symbols', count(*) FROM nodes
UNION ALL SELECT 'total_edges', count(*) FROM l
UNION ALL SELECT 'cross_repo_contracts_count', count(*) FROM l WHERE x <> y""")
def totals(spark, sf):
    return r.totals(nodes(spark, sf), edges(spark, sf))


SUBSET = ["web_nation_1", "web_nation_2", "svc_nation_15", "svc_nation_20"]
_LIST = ", ".join(f"'{x}'" for x in SUBSET)


@BOOK.query(CONTRACTS + f"""SELECT caller_repo, callee_repo, edge_type, route, count(*) AS links FROM contracts
WHERE caller_repo IN ({_LIST}) AND callee_repo IN ({_LIST}) GROUP BY ALL""")
def repo_subset_contracts(spark, sf):
    n, e = r.repo_subset(nodes(spark, sf), edges(spark, sf), SUBSET)
    return r.contract_matrix(n, e).groupBy("caller_repo", "callee_repo", "edge_type", "route").agg(F.count(F.lit(1)).alias("links"))


SYMBOLS = "concat('`', symbol_name, '` (', symbol_type, ': L', CAST(start_line AS VARCHAR), '-', CAST(end_line AS VARCHAR), ')')"


@BOOK.query(f"WITH {GRAPH} SELECT repo, file_path, string_agg({SYMBOLS}, ', ' ORDER BY start_line, id) AS symbols FROM nodes GROUP BY ALL")
def symbol_map(spark, sf):
    return r.symbol_map(nodes(spark, sf))


RULE = "---"
BLUEPRINT = CONTRACTS + f""", lang AS (SELECT repo, {LANG} AS language, count(*) AS n FROM nodes GROUP BY ALL),
top AS (SELECT repo, arg_max(language, (n, -ascii(language))) AS primary_language FROM lang GROUP BY repo),
lines AS (
SELECT 0 AS section, * FROM (VALUES ('{RULE}'), ('# Code graph of all repositories'), ('{RULE}')) v(line)
UNION ALL SELECT 0, concat('Written from the symbol graph: ', CAST(count(DISTINCT repo) AS VARCHAR), ' repositories') FROM nodes
UNION ALL SELECT 1, * FROM (VALUES (''), ('## Repositories')) v(line)
UNION ALL SELECT 2, concat('* `', repo, '`, mostly ', any_value(primary_language), ': ', CAST(count(*) AS VARCHAR), ' symbols in ', CAST(count(DISTINCT file_path) AS VARCHAR), ' files') FROM nodes JOIN top USING (repo) GROUP BY repo
UNION ALL SELECT 2, concat('  * serves ', symbol_name) FROM nodes WHERE symbol_type = 'endpoint'
UNION ALL SELECT 3, * FROM (VALUES (''), ('## Calls between repositories'), ('Who refers to whom, and how: caller, kind of reference with its route, target.')) v(line)
UNION ALL SELECT 4, concat('* ', caller_repo, '/', caller_file, ' `', caller_symbol, '` ', edge_type, CASE WHEN route <> '' THEN concat(' (', http_method, ' ', route, ')') ELSE '' END, ' ', callee_repo, '/', callee_file, ' `', callee_symbol, '`') FROM contracts
UNION ALL SELECT 5, * FROM (VALUES (''), ('## Symbols by file'), ('Line numbers are those of the indexed texts.')) v(line)
UNION ALL SELECT DISTINCT 6, concat('### `', repo, '`') FROM nodes
UNION ALL SELECT 6, concat('* ', file_path, ': ', string_agg({SYMBOLS}, ', ' ORDER BY start_line, id)) FROM nodes GROUP BY repo, file_path
UNION ALL SELECT 7, * FROM (VALUES (''), ('{RULE}'), ('How to use this report:'), ('* Before an endpoint changes, look up its callers under the second heading.'),
('* Ask for the lines of a symbol, not for its file.'), ('* After a change every listed call must still be answered.'), ('{RULE}')) v(line))
"""


@BOOK.query(BLUEPRINT + "SELECT section, line FROM lines")
def blueprint(spark, sf):
    return r.blueprint_lines(nodes(spark, sf), edges(spark, sf)).select("section", "line")


@BOOK.query(BLUEPRINT + "SELECT CAST((sum(length(line)) + count(*) - 1) // 4 AS BIGINT) AS approx_tokens FROM lines")
def blueprint_tokens(spark, sf):
    return r.blueprint_tokens(r.blueprint_lines(nodes(spark, sf), edges(spark, sf)))


@BOOK.query("SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def approx_tokens(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", r.approx_tokens(F.col("text")).alias("tokens"))
