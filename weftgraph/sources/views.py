"""Projections that present the test tables as the library's inputs.

Each view is one SQL text that Spark and DuckDB both accept, with the table
names in braces, so an oracle can start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# --- customers, suppliers and parts as symbols -----------------------------
NODES = """
SELECT concat('web_', lower(n_name), ':src/', lower(c_mktsegment), '/customer_', CAST(c_custkey AS STRING), '.ts:customer_', CAST(c_custkey AS STRING), ':1') AS id,
       concat('web_', lower(n_name)) AS repo,
       concat('src/', lower(c_mktsegment), '/customer_', CAST(c_custkey AS STRING), '.ts') AS file_path,
       concat('customer_', CAST(c_custkey AS STRING)) AS symbol_name,
       'function' AS symbol_type, 1 AS start_line, CAST(5 + c_nationkey AS INT) AS end_line,
       concat('function customer_', CAST(c_custkey AS STRING), '() {{') AS signature, c_name AS docstring,
       concat('function customer_', CAST(c_custkey AS STRING), '() {{ return fetch("/v1/suppliers/', CAST(c_nationkey AS STRING), '"); }}') AS code_content,
       CAST(NULL AS STRING) AS endpoint_route, CAST(NULL AS STRING) AS http_method,
       CASE WHEN c_mktsegment = 'BUILDING' THEN concat('/v1/accounts/', CAST(c_nationkey AS STRING)) END AS consumes_endpoint,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'POST' WHEN c_mktsegment = 'MACHINERY' THEN '' END AS consumes_http_method
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL
SELECT concat('svc_', lower(n_name), ':app/supplier_', CAST(s_suppkey AS STRING), '.py:supplier_', CAST(s_suppkey AS STRING), ':1'),
       concat('svc_', lower(n_name)),
       concat('app/supplier_', CAST(s_suppkey AS STRING), '.py'),
       concat('supplier_', CAST(s_suppkey AS STRING)),
       'endpoint', 1, CAST(10 + s_nationkey AS INT),
       concat('def supplier_', CAST(s_suppkey AS STRING), '(req):'), s_name,
       concat('@app.get("/v1/suppliers/', CAST(s_suppkey AS STRING), '")', chr(10), 'def supplier_', CAST(s_suppkey AS STRING), '(req):', chr(10), '    return {{"id": req}}'),
       concat('/v1/suppliers/', CAST(s_suppkey AS STRING)),
       CASE WHEN s_acctbal < 5000 THEN 'GET' END,
       CAST(NULL AS STRING), CAST(NULL AS STRING)
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL
SELECT concat('lib_', lower(replace(p_brand, '#', '_')), ':src/', lower(p_type), '/part_', CAST(p_partkey AS STRING), '.go:part_', CAST(p_partkey AS STRING), ':2'),
       concat('lib_', lower(replace(p_brand, '#', '_'))),
       concat('src/', lower(p_type), '/part_', CAST(p_partkey AS STRING), '.go'),
       concat('part_', CAST(p_partkey AS STRING)),
       'class', 2, CAST(2 + p_size AS INT),
       concat('type part_', CAST(p_partkey AS STRING), ' struct {{'), p_name,
       concat('type part_', CAST(p_partkey AS STRING), ' struct {{ }} // ', p_name),
       CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING)
FROM {part}
"""

_CUST = "concat('web_', lower(cn.n_name), ':src/', lower(c.c_mktsegment), '/customer_', CAST(c.c_custkey AS STRING), '.ts:customer_', CAST(c.c_custkey AS STRING), ':1')"
_SUPP = "concat('svc_', lower(sn.n_name), ':app/supplier_', CAST(s.s_suppkey AS STRING), '.py:supplier_', CAST(s.s_suppkey AS STRING), ':1')"


def _part_id(alias: str) -> str:
    return (f"concat('lib_', lower(replace({alias}.p_brand, '#', '_')), ':src/', lower({alias}.p_type), '/part_', "
            f"CAST({alias}.p_partkey AS STRING), '.go:part_', CAST({alias}.p_partkey AS STRING), ':2')")


# customer -> supplier (HTTP, plus a direct call for returned lines),
# supplier -> part, and a part -> part call inside one brand.
EDGES = f"""
SELECT {_CUST} AS caller_id, {_SUPP} AS callee_id, d.edge_type AS edge_type,
       CAST(CASE WHEN d.edge_type = 'calls' THEN 0.95 ELSE 1.0 END AS DOUBLE) AS confidence
FROM (
  SELECT DISTINCT o_custkey, l_suppkey, 'consumes_api' AS edge_type FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
  UNION ALL
  SELECT DISTINCT o_custkey, l_suppkey, 'calls' AS edge_type FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
  WHERE l_returnflag = 'R'
) d
JOIN {{customer}} c ON d.o_custkey = c.c_custkey JOIN {{nation}} cn ON c.c_nationkey = cn.n_nationkey
JOIN {{supplier}} s ON d.l_suppkey = s.s_suppkey JOIN {{nation}} sn ON s.s_nationkey = sn.n_nationkey
UNION ALL
SELECT {_SUPP}, {_part_id('p')}, 'defines', CAST(1.0 AS DOUBLE)
FROM (SELECT DISTINCT l_suppkey, l_partkey FROM {{lineitem}}) d
JOIN {{supplier}} s ON d.l_suppkey = s.s_suppkey JOIN {{nation}} sn ON s.s_nationkey = sn.n_nationkey
JOIN {{part}} p ON d.l_partkey = p.p_partkey
UNION ALL
SELECT {_part_id('a')}, {_part_id('b')}, 'imports', CAST(0.98 AS DOUBLE)
FROM {{part}} a JOIN {{part}} b ON b.p_partkey = a.p_partkey - a.p_size AND b.p_brand = a.p_brand
"""

# The same rows for Spark: the lines meet their orders once, for both kinds of edge.
EDGES_ONCE = f"""
SELECT caller_id, callee_id, edge_type, CAST(CASE WHEN edge_type = 'calls' THEN 0.95 ELSE 1.0 END AS DOUBLE) AS confidence
FROM (
  SELECT {_CUST} AS caller_id, {_SUPP} AS callee_id,
         explode(CASE WHEN d.returned THEN array('consumes_api', 'calls') ELSE array('consumes_api') END) AS edge_type
  FROM (SELECT o_custkey, l_suppkey, bool_or(coalesce(l_returnflag = 'R', false)) AS returned
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey) d
  JOIN {{customer}} c ON d.o_custkey = c.c_custkey JOIN {{nation}} cn ON c.c_nationkey = cn.n_nationkey
  JOIN {{supplier}} s ON d.l_suppkey = s.s_suppkey JOIN {{nation}} sn ON s.s_nationkey = sn.n_nationkey
)
UNION ALL""" + EDGES.split("UNION ALL", 2)[2]

# --- HTTP producers and consumers ------------------------------------------
ROUTE_ENDPOINTS = """
SELECT concat('svc_', lower(n_name), ':api/supplier_', CAST(s_suppkey AS STRING), '.py:get_part:1') AS id,
       concat('svc_', lower(n_name)) AS repo, concat('/api/v1/suppliers/', CAST(s_suppkey AS STRING), '/parts/{{part_id}}') AS endpoint_route,
       'GET' AS http_method, s_suppkey * 10 AS ordinal
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL
SELECT concat('svc_', lower(n_name), ':api/supplier_', CAST(s_suppkey AS STRING), '.py:any_part:9'),
       concat('svc_', lower(n_name)), concat('/v1/suppliers/', CAST(s_suppkey AS STRING), '/:kind/<int:id>'),
       'DELETE', s_suppkey * 10 + 1
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL
SELECT concat('svc_', lower(n_name), ':api/supplier_', CAST(s_suppkey AS STRING), '.py:post_order:20'),
       concat('svc_', lower(n_name)), concat('/v1/suppliers/', CAST(s_suppkey AS STRING), '/orders'),
       CASE WHEN s_acctbal < 3000 THEN NULL ELSE 'post' END, s_suppkey * 10 + 2
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL
SELECT concat('gw_', lower(r_name), ':api/supplier_', CAST(s_suppkey AS STRING), '.py:post_order:30'),
       concat('gw_', lower(r_name)), concat('/v1/suppliers/', CAST(s_suppkey AS STRING), '/orders/'),
       'POST', s_suppkey * 10 + 3
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
WHERE s_acctbal > 6000
UNION ALL
SELECT concat('repo_', lower(n_name), ':main.py:root:1'), concat('repo_', lower(n_name)), '/', 'GET', CAST(n_nationkey AS BIGINT) - 100
FROM {nation}
"""

# One consumer per order line; a MACHINERY customer lives in the service repo.
ROUTE_CONSUMERS = """
SELECT concat(CASE WHEN c_mktsegment = 'MACHINERY' THEN 'svc_' ELSE 'web_' END, lower(n_name), ':src/order_', CAST(l_orderkey AS STRING), '.ts:line_', CAST(l_linenumber AS STRING), '_', CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING), l_returnflag, l_linestatus, ':', CAST(l_linenumber * 4 AS STRING)) AS id,
       concat(CASE WHEN c_mktsegment = 'MACHINERY' THEN 'svc_' ELSE 'web_' END, lower(n_name)) AS repo,
       CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN '/'
            WHEN l_returnflag = 'R' THEN concat('https://gw.internal/v1/suppliers/', CAST(l_suppkey AS STRING), '/orders')
            WHEN l_returnflag = 'A' THEN concat('/api/v1/suppliers/', CAST(l_suppkey AS STRING), '/orders?line=', CAST(l_linenumber AS STRING))
            ELSE concat('/v1/Suppliers/', CAST(l_suppkey AS STRING), '/parts/', CAST(l_partkey AS STRING), '/') END AS consumes_endpoint,
       CASE WHEN l_returnflag = 'R' AND l_linestatus <> 'F' THEN 'POST' WHEN l_returnflag = 'A' THEN 'PUT' WHEN l_linestatus = 'F' THEN 'PATCH' END AS consumes_http_method,
       CASE WHEN l_linestatus = 'F' AND l_linenumber < 4 THEN concat(lower(replace(n_name, '_', '-')), '.internal') END AS target_base_url,
       l_suppkey AS suppkey
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

# --- tool calls, messages, texts -------------------------------------------
TOOL_CALLS = """
SELECT user_id AS session, event_id AS seq, ts, event_type AS tool, CASE WHEN event_type = 'click' THEN '{{}}' ELSE props END AS args,
       CAST(floor(value) AS BIGINT) AS result_tokens, value AS duration_ms,
       concat('repo_', CAST(event_id % 17 AS STRING)) AS repo_ref,
       concat('repo_', CAST(event_id % 17 AS STRING), ':file_', CAST(event_id % 97 AS STRING)) AS file_ref
FROM {events}
"""

MESSAGES = "SELECT conv_id AS session, turn, role, text FROM {conversations}"

TEXT_NODES = """
SELECT CAST(doc_id AS STRING) AS id, source AS repo, concat(lang, '/doc_', CAST(doc_id AS STRING), '.md') AS file_path,
       concat('doc_', CAST(doc_id AS STRING)) AS symbol_name, 'function' AS symbol_type,
       concat(lang, ' ', source) AS signature, CAST('' AS STRING) AS docstring, text AS code_content
FROM {documents}
"""


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; its schema is read from the file footer only once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a view text over the parquet tables of ``sf_dir``."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def duck(text: str) -> str:
    """The same view for DuckDB, where the tables are registered by name."""
    return "(" + text.format(**{t: t for t in TABLES}) + ")"


# One caller per order line with an import and a call; suppliers are the targets.
IMPORT_NODES = """
SELECT concat('web_', lower(cn.n_name), ':src/o', CAST(l_orderkey AS STRING), '.ts:line_', CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING), l_returnflag, l_linestatus, ':', CAST(l_linenumber AS STRING)) AS id,
       concat('web_', lower(cn.n_name)) AS repo, 'line' AS symbol_name, 'function' AS symbol_type,
       split(CASE WHEN l_linenumber = 1 THEN concat('from requests import svc_', lower(sn.n_name))
                  WHEN l_returnflag = 'R' THEN concat('./local;svc_', lower(sn.n_name), '.supplier_', CAST(l_suppkey AS STRING))
                  WHEN l_linestatus = 'F' THEN concat('@acme/repo_SVC_', lower(sn.n_name), '/client;react')
                  ELSE concat('xsvc_', lower(sn.n_name), ';lodash') END, ';') AS file_imports,
       CASE WHEN l_returnflag = 'A' THEN concat('return SupplierClient.supplier_', CAST(l_suppkey AS STRING), '(line)')
            ELSE concat('return supplier_', CAST(l_suppkey AS STRING), '(line)') END AS code_content,
       l_orderkey * 10 + l_linenumber AS ordinal, l_suppkey AS suppkey
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} cn ON c_nationkey = cn.n_nationkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} sn ON s_nationkey = sn.n_nationkey
UNION ALL
SELECT concat('repo_svc_', lower(n_name), ':app/s', CAST(s_suppkey AS STRING), '.py:supplier_', CAST(s_suppkey AS STRING), ':1'),
       concat('repo_svc_', lower(n_name)), concat('supplier_', CAST(s_suppkey AS STRING)),
       CASE WHEN s_acctbal < 1500 THEN 'endpoint' ELSE 'class' END, split('', ';'), '', -s_suppkey - 1, s_suppkey
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
"""
