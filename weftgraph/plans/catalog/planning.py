"""Change plans and evaluation on the symbol graph and the documents."""

from pyspark.sql import functions as F

from weftgraph.operators import change as c
from weftgraph.operators import evaluate as e
from weftgraph.operators.traverse import blast_radius
from weftgraph.plans.catalog.book import GRAPH, Book, edges, nodes
from weftgraph.plans.catalog.graph import EVERY_SUPPLIER, _recursive
from weftgraph.plans.catalog.searching import TEXTS
from weftgraph.sources import views

BOOK = Book()

# A route directive per supplier; poorer suppliers are asked for by name.
DIRECTIVES = """SELECT s_suppkey AS directive_id, CASE
WHEN s_acctbal < 3000 THEN concat('Deprecate endpoint supplier_', CAST(s_suppkey AS STRING), ' and migrate callers')
WHEN s_acctbal < 6000 THEN concat('Deprecate /v1/suppliers/', CAST(s_suppkey AS STRING))
ELSE concat('Deprecate /v1/suppliers/', CAST(s_suppkey AS STRING), ' in favour of /v2/suppliers/', CAST(s_suppkey AS STRING), ' now') END AS query, s_acctbal FROM {supplier}"""
PARSED = f"""d AS (SELECT directive_id, query, CASE WHEN s_acctbal < 3000 THEN 'supplier_' || directive_id ELSE '/v1/suppliers/' || directive_id END AS target,
CASE WHEN s_acctbal >= 6000 THEN '/v2/suppliers/' || directive_id END AS replacement FROM {views.duck(DIRECTIVES)})"""
ROOTS = f"""{PARSED}, r AS (SELECT directive_id, target, replacement, n.id AS root_id, n.repo, n.file_path, n.symbol_name, n.code_content, n.endpoint_route FROM d
JOIN nodes n ON contains(n.symbol_name, d.target) OR contains(n.endpoint_route, d.target)
QUALIFY row_number() OVER (PARTITION BY directive_id ORDER BY n.repo, n.file_path, n.start_line, n.id) = 1)"""


def directives(spark, sf):
    return views.view(spark, sf, DIRECTIVES)


@BOOK.query(f"WITH {PARSED} SELECT directive_id, target, replacement FROM d")
def parse_directive(spark, sf):
    # a name directive offers its next usable word as the replacement
    parsed = directives(spark, sf).select("directive_id", c.parse_directive(F.col("query")).alias("p")).select("directive_id", "p.*")
    return parsed


@BOOK.query(f"WITH {GRAPH}, {ROOTS} SELECT directive_id, target, root_id FROM r")
def resolve_root(spark, sf):
    parsed = directives(spark, sf).select("directive_id", c.parse_directive(F.col("query")).alias("p")).select("directive_id", "p.target")
    return c.resolve_roots(nodes(spark, sf), parsed)


HEADERS = """chr(10) || '    # the migration tool: tells callers that this endpoint ends, and when' || chr(10) || '    response.headers["Sunset"] = "Thu, 31 Dec 2026 23:59:59 GMT"' || chr(10) || '    response.headers["Deprecation"] = "true"' || chr(10)"""
NEW_PRODUCER = f"""replace(regexp_replace(code_content, '(@app\\.[a-z]+\\([^)]+)', '\\1, deprecated=True'), 'return {{', {HEADERS} || '    return {{')
|| chr(10) || chr(10) || '@app.post("/' || ltrim(coalesce(replacement, symbol_name || '_v2'), '/') || '")' || chr(10) || 'def ' || trim(replace(coalesce(replacement, symbol_name || '_v2'), '/', '_'), '_') || '(req: dict):' || chr(10)
|| '    \"\"\"Takes the place of ' || symbol_name || '.\"\"\"' || chr(10) || '    return {{"replaces": "' || symbol_name || '"}}' || chr(10)""".replace("{{", "{").replace("}}", "}")


@BOOK.query(f"WITH {GRAPH}, {PARSED} SELECT directive_id, {NEW_PRODUCER} AS new_content FROM d JOIN nodes ON symbol_name = 'supplier_' || directive_id")
def producer_rewrite(spark, sf):
    parsed = directives(spark, sf).select("directive_id", c.parse_directive(F.col("query")).alias("p"))
    return parsed.join(nodes(spark, sf), F.concat(F.lit("supplier_"), F.col("directive_id").cast("string")) == F.col("symbol_name")).select(
        "directive_id", c.producer_rewrite(F.col("code_content"), F.col("symbol_name"), F.col("p.replacement")).alias("new_content"))


@BOOK.query(f"""WITH {GRAPH} SELECT n.symbol_name, CASE WHEN contains(code_content, '/v1/suppliers/' || c_nationkey) THEN replace(code_content, '/v1/suppliers/' || c_nationkey, '/v2/suppliers/' || c_nationkey) END AS new_content
FROM nodes n JOIN customer ON n.symbol_name = 'customer_' || c_custkey
UNION ALL SELECT symbol_name, '// Now meant to call other_v2 (the migration tool)' || chr(10) || code_content FROM nodes WHERE symbol_type = 'class'
UNION ALL SELECT symbol_name, replace(code_content, symbol_name, symbol_name || '_v2') FROM nodes WHERE symbol_type = 'endpoint'""")
def consumer_rewrite(spark, sf):
    n = nodes(spark, sf)
    cust = views.table(spark, sf, "customer")
    route = F.concat(F.lit("/v1/suppliers/"), F.col("c_nationkey").cast("string"))
    none = F.lit(None).cast("string")
    one = n.join(cust, F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")) == F.col("symbol_name")).select(
        "symbol_name", c.consumer_rewrite(F.col("code_content"), F.lit("other"), route, none).alias("new_content"))
    two = n.where("symbol_type = 'class'").select(
        "symbol_name", c.consumer_rewrite(F.col("code_content"), F.lit("other"), F.lit(""), none).alias("new_content"))
    three = n.where("symbol_type = 'endpoint'").select(
        "symbol_name", c.consumer_rewrite(F.col("code_content"), F.col("symbol_name"), F.lit(""), none).alias("new_content"))
    return one.unionByName(two).unionByName(three)


@BOOK.query(f"""WITH {GRAPH} SELECT symbol_name, '--- a/' || file_path || chr(10) || '+++ b/' || file_path || chr(10) || '@@ -1 +1,2 @@' || chr(10) || '+// note' || chr(10) || ' ' || code_content AS diff, 1 AS additions, 0 AS deletions
FROM nodes WHERE symbol_type <> 'endpoint'""")
def unified_diff(spark, sf):
    n = nodes(spark, sf).where("symbol_type <> 'endpoint'").select(
        "symbol_name", c.unified_diff("file_path", "code_content", F.concat(F.lit("// note\n"), "code_content")).alias("diff"))
    return n.select("symbol_name", "diff", c.diff_stats(F.col("diff")).alias("s")).select("symbol_name", "diff", "s.*")


@BOOK.query("""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++'))) AS additions,
len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '-') AND NOT starts_with(x, '---'))) AS deletions
FROM (SELECT doc_id, replace(replace(text, '. ', chr(10) || '+'), ', ', chr(10) || '-') AS text FROM documents)""")
def diff_stats(spark, sf):
    marked = F.replace(F.replace("text", F.lit(". "), F.lit("\n+")), F.lit(", "), F.lit("\n-"))
    return views.table(spark, sf, "documents").select("doc_id", c.diff_stats(marked).alias("s")).select("doc_id", "s.*")


CHANGE = f"""WITH {GRAPH}, {ROOTS},
h1 AS (SELECT DISTINCT r.directive_id, e.caller_id AS id, 1 AS depth FROM r JOIN edges e ON e.callee_id = r.root_id),
h2 AS (SELECT DISTINCT directive_id, e.caller_id AS id, 2 AS depth FROM h1 JOIN edges e ON e.callee_id = h1.id),
up AS (SELECT directive_id, id, min(depth) AS depth FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL),
con AS (SELECT u.directive_id, n.repo, n.file_path, n.code_content, r.replacement, r.endpoint_route, r.symbol_name AS root_name FROM up u JOIN nodes n ON n.id = u.id JOIN r ON r.directive_id = u.directive_id WHERE n.repo <> r.repo
  QUALIFY row_number() OVER (PARTITION BY u.directive_id, n.repo, n.file_path ORDER BY u.depth, n.start_line, n.id) = 1),
patches AS (SELECT directive_id, 'producer' AS side, repo, file_path, md5({NEW_PRODUCER}) AS digest FROM r
UNION ALL SELECT directive_id, 'consumer', repo, file_path, md5(CASE WHEN contains(code_content, endpoint_route) THEN replace(code_content, endpoint_route, coalesce(replacement, replace(endpoint_route, 'v1', 'v2')))
  WHEN contains(code_content, root_name) THEN replace(code_content, root_name, coalesce(replacement, replace(endpoint_route, 'v1', 'v2')))
  ELSE '// Now meant to call ' || coalesce(replacement, replace(endpoint_route, 'v1', 'v2')) || ' (the migration tool)' || chr(10) || code_content END) FROM con)
"""


def _patches(spark, sf):
    return c.change_patches(nodes(spark, sf), edges(spark, sf), directives(spark, sf))


@BOOK.query(CHANGE + "SELECT * FROM patches")
def change_patches(spark, sf):
    return _patches(spark, sf).select("directive_id", "side", "repo", "file_path", F.md5("new_content").alias("digest"))


@BOOK.query(CHANGE + """SELECT p.directive_id, side, p.repo AS repo, count(*) AS files,
CASE side WHEN 'producer' THEN 'feat/deprecate-' || any_value(r.symbol_name) ELSE 'fix/migrate-to-' || any_value(r.symbol_name) || '-v2' END AS branch_name
FROM patches p JOIN r ON r.directive_id = p.directive_id GROUP BY p.directive_id, side, p.repo""")
def pull_requests(spark, sf):
    return c.pull_requests(_patches(spark, sf), nodes(spark, sf)).select("directive_id", "side", "repo", "files", "branch_name")


@BOOK.query(CHANGE + """, prs AS (SELECT DISTINCT directive_id, side, repo FROM patches), pairs AS (SELECT a.directive_id, a.repo AS x, b.repo AS y FROM prs a JOIN prs b ON a.directive_id = b.directive_id AND a.side = 'producer' AND b.side = 'consumer')
SELECT directive_id, x AS repo, y || '#migration' AS linked FROM pairs UNION ALL SELECT directive_id, y, x || '#migration' FROM pairs""")
def cross_links(spark, sf):
    return c.cross_links(c.pull_requests(_patches(spark, sf), nodes(spark, sf)))


@BOOK.query(CHANGE + "SELECT directive_id, count(DISTINCT repo) AS total_repositories, count(*) AS total_files_affected FROM patches GROUP BY directive_id")
def change_totals(spark, sf):
    return c.change_totals(c.pull_requests(_patches(spark, sf), nodes(spark, sf))).select("directive_id", "total_repositories", "total_files_affected")


# --- evaluation -------------------------------------------------------------

NEEDLES = """SELECT doc_id AS needle_id, concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2)) AS query,
concat('doc_', CAST(doc_id AS STRING)) AS expected_symbol, source AS expected_repo FROM {documents}"""


@BOOK.query(TEXTS + f""", q AS (SELECT needle_id, expected_symbol, expected_repo, regexp_replace(regexp_split_to_array(trim(query), '\\s+')[1], '[^\\p{{L}}\\p{{N}} _\\-]', '', 'g') AS word FROM {views.duck(NEEDLES)}),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(word), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS parts FROM q),
vocabulary AS (SELECT token, list(DISTINCT id) AS ids FROM tok GROUP BY token),
words AS (SELECT DISTINCT parts[1] AS prefix FROM w WHERE len(parts) = 1),
hits AS (SELECT prefix, id FROM (SELECT DISTINCT prefix, unnest(ids) AS id FROM words JOIN vocabulary ON starts_with(token, prefix)) QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY id) <= 8),
ranked AS (SELECT prefix, id, row_number() OVER (PARTITION BY prefix ORDER BY id) AS rank FROM hits)
SELECT needle_id, r.rank AS hit_rank, r.rank IS NOT NULL AS hit, true AS exact_name FROM w LEFT JOIN ranked r ON len(parts) = 1 AND r.prefix = parts[1] AND r.id = CAST(needle_id AS VARCHAR)""")
def needle_retrieval(spark, sf):
    return e.needle_retrieval(views.view(spark, sf, views.TEXT_NODES), views.view(spark, sf, NEEDLES))


# Needles without a symbol: one repository is known by its documents, the other is not.
LOST = """SELECT -1 - item_id AS needle_id, text AS query, concat('lost_', CAST(item_id AS STRING)) AS expected_symbol,
CASE WHEN length(text) > 80 THEN 'nowhere' ELSE 'src3' END AS expected_repo FROM {benchmark}"""


@BOOK.query(f"""WITH r AS (SELECT source, sum(greatest(length(text) // 4, 60)) AS t FROM documents GROUP BY source)
SELECT doc_id AS needle_id, CAST(greatest(length(text) // 4, 18) AS BIGINT) AS symbol_tokens, CAST(greatest(t, 2500) AS BIGINT) AS naive_tokens FROM documents JOIN r USING (source)
UNION ALL SELECT needle_id, NULL, CAST(greatest(coalesce(t, 0), 2500) AS BIGINT) FROM {views.duck(LOST)} LEFT JOIN r ON source = expected_repo""")
def token_accounting(spark, sf):
    needles = views.view(spark, sf, NEEDLES).unionByName(views.view(spark, sf, LOST))
    return e.token_accounting(views.view(spark, sf, views.TEXT_NODES), needles)


@BOOK.query(f"""WITH {GRAPH} SELECT repo AS expected_repo, symbol_name AS expected_symbol,
CASE WHEN len(list_filter(regexp_split_to_array(trim(docstring), ' +'), lambda x: x <> '')) < 2 THEN replace(symbol_name, '_', ' ') || ' handler function' ELSE docstring END AS query
FROM nodes QUALIFY row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN symbol_type IN ('function', 'endpoint') THEN 0 ELSE 1 END, file_path, start_line, id) = 1""")
def synthesise_needles(spark, sf):
    return e.synthesise_needles(nodes(spark, sf))


TRACES = _recursive(EVERY_SUPPLIER) + """, s AS (SELECT root, count(DISTINCT repo) AS repos_in_blast, count(DISTINCT concat(repo, ':', file_path)) AS blast_files,
count(DISTINCT CASE WHEN depth > 0 AND direction = 'upstream' THEN node_id END) AS upstream_callers FROM reach JOIN nodes ON node_id = id GROUP BY root),
every AS (SELECT * FROM s UNION ALL SELECT 'gone_' || r_regionkey, 0, 0, 0 FROM region)
"""


def _traces(spark, sf):
    n = nodes(spark, sf)
    gone = views.view(spark, sf, "SELECT concat('gone_', CAST(r_regionkey AS STRING)) AS root FROM {region}")
    roots = n.where("symbol_type = 'endpoint'").select(F.col("symbol_name").alias("root")).unionByName(gone)
    return e.trace_scores(blast_radius(n, edges(spark, sf), roots), n, roots, 2)


@BOOK.query(TRACES + "SELECT *, repos_in_blast > 1 AND blast_files >= 2 AS passed FROM every")
def trace_scores(spark, sf):
    return _traces(spark, sf)


@BOOK.query(TRACES + "SELECT count(*) FILTER (repos_in_blast > 1 AND blast_files >= 2) AS tests_passed, count(*) AS tests_total, round(avg(CAST(repos_in_blast > 1 AND blast_files >= 2 AS INT)), 6) AS score FROM every")
def evaluation_summary(spark, sf):
    return e.summary(_traces(spark, sf))


@BOOK.query(f"WITH {GRAPH} SELECT round(avg(CASE WHEN start_line > 0 AND end_line >= start_line THEN 1.0 ELSE 0.0 END) * 100, 1) AS boundary_precision_pct FROM nodes")
def boundary_precision(spark, sf):
    return e.boundary_precision(nodes(spark, sf))


@BOOK.query(f"WITH {GRAPH} SELECT caller_id, callee_id, edge_type FROM edges e JOIN nodes a ON a.id = caller_id JOIN nodes b ON b.id = callee_id WHERE a.repo <> b.repo")
def cross_repo_edges(spark, sf):
    return e.cross_repo_edges(nodes(spark, sf), edges(spark, sf)).select("caller_id", "callee_id", "edge_type")
