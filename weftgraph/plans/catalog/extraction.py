"""Symbol extraction on service files, order clients and web pages."""

from pyspark.sql import functions as F

from weftgraph.operators import extract as x
from weftgraph.operators.blocks import block_ends, line_brackets
from weftgraph.plans.catalog.book import Book
from weftgraph.session import materialise
from weftgraph.sources import files as f
from weftgraph.sources import views
from weftgraph.sources.code_views import (
    ORDER_SYMBOLS, code_files, expected_symbols, order_files, service_files,
)

BOOK = Book()
SHAPE = ["repo", "file_path", "symbol_name", "symbol_type", "start_line", "end_line",
         "endpoint_route", "http_method", "consumes_endpoint", "consumes_http_method", "target_base_url"]


def _symbols(spark, sf, *langs):
    return x.extract_symbols(code_files(spark, sf, *langs))


def _shaped(symbols):
    return symbols.select(*SHAPE, F.array_join("file_imports", ",").alias("imports"))


def _language_query(name, lang):
    def run(spark, sf):
        return _shaped(_symbols(spark, sf, lang))

    run.__name__ = name
    BOOK.query(f"SELECT * FROM {views.duck(expected_symbols((lang,)))}")(run)


for _name, _lang in {
    "extract_python": "python", "extract_python_fallback": "broken_python", "extract_ts_js": "ts", "extract_go": "go",
    "extract_java": "java", "extract_php": "php", "extract_rust": "rust", "extract_csharp": "csharp", "extract_ruby": "ruby",
    "extract_c_cpp": "c", "extract_clojure": "clojure", "extract_generic": "generic", "extract_script_files": "vue",
    "extract_notebooks": "notebook",
}.items():
    _language_query(_name, _lang)


@BOOK.query(f"SELECT * FROM {views.duck(expected_symbols())}")
def extract_all_languages(spark, sf):
    return _shaped(_symbols(spark, sf))


@BOOK.query(f"SELECT repo, file_path, symbol_name, symbol_type, start_line, end_line, consumes_endpoint, 'GET' AS consumes_http_method FROM {views.duck(ORDER_SYMBOLS)}")
def extract_order_clients(spark, sf):
    # two steps read the files; the lines are put together once for both
    return x.extract_symbols(materialise(order_files(spark, sf), "order-files")).select(
        "repo", "file_path", "symbol_name", "symbol_type", "start_line", "end_line", "consumes_endpoint", "consumes_http_method")


@BOOK.query(f"SELECT endpoint_route, http_method, count(*) AS symbols FROM {views.duck(expected_symbols())} WHERE symbol_type = 'endpoint' GROUP BY ALL")
def detect_endpoint(spark, sf):
    return _symbols(spark, sf).where("symbol_type = 'endpoint'").groupBy("endpoint_route", "http_method").agg(F.count(F.lit(1)).alias("symbols"))


@BOOK.query(f"SELECT consumes_endpoint, consumes_http_method, target_base_url, count(*) AS symbols FROM {views.duck(expected_symbols())} WHERE consumes_endpoint IS NOT NULL GROUP BY ALL")
def detect_consumer(spark, sf):
    return _symbols(spark, sf).where("consumes_endpoint IS NOT NULL").groupBy(
        "consumes_endpoint", "consumes_http_method", "target_base_url").agg(F.count(F.lit(1)).alias("symbols"))


@BOOK.query(f"SELECT repo, file_path, symbol_name, unnest(string_split(imports, ',')) AS import_text FROM {views.duck(expected_symbols())} WHERE imports <> ''")
def extract_imports(spark, sf):
    return _symbols(spark, sf).select("repo", "file_path", "symbol_name", F.explode("file_imports").alias("import_text"))




@BOOK.query(f"""WITH l AS (SELECT CASE regexp_extract(file_path, '[.]([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'ts' WHEN 'rs' THEN 'rust' WHEN 'cs' THEN 'csharp' WHEN 'rb' THEN 'ruby'
WHEN 'cpp' THEN 'c' WHEN 'clj' THEN 'clojure' WHEN 'kt' THEN 'generic' WHEN 'ipynb' THEN 'notebook' ELSE regexp_extract(file_path, '[.]([a-z]+)$', 1) END AS lang FROM {views.duck(service_files())})
SELECT lang, count(*) AS files FROM l GROUP BY lang""")
def language_of(spark, sf):
    return code_files(spark, sf).groupBy(f.language_of(F.col("file_path")).alias("lang")).agg(F.count(F.lit(1)).alias("files"))


@BOOK.query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
k AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:len(p) - 1] ELSE p END AS p FROM l)
SELECT CAST(doc_id AS VARCHAR) AS file_path, generate_subscripts(p, 1) AS line_no, unnest(p) AS line FROM k""")
def explode_lines(spark, sf):
    docs = views.table(spark, sf, "documents").select(
        F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content"))
    return f.explode_lines(docs).select("file_path", "line_no", "line")


def _ends_query(name, lang, where):
    def run(spark, sf):
        return _symbols(spark, sf, lang).where(where).select("repo", "file_path", "symbol_name", "start_line", "end_line")

    run.__name__ = name
    BOOK.query(f"SELECT repo, file_path, symbol_name, start_line, end_line FROM {views.duck(expected_symbols((lang,)))} WHERE {where}")(run)


_ends_query("paren_block_end", "clojure", "symbol_name LIKE 'fetch%'")
_ends_query("ruby_block_end", "ruby", "symbol_type <> 'endpoint'")
_ends_query("fixed_block_end", "php", "symbol_type = 'endpoint'")


@BOOK.query(r"""WITH h AS (SELECT page_id, string_split(html, '>') AS p FROM pages),
l AS (SELECT page_id, generate_subscripts(p, 1) AS line_no, regexp_replace(unnest(p), '//.*$', '') AS line FROM h),
b AS (SELECT *, length(line) - length(replace(line, '{', '')) - length(line) + length(replace(line, '}', '')) AS delta FROM l),
d AS (SELECT *, coalesce(CAST(sum(delta) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS depth FROM b),
c AS (SELECT page_id, line_no, unnest(list_filter(list_transform(range(1, length(line) + 1), lambda i: CASE WHEN line[i] = '}' THEN depth + length(replace(line[:i], '}', '')) * 2 - length(regexp_replace(line[:i], '[^{}]', '', 'g')) - length(regexp_replace(line[:i], '[{}]', '', 'g')) * 2 + 0 END), lambda v: v IS NOT NULL)) AS level FROM d WHERE contains(line, '}'))
SELECT d.page_id, d.line_no AS start_line, (SELECT min(c.line_no) FROM c WHERE c.page_id = d.page_id AND c.line_no >= d.line_no AND c.level = d.depth) AS block_end
FROM d WHERE contains(line, '{')""")
def brace_block_end(spark, sf):
    parts = F.split("html", ">")
    lines = views.table(spark, sf, "pages").select(
        F.lit("web").alias("repo"), F.col("page_id").cast("string").alias("file_path"), F.lit(0).alias("unit"), F.lit("ts").alias("lang"),
        F.posexplode(parts).alias("i", "line")).withColumn("line_no", F.col("i") + 1)
    starts = F.when(line_brackets(F.col("line"), F.lit("brace")).contains("{"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return block_ends(lines.withColumn("starts", starts)).select(F.col("file_path").cast("long").alias("page_id"), "start_line", "block_end")


@BOOK.query(r"""WITH s AS (SELECT page_id, regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1) AS b FROM pages)
SELECT page_id, generate_subscripts(b, 1) - 1 AS block, unnest(b) AS text FROM s""")
def extract_script_blocks(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", F.posexplode(x.script_blocks(F.col("html"))).alias("block", "b")).select(
        "page_id", "block", "b.text")


@BOOK.query(f"""SELECT file_path, concat('import os', chr(10), 'def cell', s, '(x):', chr(10), '    return x', chr(10), chr(10), 'def solo', s, '():', chr(10), '    return 2', chr(10)) AS code
FROM (SELECT file_path, regexp_extract(file_path, '_([0-9]+)', 1) AS s FROM {views.duck(service_files(('notebook',)))})""")
def extract_notebook_code(spark, sf):
    return code_files(spark, sf, "notebook").select("file_path", x.notebook_code(F.col("content")).alias("code"))


@BOOK.query(f"SELECT repo, file_path, symbol_name, concat(repo, ':', file_path, ':', symbol_name, ':', CAST(start_line AS VARCHAR)) AS id FROM {views.duck(expected_symbols(('ts',)))}")
def node_id(spark, sf):
    return _symbols(spark, sf, "ts").select("repo", "file_path", "symbol_name", "id")


@BOOK.query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
k AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:len(p) - 1] ELSE p END AS p FROM l),
e AS (SELECT doc_id, generate_subscripts(p, 1) AS line_no, p FROM k)
SELECT doc_id, line_no, regexp_extract(array_to_string(p[greatest(line_no - 3, 1):line_no], chr(10)), '([A-Z][a-z]+)', 1) AS earliest FROM e""")
def lookback_annotation(spark, sf):
    """First capitalised word in each line and the three lines above it."""
    lines = views.table(spark, sf, "documents").select("doc_id", f.split_lines(F.col("text")).alias("lines"))
    above = F.transform("lines", lambda line, i: x.look_back(F.col("lines"), i + 1, 3))
    return lines.select("doc_id", F.posexplode(above).alias("i", "above")).select(
        "doc_id", (F.col("i") + 1).alias("line_no"), F.regexp_extract("above", "([A-Z][a-z]+)", 1).alias("earliest"))


P = f"p AS (SELECT concat(repo, ':', file_path, ':') AS base, regexp_extract(file_path, '_([0-9]+)', 1) AS s FROM {views.duck(service_files(('python',)))})"


@BOOK.query(f"WITH {P} SELECT concat(base, 'SupplierStore', s, ':4') AS caller_id, concat(base, 'load_part:5') AS callee_id, 'defines' AS edge_type FROM p")
def defines_edges(spark, sf):
    return x.defines_edges(_symbols(spark, sf, "python")).select("caller_id", "callee_id", "edge_type")


@BOOK.query(f"""WITH {P} SELECT concat(base, 'SupplierStore', s, ':4') AS caller_id, concat(base, 'load_part:5') AS callee_id, 'calls' AS edge_type FROM p
UNION ALL SELECT concat(base, 'place_order_', s, ':10'), concat(base, 'load_part:5'), 'calls' FROM p
UNION ALL SELECT concat(base, 'place_order_', s, ':10'), concat(base, 'SupplierStore', s, ':4'), 'calls' FROM p""")
def intra_file_calls(spark, sf):
    return x.intra_file_calls(_symbols(spark, sf, "python")).select("caller_id", "callee_id", "edge_type")


@BOOK.query(f"WITH {P} SELECT concat(base, 'SupplierStore', s, ':4') AS id, 'Base' AS base_name FROM p")
def base_class_names(spark, sf):
    return _symbols(spark, sf, "python").select("id", F.explode("bases").alias("base_name"))
