"""Lexical, vector and hybrid search on documents, embeddings and symbols."""

from pyspark.sql import functions as F

from weftgraph.functions.embedding import hash_embedding as embed_text
from weftgraph.operators import search as s
from weftgraph.operators.vector_index import VectorIndex
from weftgraph.plans.catalog.book import GRAPH, Book, edges, nodes
from weftgraph.sources import views

BOOK = Book()

TEXT_QUERIES = """SELECT item_id AS query_id, concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2), '!  a ', split_part(text, ' ', 3), '_', split_part(text, ' ', 4)) AS query FROM {benchmark}"""


def texts(spark, sf):
    return views.view(spark, sf, views.TEXT_NODES)


def _tokens_sql(source: str) -> str:
    return f"""f AS (SELECT id, 0 AS field, symbol_name AS body FROM {source} UNION ALL SELECT id, 1, signature FROM {source}
UNION ALL SELECT id, 2, docstring FROM {source} UNION ALL SELECT id, 3, code_content FROM {source}),
fw AS (SELECT id, field, list_filter(regexp_split_to_array(lower(body), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM f),
tok AS (SELECT id, field, generate_subscripts(words, 1) - 1 AS position, unnest(words) AS token FROM fw)"""


TEXTS = f"WITH n AS {views.duck(views.TEXT_NODES)}, {_tokens_sql('n')}"


@BOOK.query(TEXTS + "SELECT token, count(*) AS uses, count(DISTINCT id) AS nodes, CAST(sum(position) AS BIGINT) AS positions FROM tok GROUP BY token")
def token_index(spark, sf):
    return s.token_index(texts(spark, sf)).groupBy("token").agg(
        F.count(F.lit(1)).alias("uses"), F.count_distinct("id").alias("nodes"), F.sum("position").alias("positions"))


LEXICAL = TEXTS + f""", q AS {views.duck(TEXT_QUERIES)},
t1 AS (SELECT query_id, generate_subscripts(w, 1) - 1 AS term, unnest(w) AS term_text FROM (
  SELECT query_id, list_filter(regexp_split_to_array(trim(regexp_replace(query, '[^\\p{{L}}\\p{{N}} _\\-]', '', 'g')), ' +'), lambda x: length(x) > 1) AS w FROM q)),
t2 AS (SELECT *, list_filter(regexp_split_to_array(lower(term_text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS parts FROM t1),
one AS (SELECT DISTINCT query_id, id, term FROM t2 JOIN tok ON starts_with(token, parts[1]) WHERE len(parts) = 1),
two AS (SELECT DISTINCT query_id, a.id, term FROM t2 JOIN tok a ON a.token = parts[1] JOIN tok b ON b.id = a.id AND b.field = a.field AND b.position = a.position + 1 AND starts_with(b.token, parts[2]) WHERE len(parts) = 2),
hit AS (SELECT query_id, id, count(*) AS matched_terms FROM (SELECT * FROM one UNION SELECT * FROM two) GROUP BY ALL),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched_terms DESC, id) AS rank FROM hit QUALIFY rank <= 10)
"""


@BOOK.query(LEXICAL + "SELECT query_id, id, matched_terms, rank FROM lexical")
def lexical_search(spark, sf):
    return s.lexical_search(texts(spark, sf), views.view(spark, sf, TEXT_QUERIES))


LIKE_QUERIES = "SELECT r_regionkey AS query_id, concat('r#00000000', CAST(r_regionkey AS STRING)) AS query FROM {region} UNION ALL SELECT n_nationkey + 100, concat('STRUCT_', n_name) FROM {nation} UNION ALL SELECT 999, 'T_10' UNION ALL SELECT 1000, '' UNION ALL SELECT 1001, '%_%' UNION ALL SELECT 1002, 'r#0%7' UNION ALL SELECT 1003, 'no_such%thing'"


@BOOK.query(f"""WITH {GRAPH}, q AS {views.duck(LIKE_QUERIES)}
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM q JOIN nodes
ON symbol_name ILIKE '%' || query || '%' OR signature ILIKE '%' || query || '%' OR docstring ILIKE '%' || query || '%' QUALIFY rank <= 10""")
def like_search(spark, sf):
    return s.like_search(nodes(spark, sf), views.view(spark, sf, LIKE_QUERIES))


@BOOK.query(f"WITH n AS {views.duck(views.TEXT_NODES)} SELECT id, md5(concat(symbol_name, ' ', signature, ' ', docstring, chr(10), code_content)) AS digest FROM n")
def searchable_text(spark, sf):
    return texts(spark, sf).select("id", F.md5(s.searchable_text()).alias("digest"))


DIMS = 64
EMBED = f"""ch AS (SELECT id, unnest(range(1, length(body) + 1)) AS p, body FROM src),
cnt AS (SELECT id, (unicode(substring(body, p, 1)) * p) % {DIMS} AS bucket, count(*) AS n FROM ch GROUP BY ALL),
emb AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight FROM cnt)
"""


@BOOK.query(f"""WITH src AS (SELECT item_id AS id, text AS body FROM benchmark UNION ALL SELECT 1000000 + conv_id * 100 + turn, text FROM conversations), {EMBED}
SELECT id, bucket, round(weight, 6) AS weight FROM emb""")
def hash_embedding(spark, sf):
    both = views.view(spark, sf, "SELECT item_id AS id, text AS body FROM {benchmark} UNION ALL SELECT 1000000 + conv_id * 100 + turn, text FROM {conversations}")
    exploded = both.select("id", F.posexplode(embed_text(F.col("body"), DIMS)).alias("bucket", "weight"))
    return exploded.where("weight > 0").select("id", F.col("bucket").cast("long").alias("bucket"), F.round("weight", 6).alias("weight"))


def vectors(spark, sf):
    return views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("repo"), "embedding")


COSINE = "list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
FIRSTS = "q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label)"


@BOOK.query(f"SELECT v.vec_id AS id, v.label AS repo, round({COSINE}, 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {COSINE} DESC, id LIMIT 5")
def cosine_topk(spark, sf):
    v = vectors(spark, sf)
    wanted = v.where("id = 7").select("embedding").scalar()
    return s.cosine_topk(v, wanted).withColumn("score", F.round("score", 6))


@BOOK.query(f"WITH {FIRSTS} SELECT query_id, v.vec_id AS id, v.label AS repo, round({COSINE}, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY {COSINE} DESC, v.vec_id) AS rank FROM embeddings v, q QUALIFY rank <= 5")
def cosine_topk_batch(spark, sf):
    v = vectors(spark, sf)
    q = v.groupBy(F.col("repo").alias("query_id")).agg(F.min_by("embedding", "id").alias("embedding"))
    return s.cosine_topk_batch(v, q).withColumn("score", F.round("score", 6))


@BOOK.query(f"WITH {FIRSTS} SELECT query_id, v.vec_id AS id, v.label AS repo, round({COSINE}, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY {COSINE} DESC, v.vec_id) AS rank FROM embeddings v, q WHERE v.label = (q.query_id + 1) % 10 QUALIFY rank <= 5")
def filtered_knn(spark, sf):
    v = vectors(spark, sf)
    q = v.groupBy(F.col("repo").alias("query_id")).agg(F.min_by("embedding", "id").alias("embedding")).withColumn(
        "repo", (F.col("query_id") + 1) % 10)
    return s.cosine_topk_batch(v, q).withColumn("score", F.round("score", 6))


@BOOK.query(f"WITH {FIRSTS} SELECT query_id, v.vec_id AS id, v.label AS repo, round({COSINE}, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY {COSINE} DESC, v.vec_id) AS rank FROM embeddings v, q QUALIFY rank <= 5")
def indexed_topk(spark, sf):
    """The index probes until its rows are certain, so they are those of a full scan."""
    v = vectors(spark, sf)
    q = v.groupBy(F.col("repo").alias("query_id")).agg(F.min_by("embedding", "id").alias("embedding"))
    return VectorIndex.store(v, cells=16).search(q, certain=True).withColumn("score", F.round("score", 6))


@BOOK.query("SELECT count(*) AS queries, count(*) * 5 AS rows_found, true AS recall_reached FROM embeddings WHERE vec_id % 10 = 0")
def index_recall(spark, sf):
    """Every tenth vector asked of 12 cells of 16 (these vectors hardly cluster): all queries have all rows, and of those of a full scan 0.9 or more."""
    v = vectors(spark, sf)
    q = v.where("id % 10 = 0").select(F.col("id").alias("query_id"), "embedding")
    found = VectorIndex.store(v, cells=16).search(q, probes=12)
    right = found.join(s.cosine_topk_batch(v, q).select("query_id", "id", F.lit(1).alias("right")), ["query_id", "id"], "left")
    return right.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("rows_found"),
                     (F.count("right") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))


@BOOK.query()
def approximate_topk(spark, sf):
    v = vectors(spark, sf)
    wanted = v.where("id = 7").select("embedding").first()["embedding"]
    return s.approximate_topk(v, list(wanted)).withColumn("score", F.round("score", 6))


QUERY = "the and for"
HYBRID = f"""WITH n AS {views.duck(views.TEXT_NODES)},
src AS (SELECT id, concat(symbol_name, ' ', signature, ' ', docstring, chr(10), code_content) AS body FROM n WHERE signature LIKE 'en %' UNION ALL SELECT '?', '{QUERY}'),
{EMBED}, qv AS (SELECT bucket, weight FROM emb WHERE id = '?'),
sim AS (SELECT e.id, coalesce(sum(e.weight * qv.weight), 0) AS d FROM emb e LEFT JOIN qv USING (bucket) WHERE e.id <> '?' GROUP BY e.id),
m AS (SELECT id, repo, CAST(contains(t, 'the') AS INT) + CAST(contains(t, 'and') AS INT) + CAST(contains(t, 'for') AS INT) AS matched
  FROM (SELECT id, repo, lower(concat(symbol_name, ' ', signature, ' ', docstring, chr(10), code_content)) AS t FROM n)),
scored AS (SELECT id, repo, CASE WHEN d IS NOT NULL THEN d + CASE WHEN matched > 0 THEN 0.3 ELSE 0 END ELSE 0.15 * matched END AS score FROM m LEFT JOIN sim USING (id) WHERE d IS NOT NULL OR matched > 0)
"""


def _english_vectors(spark, sf):
    return s.embed_batch(texts(spark, sf).where(F.col("signature").startswith("en ")), dimensions=DIMS)


@BOOK.query(HYBRID + "SELECT id, repo, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, id LIMIT 50")
def hybrid_search(spark, sf):
    return s.hybrid_search(texts(spark, sf), _english_vectors(spark, sf), QUERY, 50, dimensions=DIMS).withColumn("score", F.round("score", 6))


@BOOK.query(HYBRID + "SELECT id, 'hybrid' AS how FROM scored WHERE repo = 'src3' ORDER BY scored.score DESC, id LIMIT 5")
def semantic_search(spark, sf):
    return s.semantic_search(texts(spark, sf), _english_vectors(spark, sf), QUERY, 5, "src3", dimensions=DIMS)


@BOOK.query(f"WITH n AS {views.duck(views.TEXT_NODES)} SELECT id, 'lexical' AS how FROM n WHERE signature ILIKE '%s_c3%' OR symbol_name ILIKE '%s_c3%' ORDER BY id LIMIT 5")
def semantic_search_fallback(spark, sf):
    """No vectors and no word: the query is found as a LIKE needle only."""
    return s.semantic_search(texts(spark, sf), _english_vectors(spark, sf).where("false"), "s_c3", 5, dimensions=DIMS)


@BOOK.query(f"""WITH src AS (SELECT id, concat(symbol_name, ' ', signature, ' ', docstring, chr(10), code_content) AS body FROM {views.duck(views.TEXT_NODES)}), {EMBED}
SELECT id, count(*) AS buckets, round(max(weight), 6) AS top FROM emb GROUP BY id""")
def embed_batch(spark, sf):
    e = s.embed_batch(texts(spark, sf), dimensions=DIMS)
    return e.select("id", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("buckets"), F.round(F.array_max("embedding"), 6).alias("top"))


@BOOK.query(f"WITH {GRAPH} SELECT id, symbol_type FROM nodes WHERE symbol_type IN ('endpoint', 'class', 'function')")
def eligible_for_embedding(spark, sf):
    return s.eligible_for_embedding(nodes(spark, sf)).select("id", "symbol_type")


NAME_QUERIES = "SELECT s_suppkey AS query_id, CASE WHEN s_acctbal < 5000 THEN concat('supplier_', CAST(s_suppkey AS STRING)) ELSE s_name END AS query FROM {supplier}"


@BOOK.query(f"""WITH {GRAPH}, q AS {views.duck(NAME_QUERIES)},
exact AS (SELECT query_id, id, 'exact' AS how FROM q JOIN nodes ON symbol_name = query),
rest AS (SELECT query_id, lower(replace(query, '#', '')) AS word FROM q WHERE query NOT IN (SELECT symbol_name FROM nodes)),
n3 AS (SELECT id, lower(symbol_name || ' ' || signature || ' ' || docstring) AS t FROM nodes),
lex AS (SELECT query_id, id, 'lexical' AS how FROM rest JOIN n3 ON list_contains(regexp_split_to_array(t, '[^a-z0-9]+'), word) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 3),
lik AS (SELECT query_id, id, 'lexical' AS how FROM (SELECT query_id, lower(query) AS needle FROM q WHERE query_id IN (SELECT query_id FROM rest) AND query_id NOT IN (SELECT query_id FROM lex)) JOIN n3 ON contains(t, needle) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 3)
SELECT * FROM exact UNION ALL SELECT * FROM lex UNION ALL SELECT * FROM lik""")
def symbol_definition(spark, sf):
    return s.symbol_definition(nodes(spark, sf), views.view(spark, sf, NAME_QUERIES))


@BOOK.query(f"""WITH {GRAPH} SELECT symbol_name, concat('### [', repo, '] ', file_path, ' (Lines ', CAST(start_line AS VARCHAR), '-', CAST(end_line AS VARCHAR), ')', chr(10), '**Symbol**: `', symbol_name, '` (', symbol_type, ')', chr(10),
'**Signature**: `', signature, '`', chr(10), '```python', chr(10), CASE WHEN code_content <> '' THEN code_content ELSE signature END, chr(10), '```', chr(10)) AS snippet FROM nodes""")
def node_snippets(spark, sf):
    return nodes(spark, sf).select("symbol_name", s.node_snippet().alias("snippet"))


@BOOK.query(f"WITH {GRAPH} SELECT concat('- `', caller_id, '` --[', edge_type, ']--> `', callee_id, '`') AS line FROM edges")
def edge_lines(spark, sf):
    return edges(spark, sf).select(s.edge_line().alias("line"))


@BOOK.query(LEXICAL + f""", d AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang, source FROM documents)
SELECT query_id, md5('## Retrieved Code Context (' || count(*) || ' symbols):' || chr(10) || string_agg('### [' || source || '] ' || lang || '/doc_' || id || '.md (Lines 1-1)' || chr(10) || '**Symbol**: `doc_' || id || '` (function)' || chr(10)
|| '**Signature**: `' || lang || ' ' || source || '`' || chr(10) || '```python' || chr(10) || lang || ' ' || source || chr(10) || '```' || chr(10), chr(10) ORDER BY rank)) AS digest FROM lexical JOIN d USING (id) GROUP BY query_id""")
def context_text(spark, sf):
    n = texts(spark, sf)
    hits = s.lexical_search(n, views.view(spark, sf, TEXT_QUERIES))
    brief = n.withColumns({"start_line": F.lit(1), "end_line": F.lit(1), "code_content": F.lit("")})
    return s.context_text(hits, brief).select("query_id", F.md5("context").alias("digest"))
