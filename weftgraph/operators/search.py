"""Lexical, vector and hybrid search over a node table."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from weftgraph.functions.embedding import cosine, dot, hash_vector
from weftgraph.operators.row_search import best_rows
from weftgraph.operators.scale import lookup_join, top_rows
from weftgraph.operators.substring import contains_join, literal_runs
from weftgraph.session import materialise

TEXT_FIELDS = ("symbol_name", "signature", "docstring", "code_content")
WORD_BREAK = r"[^\p{L}\p{N}]+"
QUERIES_PER_BLOCK = 2048
VECTORS_PER_BLOCK = 16_384


def searchable_text() -> Column:
    """Name, signature and docstring on one line, then the code."""
    parts = [F.coalesce(c, F.lit("")) for c in TEXT_FIELDS]
    return F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2], F.lit("\n"), parts[3])


# --- lexical ----------------------------------------------------------------

def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda x: x != "")


def token_index(nodes: DataFrame, fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """``(id, field, position, token)``: the inverted index as a table.

    Build it once and store it sorted by token when many searches follow.
    """
    per_field = nodes.select("id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("field"), _words(F.coalesce(name, F.lit(""))).alias("words")) for i, name in enumerate(fields)
    ])).alias("f"))
    return per_field.select("id", "f.field", F.posexplode("f.words").alias("position", "token"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``queries(query_id, query)`` → one row per part of each search term.

    A term with ``_`` or ``-`` is a phrase of its parts; the last part of a
    term is a prefix. One-letter terms are dropped, unless nothing is left.
    """
    safe = F.trim(F.regexp_replace("query", r"[^\p{L}\p{N} _\-]", ""))
    terms = F.filter(F.split(safe, " +"), lambda x: F.length(x) > 1)
    terms = F.when(F.size(terms) > 0, terms).otherwise(F.array(safe))
    numbered = queries.select("query_id", F.posexplode(terms).alias("term", "text"))
    parts = numbered.select("query_id", "term", _words(F.col("text")).alias("parts")).where(F.size("parts") > 0)
    return parts.select("query_id", "term", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("part", "word"))


class Texts:
    """Nodes to be searched without an index, for the best ``limit`` rows of each query."""

    def __init__(self, nodes: DataFrame, limit: int):
        self.nodes, self.limit = nodes, limit

    def matches(self, queries: DataFrame) -> DataFrame:
        """``lexical_matches`` of ``queries(query_id, query)``, whose ``query_id`` is a number; at least the best rows are there."""
        again = materialise(self.nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "again")
        several = materialise(queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("query_id"), "several")
        single, whole, found = queries.join(several, "query_id", "left_anti"), self.nodes, []
        if not again.isEmpty():
            same = self.nodes.id.eqNullSafe(again.id)
            whole = self.nodes.join(again, same, "left_anti")
            found.append(lexical_matches(token_index(self.nodes.join(again, same, "left_semi")), single))
        if not several.isEmpty():
            found.append(lexical_matches(token_index(self.nodes), queries.join(several, "query_id", "left_semi")))
        words = {f"words_{i}": F.split(F.lower(F.coalesce(name, F.lit(""))), WORD_BREAK) for i, name in enumerate(TEXT_FIELDS)}
        return reduce(DataFrame.unionByName, found, best_rows(whole, words, materialise(query_terms(single), "terms"), self.limit))


def lexical_matches(index: DataFrame | Texts, queries: DataFrame) -> DataFrame:
    """``(query_id, id, matched_terms)``: nodes that match any term.

    Texts without an index are read row by row. In an index, prefix matching is an equi-join: each token is looked up whole (cut 0) and
    under every prefix length that occurs among the queries.
    """
    if isinstance(index, Texts):
        return index.matches(queries)
    last = F.col("part") == F.col("n_parts") - 1
    probes = materialise(query_terms(queries).withColumn("cut", F.when(last, F.length("word")).otherwise(0)), "terms")
    cuts = probes.select(F.collect_set("cut")).scalar()
    keyed = index.select("id", "field", "position", "token", F.explode(cuts).alias("cut")).where(
        F.col("cut") <= F.length("token")).select(
        "id", "field", "position", "cut",
        F.when(F.col("cut") == 0, F.col("token")).otherwise(F.left("token", F.col("cut"))).alias("word"))
    hits = lookup_join(keyed, probes, ["cut", "word"], "inner", ["id", "position"])
    # a phrase is met when all its parts line up on one start position
    phrase = F.col("n_parts") > 1
    lined = hits.groupBy(
        "query_id", "id", "term", "n_parts", F.when(phrase, F.col("field")).alias("field"),
        F.when(phrase, F.col("position") - F.col("part")).alias("anchor")).agg(F.count(F.lit(1)).alias("n"))
    met = lined.where(~phrase | (F.col("n") == F.col("n_parts")))
    return met.groupBy("query_id", "id").agg(F.size(F.collect_set("term")).alias("matched_terms"))


def _in_repo(found: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (query_id, id, …) whose node lies in the query's ``repo``, where it has one."""
    if "repo" not in queries.columns:
        return found
    wanted = queries.select("query_id", F.col("repo").alias("_repo"))
    return found.join(wanted, "query_id").join(nodes.select("id", F.col("repo").alias("_r")), "id").where(
        F.col("_repo").isNull() | (F.col("_repo") == F.col("_r"))).drop("_repo", "_r")


def lexical_search(nodes: DataFrame, queries: DataFrame, limit: int = 10, index: DataFrame | None = None) -> DataFrame:
    """Best nodes per query: most matched terms first, then id.

    ``queries`` may carry a ``repo`` column that restricts the result. What many
    queries ask alike is searched once, and each of them gets its best rows.
    Without a stored index, texts are read row by row and only a task's best
    rows leave it; ids that come more than once are met over all their rows.
    """
    wanted = [c for c in ("query", "repo") if c in queries.columns]
    asked = queries.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*wanted))).alias("asked"))
    if "repo" in wanted:
        asked = asked.where("query_id IS NOT NULL")
    # written with its numbers, so that every later use sees the same ones
    once = materialise(asked.select("asked").distinct().withColumn("ask", F.monotonically_increasing_id()), "asked")
    single = once.select(F.col("ask").alias("query_id"), F.explode("asked").alias("a")).select("query_id", "a.*")
    if index is None:
        index = token_index(nodes) if "repo" in wanted else Texts(nodes, limit)
    found = _in_repo(lexical_matches(index, single), nodes, single)
    best = top_rows(found, ["query_id"], [F.desc("matched_terms"), F.col("id")], limit).withColumnRenamed("query_id", "ask")
    numbered = lookup_join(asked, once, ["asked"], "inner", ["query_id"]).select("query_id", "ask")
    return lookup_join(numbered, best, ["ask"], "inner", ["query_id"]).select("query_id", "id", "matched_terms", "rank")


def like_search(nodes: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Substring search on name, signature and docstring, ASCII case folded.

    ``_`` in a query stands for any character and ``%`` for any run of them, so
    an empty query finds every node. ``queries`` may carry a ``repo``.
    """
    def fold(text: Column) -> Column:
        return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    asked = queries.select("query_id", fold(F.col("query")).alias("needle")).where("needle IS NOT NULL")
    texts = nodes.select("id", F.posexplode(F.array(*TEXT_FIELDS[:3])).alias("field", "text")).where("text IS NOT NULL").select(
        F.struct("id", "field").alias("text_id"), fold(F.col("text")).alias("text"))
    pairs = contains_join(texts, asked, wildcards=True)
    found = asked.join(pairs, "needle").select("query_id", F.col("text_id.id").alias("id")).distinct()
    # without a literal, a query asks for nothing but a length: the best rows of each length and repository answer it
    bare = asked.where(F.size(literal_runs(F.col("needle"))) == 0).select(
        "query_id", F.length(F.replace("needle", F.lit("%"))).alias("least"))
    lengths = bare.select(F.collect_set("least")).scalar()
    longest = F.greatest(F.lit(-1), *[F.length(c) for c in TEXT_FIELDS[:3]])
    open_to = nodes.select("id", "repo", longest.alias("longest"), F.explode(lengths).alias("least")).where("least <= longest").drop("longest")
    best = top_rows(open_to, ["least", "repo"], [F.col("id")], limit).drop("rank")
    found = found.unionByName(bare.join(best, "least").select("query_id", "id"))
    return top_rows(_in_repo(found, nodes, queries), ["query_id"], [F.col("id")], limit)


def lexical_or_like(nodes: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Lexical search; a query without any hit falls back to substrings."""
    lexical = materialise(lexical_search(nodes, queries, limit), "lexical")
    rest = queries.join(lexical.select("query_id").distinct(), "query_id", "left_anti")
    return lexical.select("query_id", "id", "rank").unionByName(like_search(nodes, rest, limit).select("query_id", "id", "rank"))


def symbol_definition(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact name matches per query, else the lexical top three."""
    exact = queries.join(nodes.select("id", F.col("symbol_name").alias("query")), "query").select(
        "query_id", "id", F.lit("exact").alias("how"))
    rest = queries.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    return exact.unionByName(lexical_or_like(nodes, rest, 3).select("query_id", "id", F.lit("lexical").alias("how")))


# --- vectors ----------------------------------------------------------------

def eligible_for_embedding(nodes: DataFrame, first: int | None = None) -> DataFrame:
    """Endpoints, classes and functions; optionally only the first ``first``."""
    kept = nodes.where(F.col("symbol_type").isin("endpoint", "class", "function"))
    return kept if first is None else kept.orderBy("ordinal").limit(first)


def embed_batch(nodes: DataFrame, embed=None, dimensions: int = 1024) -> DataFrame:
    """``(id, embedding)`` of the eligible nodes. ``embed`` maps a text column
    to a vector column, such as a user's pandas UDF around a model."""
    from weftgraph.functions.embedding import hash_embedding

    text = searchable_text()
    vector = embed(text) if embed else hash_embedding(text, dimensions)
    return eligible_for_embedding(nodes).select("id", vector.alias("embedding"))


def cosine_topk(vectors: DataFrame, query_vector: Column, limit: int = 5, repo: str | None = None) -> DataFrame:
    """Best rows for one query vector: a scored scan and a top-k, no shuffle."""
    scope = vectors if repo is None else vectors.where(F.col("repo") == repo)
    scored = scope.select("id", "repo", "embedding", query_vector.alias("_query")).select(
        "id", "repo", cosine(F.col("embedding"), F.col("_query")).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def cosine_topk_batch(vectors: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """Best rows for each query vector.

    Queries and vectors are dealt into blocks of bounded size, and every pair
    of blocks is scored in one task by a matrix product that emits at most
    ``limit`` rows per query; the best of them are merged per query. A query
    with a ``repo`` only sees that repository.
    """
    spark = vectors.sparkSession
    query_blocks = -(-queries.count() // QUERIES_PER_BLOCK) or 1
    vector_blocks = -(-vectors.count() // VECTORS_PER_BLOCK) or 1
    # small inputs are still spread over the cores
    vector_blocks = max(vector_blocks, spark.sparkContext.defaultParallelism)
    scoped = "repo" in queries.columns
    # names of their own: queries may be rows of the vectors, and share columns with them
    cols = [F.col("query_id").alias("asked_id"), F.col("embedding").alias("wanted")] + ([F.col("repo").alias("scope")] if scoped else [])

    def unit(m: np.ndarray) -> np.ndarray:
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

    def lengths(column: pd.Series) -> np.ndarray:
        return column.map(lambda v: 0 if v is None else len(v)).to_numpy(dtype=int)

    def score(asked: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or batch.empty:  # a block without rows on one side has no columns there
            return pd.DataFrame()
        scores = np.zeros((len(asked), len(batch)))
        want, have = lengths(asked["wanted"]), lengths(batch["embedding"])
        for d in set(want[want > 0]) & set(have):
            at, mine = np.flatnonzero(want == d), np.flatnonzero(have == d)
            left, right = (unit(np.stack([np.asarray(v, dtype=float) for v in x.iloc[i]])) for x, i in ((asked["wanted"], at), (batch["embedding"], mine)))
            scores[np.ix_(at, mine)] = left @ right.T
        scopes = asked["scope"].tolist() if scoped else [None] * len(asked)
        # rows in the order of ids, so that a stable sort by score breaks ties by id
        order = np.argsort(batch["id"].to_numpy(), kind="stable")
        repos, found = batch["repo"].to_numpy()[order], []
        for i, (query, scope) in enumerate(zip(asked["asked_id"], scopes)):
            mine = order if pd.isna(scope) else order[repos == scope]
            mine = mine[np.argsort(-scores[i][mine], kind="stable")[:limit]]
            found.append(batch.iloc[mine][["id", "repo"]].assign(query_id=query, score=scores[i][mine]))
        return pd.concat(found)[["query_id", "id", "repo", "score"]] if found else pd.DataFrame(columns=["query_id", "id", "repo", "score"])

    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), vectors.schema["id"],
                           vectors.schema["repo"], T.StructField("score", T.DoubleType())])
    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    asked = queries.select(*cols, dealt("query_id", query_blocks).alias("_q"), every(vector_blocks).alias("_v"))
    stored = vectors.select("id", "repo", "embedding", every(query_blocks).alias("_q"), dealt("id", vector_blocks).alias("_v"))
    local = asked.groupBy("_q", "_v").cogroup(stored.groupBy("_q", "_v")).applyInPandas(
        lambda a, b: score(a.reset_index(drop=True), b.reset_index(drop=True)), schema)
    return top_rows(local, ["query_id"], [F.desc("score"), F.col("id")], limit)


def approximate_topk(vectors: DataFrame, query_vector: list[float], limit: int = 5, bucket_length: float = 1.0,
                     tables: int = 8, candidates: int = 128, seed: int = 7) -> DataFrame:
    """Approximate neighbours by random projections, re-ranked by cosine."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    size = norm_of(query_vector)
    key = Vectors.dense([x / size for x in query_vector])
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    unit = vectors.where(F.size("embedding") == len(query_vector)).where(length > 0).select(
        "id", "repo", "embedding", array_to_vector(F.transform("embedding", lambda v: v.cast("double") / length)).alias("unit"))
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=bucket_length,
                                        numHashTables=tables, seed=seed).fit(unit)
    near = model.approxNearestNeighbors(unit, key, candidates)
    return cosine_topk(near.select("id", "repo", "embedding"), F.lit([float(x) for x in query_vector]), limit)


def norm_of(vector: list[float]) -> float:
    return float(np.sqrt(np.square(np.asarray(vector, dtype=float)).sum())) or 1.0


def hybrid_search(nodes: DataFrame, vectors: DataFrame, query: str, limit: int = 5, repo: str | None = None,
                  query_vector: list[float] | None = None, dimensions: int = 1024) -> DataFrame:
    """Dot product plus 0.3 when any query word occurs in the text; a node
    without a vector scores 0.15 per matched word and needs at least one."""
    if query_vector is None:
        query_vector = hash_vector(query, dimensions).tolist()
    words = query.lower().split()
    scope = nodes if repo is None else nodes.where(F.col("repo") == repo)
    text = F.lower(searchable_text())
    matched = F.lit(0)
    for word in words:
        matched = matched + F.when(F.col("_text").contains(word), 1).otherwise(0)
    scored = scope.select("id", "repo", text.alias("_text")).select("id", "repo", matched.alias("matched")).join(
        vectors.select("id", "embedding"), "id", "left")
    similarity = dot(F.col("embedding"), F.lit([float(x) for x in query_vector]))
    has_vector = F.col("embedding").isNotNull()
    score = F.when(has_vector, similarity + F.when(F.col("matched") > 0, 0.3).otherwise(0.0)).otherwise(0.15 * F.col("matched"))
    return scored.where(has_vector | (F.col("matched") > 0)).select("id", "repo", score.alias("score")).orderBy(
        F.desc("score"), "id").limit(limit)


def semantic_search(nodes: DataFrame, vectors: DataFrame, query: str, limit: int = 5, repo: str | None = None,
                    dimensions: int = 1024) -> DataFrame:
    """Hybrid search; where it finds nothing, lexical search and then substrings."""
    hybrid = materialise(hybrid_search(nodes, vectors, query, limit, repo, dimensions=dimensions), "hybrid")
    if not hybrid.isEmpty():
        return hybrid.select("id", F.lit("hybrid").alias("how"))
    spark = nodes.sparkSession
    asked = spark.createDataFrame([(0, query, repo)], "query_id int, query string, repo string")
    return lexical_or_like(nodes, asked, limit).select("id", F.lit("lexical").alias("how"))


# --- context text -----------------------------------------------------------

def node_snippet() -> Column:
    """A node as a Markdown section."""
    body = F.coalesce(F.nullif("code_content", F.lit("")), "signature")
    return F.concat(
        F.lit("### ["), "repo", F.lit("] "), "file_path", F.lit(" (Lines "), F.col("start_line").cast("string"), F.lit("-"),
        F.col("end_line").cast("string"), F.lit(")\n**Symbol**: `"), "symbol_name", F.lit("` ("), "symbol_type",
        F.lit(")\n**Signature**: `"), "signature", F.lit("`\n```python\n"), body, F.lit("\n```\n"))


def edge_line() -> Column:
    return F.concat(F.lit("- `"), "caller_id", F.lit("` --["), "edge_type", F.lit("]--> `"), "callee_id", F.lit("`"))


def context_text(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """One context text per query from its ranked result rows, which are at
    most the search limit per query."""
    placed = results.select("query_id", "rank", "id").join(nodes, "id").select("query_id", "rank", node_snippet().alias("snippet"))
    listed = F.sort_array(F.collect_list(F.struct("rank", "snippet")))
    return placed.groupBy("query_id").agg(F.concat(
        F.lit("## Retrieved Code Context ("), F.count(F.lit(1)).cast("string"), F.lit(" symbols):\n"),
        F.array_join(F.transform(listed, lambda x: x["snippet"]), "\n")).alias("context"))
