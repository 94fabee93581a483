"""An inverted-file index of vectors: cells around trained centroids, probed from the nearest on.

Vectors are stored by cell and stay where they are. Queries go to them in
blocks of bounded size; every batch of stored rows answers with its best rows
for each query that probes its cell, and only these are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from weftgraph.operators.scale import top_rows
from weftgraph.operators.search import QUERIES_PER_BLOCK
from weftgraph.session import materialise, scratch_path, shuffles_freed

#: The cell of vectors that are null, of other sizes or without length; their cosine is 0.
NO_CELL = -1


def _units(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a direction, and their vectors of length 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), size), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = pc.fill_null(column.filter(fits).flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False).reshape(-1, size)
    length = np.sqrt((flat * flat).sum(axis=1))
    return rows[length > 0], flat[length > 0] / length[length > 0, None]


def _stored_schema(rows: T.StructType) -> T.StructType:
    return T.StructType([*rows.fields, T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType())])


class VectorIndex:
    """Stored cells; ``centroids`` are of length 1, and ``facts`` has (cell, rows, nearness): how
    many rows a cell has and the cosine of its farthest one to the centroid. Both are bounded by the number of cells."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/facts").orderBy("cell").collect()
        self.cells = np.array([r.cell for r in rows if r.cell != NO_CELL], dtype=np.int64)
        self.centroids = np.array([r.centroid for r in rows if r.cell != NO_CELL], dtype=float)
        self.rows = np.array([r.rows for r in rows if r.cell != NO_CELL], dtype=np.int64)
        self.nearness = np.array([r.nearness for r in rows if r.cell != NO_CELL], dtype=float)
        self.others = any(r.cell == NO_CELL for r in rows)
        self.stored = spark.read.schema(_stored_schema(spark.read.parquet(f"{path}/columns").schema)).parquet(f"{path}/cells")

    @classmethod
    def store(cls, vectors: DataFrame, path: str | None = None, cells: int = 64, sample: int = 100_000, seed: int = 7) -> VectorIndex:
        """Index ``vectors(id, repo, embedding)`` below ``path``. Centroids are fitted on at most ``sample`` rows,
        those with the smallest hash of their id; every row is stored."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = vectors.sparkSession
        path = path or scratch_path(spark, "vector-index")
        rows = vectors.select("id", "repo", "embedding")
        size = rows.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
        size = size.n if size else 1
        double = F.transform("embedding", lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
        length = F.sqrt(F.aggregate(double, F.lit(0.0), lambda a, v: a + v * v))
        fit = rows.where(F.size("embedding") == size).withColumn("length", length).where("length > 0").orderBy(F.xxhash64("id")).limit(sample)
        fit = materialise(fit.select(array_to_vector(F.transform(double, lambda v: v / F.col("length"))).alias("features")), "fit")
        k = max(min(cells, fit.count()), 1)
        found = np.zeros((1, size))
        found[0, 0] = 1
        if k > 1:
            found = np.array(KMeans(k=k, seed=seed, maxIter=10, distanceMeasure="cosine").fit(fit).clusterCenters())
        centroids = found / np.maximum(np.sqrt((found * found).sum(axis=1)), 1e-12)[:, None]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                some, units = _units(batch.column("embedding"), size)
                cell, near = np.full(batch.num_rows, NO_CELL, dtype=np.int32), np.zeros(batch.num_rows)
                cosines = units @ centroids.T
                cell[some] = cosines.argmax(axis=1)
                near[some] = cosines.max(axis=1) if len(some) else 0
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(near)], [*batch.schema.names, "cell", "near"])

        schema = _stored_schema(rows.schema)
        rows.limit(0).write.mode("overwrite").parquet(f"{path}/columns")
        with shuffles_freed(spark):
            rows.mapInArrow(assign, schema).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
        stored = spark.read.schema(schema).parquet(f"{path}/cells")
        named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        facts = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.min("near").alias("nearness"))
        facts.join(F.broadcast(named), "cell", "left").write.mode("overwrite").parquet(f"{path}/facts")
        return cls(spark, path)

    def search(self, queries: DataFrame, limit: int = 5, probes: int = 8, certain: bool = False) -> DataFrame:
        """(query_id, id, repo, score, rank): the best rows of each of ``queries(query_id, embedding[, repo])`` by cosine, then id.

        A query probes its ``probes`` nearest cells and goes on until these hold
        ``limit`` rows. A query with a ``repo`` that finds fewer there probes
        all cells. With ``certain`` it also probes every cell that may hold a
        row as good as the last one found, so the result is exact: a row's angle
        to the query is no smaller than the centroid's less the cell's widest.
        """
        scoped = "repo" in queries.columns
        columns = ["query_id", "embedding"] + (["repo"] if scoped else [])
        block: list[tuple] = []
        parts = []
        for row in queries.select(*columns).toLocalIterator(prefetchPartitions=False):
            block.append(tuple(row))
            if len(block) == QUERIES_PER_BLOCK:
                parts.append(materialise(self._block(block, scoped, queries.schema["query_id"], limit, probes, certain), "block"))
                block = []
        if block or not parts:
            parts.append(self._block(block, scoped, queries.schema["query_id"], limit, probes, certain))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _block(self, block: list[tuple], scoped: bool, key: T.StructField, limit: int, probes: int, certain: bool) -> DataFrame:
        size = self.centroids.shape[1] if len(self.centroids) else 1
        asked = np.zeros((len(block), size))
        for i, row in enumerate(block):
            v = np.array([0.0 if x is None else x for x in row[1] or ()], dtype=float)
            if len(v) == size and (n := np.sqrt((v * v).sum())) > 0:
                asked[i] = v / n
        scopes = [row[2] if scoped else None for row in block]
        cosines = asked @ self.centroids.T if len(self.cells) else np.zeros((len(block), 0))
        order = np.argsort(-cosines, axis=1, kind="stable")
        enough = np.cumsum(self.rows[order], axis=1) >= limit if len(self.cells) else np.zeros(cosines.shape, dtype=bool)
        number = np.maximum(np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, cosines.shape[1]) if cosines.shape[1] else 0, min(probes, cosines.shape[1]))
        probed = np.zeros(cosines.shape, dtype=bool)
        for i, n in enumerate(np.broadcast_to(number, (len(block),)).tolist()):
            probed[i, order[i, :n]] = True
        found = materialise(self._scan(block, asked, scopes, key, probed, limit, False), "probed")
        have = {r.query_id: (r.n, r.last) for r in found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last")).collect()}
        counts = [have.get(row[0], (0, 0.0)) for row in block]
        short = np.array([n < limit for n, _ in counts], dtype=bool)
        rest = np.zeros(probed.shape, dtype=bool)
        rest[short] = True
        if certain and len(block):
            angle = np.arccos(np.clip(cosines, -1, 1)) - np.arccos(np.clip(self.nearness, -1, 1))[None, :]
            rest |= np.cos(np.maximum(angle, 0)) >= np.array([last for _, last in counts])[:, None] - 1e-9
        rest &= ~probed
        # rows without a direction have cosine 0 with everything
        also = short | (certain & np.array([last <= 1e-9 for _, last in counts], dtype=bool)) if len(block) else short
        if rest.any() or (self.others and also.any()):
            more = self._scan(block, asked, scopes, key, rest, limit, also if self.others else False)
            found = top_rows(found.drop("rank").unionByName(more.drop("rank")), ["query_id"], [F.desc("score"), F.col("id")], limit)
        return found

    def _scan(self, block: list[tuple], asked: np.ndarray, scopes: list, key: T.StructField, probed: np.ndarray, limit: int, others) -> DataFrame:
        """The best rows of the cells that each query probes; ``others``: queries that see the rows without a direction."""
        cells = self.cells[probed.any(axis=0)].tolist() if len(block) else []
        sees = {int(c): np.flatnonzero(probed[:, j]) for j, c in enumerate(self.cells.tolist())}
        if others is not False:
            cells, sees[NO_CELL] = [*cells, NO_CELL], np.flatnonzero(others)
        kinds = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string()}
        ids = pa.array([row[0] for row in block], type=kinds.get(type(key.dataType)))
        size = asked.shape[1]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                some, units = _units(batch.column("embedding"), size)
                whole = np.zeros((batch.num_rows, size))
                whole[some] = units
                cell, repos = batch.column("cell").to_numpy(), batch.column("repo").to_pylist()
                rank = np.empty(batch.num_rows, dtype=np.int64)
                rank[pc.sort_indices(batch.column("id")).to_numpy()] = np.arange(batch.num_rows)
                for c in np.unique(cell).tolist():
                    here, who = np.flatnonzero(cell == c), sees.get(c, ())
                    if not len(who):
                        continue
                    scores = asked[who] @ whole[here].T
                    query, place, value = [], [], []
                    for i, q in enumerate(who.tolist()):
                        mine = here if scopes[q] is None else here[[repos[j] == scopes[q] for j in here.tolist()]]
                        own = scores[i] if scopes[q] is None else scores[i][np.isin(here, mine)]
                        best = np.lexsort((rank[mine], -own))[:limit]
                        query += [q] * len(best)
                        place.append(mine[best])
                        value.append(own[best])
                    place = pa.array(np.concatenate(place))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(query, type=pa.int64())), batch.column("id").take(place), batch.column("repo").take(place), pa.array(np.concatenate(value))],
                        ["query_id", "id", "repo", "score"])

        schema = T.StructType([T.StructField("query_id", key.dataType), self.stored.schema["id"], self.stored.schema["repo"], T.StructField("score", T.DoubleType())])
        near = self.stored.where(F.col("cell").isin(cells)).select("id", "repo", "embedding", "cell").mapInArrow(score, schema)
        return top_rows(near, ["query_id"], [F.desc("score"), F.col("id")], limit)
