"""Building blocks that keep hot keys from landing in one task.

Assumption throughout the library: a single key may own a third of all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weftgraph.session import materialise

ROWS_PER_TASK = 2_000_000
#: Stored bytes past which no lookup table is broadcast, however few its rows.
MAX_BROADCAST_BYTES = 32 << 20
#: Ends of edges that are broadcast at most. Low, so that a graph of 0.1 GB is joined as one of 6 GB is.
MAX_BROADCAST_ENDS = 100_000
#: Parts of the edges of a large graph that are joined with their ends one after the other.
SLICES = 8
#: Rows of a slice at least, where tables are worked on in slices.
SLICE_ROWS = 500_000
#: Stored bytes of a lookup table with few rows for each key, for each shuffle partition, up to which it is hashed and not sorted.
MAX_HASHED_BYTES = 16 << 20


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only after counting at most ``max_rows + 1`` rows.

    Past the bound the frame is returned without a hint and Spark joins it by
    shuffle, which gives the same rows.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def stored_bytes(table: DataFrame) -> int:
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_stored_small(table: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """``broadcast_if_small`` for a written table, whose stored bytes must be few as well."""
    return broadcast_if_small(table, max_rows) if stored_bytes(table) <= MAX_BROADCAST_BYTES else table


def hashed_if_bounded(table: DataFrame) -> DataFrame:
    """Hint that a written table without hot keys is hashed in its partitions, so the long side of its join is not sorted."""
    partitions = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.hint("shuffle_hash") if stored_bytes(table) <= partitions * MAX_HASHED_BYTES else table


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more rows than one task should take, and their salt count.

    Every key past the bound is listed, so there are at most rows /
    ``rows_per_task`` of them. Spark chooses how to join the list by its size.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > rows_per_task)
        .select(*keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_salts"))
    )


def salt_stream_side(df: DataFrame, hot: DataFrame, keys: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """Split the rows of hot keys by a hash of ``spread``; null keys spread too."""
    null_key = F.lit(False)
    for key in keys:
        null_key = null_key | F.col(key).isNull()
    fan = F.xxhash64(*spread)
    return (
        df.join(hot, list(keys), "left")
        .withColumn(
            "_salt",
            F.when(null_key, F.pmod(fan, F.lit(1024)))
            .when(F.col("_salts").isNull(), F.lit(0))
            .otherwise(F.pmod(fan, F.col("_salts")))
            .cast("int"),
        )
        .drop("_salts")
    )


def salt_build_side(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeat the rows of hot keys once per salt."""
    return (
        df.join(hot, list(keys), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )


def salted_join(
    stream: DataFrame,
    build: DataFrame,
    keys: Sequence[str],
    how: str,
    spread: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Equi-join where ``stream`` may be dominated by a few keys.

    ``how`` is one of inner, left, left_semi, left_anti.
    """
    hot = hot_keys(stream, keys, rows_per_task)
    left = salt_stream_side(stream, hot, keys, spread)
    right = salt_build_side(build, hot, keys)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def lookup_join(
    stream: DataFrame,
    build: DataFrame,
    keys: Sequence[str],
    how: str,
    spread: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
    max_broadcast_rows: int = 500_000,
    by_id: bool = False,
) -> DataFrame:
    """Join a long, possibly skewed ``stream`` to a derived lookup table.

    The lookup is written out and counted. Within the bound it is broadcast,
    so the stream is not shuffled at all and its hot keys do not matter; past
    the bounds of rows and stored bytes it is joined by shuffle. All ways give
    the same rows. Adaptive execution splits a hot key's partition where it
    stands; only without it are the keys counted first, which computes the
    stream once more for the count, and salted. With ``by_id`` the lookup has
    a row or few for each key, so its partitions can be hashed.
    """
    return looked_up(stream, materialise(build, "lookup"), keys, how, spread, rows_per_task, max_broadcast_rows, by_id)


def looked_up(
    stream: DataFrame, table: DataFrame, keys: Sequence[str], how: str, spread: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK, max_broadcast_rows: int = 500_000, by_id: bool = False,
) -> DataFrame:
    """``lookup_join`` with a written lookup table."""
    hinted = broadcast_if_stored_small(table, max_broadcast_rows)
    if hinted is not table:
        return stream.join(hinted, list(keys), how)
    if splits_skew(stream.sparkSession):
        return stream.join(hashed_if_bounded(table) if by_id else table, list(keys), how)
    return salted_join(stream, table, keys, how, spread, rows_per_task)


def splits_skew(spark: SparkSession) -> bool:
    """Whether adaptive execution deals a join's oversized partitions over several tasks."""
    return all(spark.conf.get(name) == "true" for name in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled"))


def edges_with_ends(edges: DataFrame, callers: DataFrame, callees: DataFrame, how: str = "inner", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Edges with the columns of ``callers(caller_id, …)`` and ``callees(callee_id, …)``.

    A hub may be an end of a third of all edges, so each end is a lookup: it is
    broadcast, or the edges are shuffled once by that end.
    """
    return _with_ends(edges, *(materialise(t, "lookup") for t in (callers, callees)), how, rows_per_task)


def _with_ends(edges: DataFrame, callers: DataFrame, callees: DataFrame, how: str, rows_per_task: int) -> DataFrame:
    first = looked_up(edges, callers, ["caller_id"], how, ["callee_id"], rows_per_task, MAX_BROADCAST_ENDS, True)
    return looked_up(first, callees, ["callee_id"], how, ["caller_id"], rows_per_task, MAX_BROADCAST_ENDS, True)


def shaped_edges(edges: DataFrame, callers: DataFrame, callees: DataFrame, shape: Callable[[DataFrame], DataFrame], how: str = "inner",
                 rows_per_task: int = ROWS_PER_TASK, written: bool = False) -> DataFrame:
    """``shape`` of ``edges_with_ends``, which works on each edge by itself.

    Where the ends of the edges have to be shuffled, the edges are written
    first, and a slice of them is joined, shaped and written after the other,
    so that the shuffle files of one slice are on the disks at a time. The
    result of few ends is only ``written`` if that is asked for.
    """
    ends = [materialise(t, "lookup") for t in (callers, callees)]
    if all(broadcast_if_stored_small(t, MAX_BROADCAST_ENDS) is not t for t in ends):
        met = shape(_with_ends(edges, *ends, how, rows_per_task))
        return materialise(met, "shaped") if written else met
    dealt = materialise(edges.withColumn("_slice", F.pmod(F.xxhash64("caller_id", "callee_id"), F.lit(SLICES)).cast("int")), "edges", "_slice")
    return reduce(DataFrame.unionByName, [
        materialise(shape(_with_ends(dealt.where(F.col("_slice") == i).drop("_slice"), *ends, how, rows_per_task)), "shaped") for i in range(SLICES)])


def slices_for(rows: int) -> int:
    return max(1, min(SLICES, -(-rows // SLICE_ROWS)))


def in_slices(slices: int, shape: Callable[[Callable[[DataFrame, str], DataFrame]], DataFrame], label: str) -> DataFrame:
    """``shape(part)`` for one slice after the other, each written, so that the disks hold the shuffle files of one at a time.

    ``part(df, key)`` are the rows of ``df`` whose ``key`` is in the slice; rows of different keys must not meet in ``shape``.
    """
    if slices == 1:
        return shape(lambda df, key: df)
    return reduce(DataFrame.unionByName, [
        materialise(shape(lambda df, key, i=i: df.where(F.pmod(F.xxhash64(key), F.lit(slices)) == i)), label) for i in range(slices)])


def numbered(ids: DataFrame) -> DataFrame:
    """``ids(id)`` → ``(id, number)``, a number for each distinct id, written so that it stays the same.

    Eight bytes stand for a long id where rows are shuffled and sorted.
    """
    distinct = materialise(ids.where(F.col("id").isNotNull()).select("id").distinct(), "ids")
    return materialise(distinct.withColumn("number", F.monotonically_increasing_id()), "numbers")


def ordered_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Cut every key's ordered rows into consecutive blocks of bounded size.

    Rows are range-partitioned on (keys, order), so a hot key simply spans many
    partitions; the partition number is the block. ``order`` must be unique
    within a key. The result is written out so that every later use sees the
    same block numbers.
    """
    spark = df.sparkSession
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c) for c in (*keys, *order)])
    return materialise(ranged.withColumn("_block", F.spark_partition_id()), "blocks")


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    blocks: int | None = None,
) -> DataFrame:
    """Exclusive running sums per key: each row gets the total of earlier rows.

    ``blocks=None`` expects ``df`` without a ``_block`` column and adds one.
    The window only ever spans one (key, block); block totals, at most one row
    per key and partition, are chained separately.
    """
    staged = df if "_block" in df.columns else ordered_blocks(df, keys, order, blocks)
    earlier = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    chain = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    inner = staged
    for name, value in sums.items():
        inner = inner.withColumn(f"_in_{name}", F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    totals = staged.groupBy(*keys, "_block").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    for name in sums:
        totals = totals.withColumn(f"_off_{name}", F.coalesce(F.sum(f"_t_{name}").over(chain), F.lit(0)))
    totals = totals.drop(*[f"_t_{n}" for n in sums])

    joined = inner.join(totals, [*keys, "_block"])
    for name in sums:
        joined = joined.withColumn(name, F.col(f"_in_{name}") + F.col(f"_off_{name}"))
    return joined.drop(*[f"_in_{n}" for n in sums], *[f"_off_{n}" for n in sums])


def occurrence_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """How many earlier rows share the key, in ``order``."""
    return running_before(df, keys, order, {name: F.lit(1)}).drop("_block")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by ``order``, as a partially aggregated min."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min_by(F.struct(*rest), F.struct(*order)) if rest else None
    aggs = [F.min(F.struct(*order)).alias("_o")] + ([packed.alias("_r")] if rest else [])
    out = df.groupBy(*keys).agg(*aggs)
    cols = [F.col(k) if k in keys else (F.col(f"_o.{k}") if k in order else F.col(f"_r.{k}")) for k in df.columns]
    return out.select(*[c.alias(n) for c, n in zip(cols, df.columns)])


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key. Spark prunes to ``k`` per key and map task
    before the shuffle (window group limit), so hot keys stay small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
