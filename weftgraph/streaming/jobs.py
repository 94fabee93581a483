"""Structured Streaming counterparts of the ingest, metering and memory jobs.

Each function takes a streaming DataFrame and returns one (or starts a query);
``drain`` runs what is available and reads the sink back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftgraph.operators.extract import defines_edges, extract_symbols, intra_file_calls
from weftgraph.operators.memory import TOKEN_LIMIT, WINDOW, Memory, memory_schema
from weftgraph.operators.meter import Limits
from weftgraph.operators.relink import link_callers, reached_callers
from weftgraph.plans.index import with_ordinal
from weftgraph.schema import EDGES, NODES, conform
from weftgraph.session import materialise, scratch_path
from weftgraph.sources.snapshots import BUCKETS, SnapshotStore


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available now, into the shared folder."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    query = (stream.writeStream.outputMode(mode).format("parquet").option("path", path)
             .option("checkpointLocation", path + "-progress").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


# --- telemetry --------------------------------------------------------------

def windowed_telemetry(calls: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Calls, tokens and latency per tool and time window; rows later than
    ``late`` behind the newest event are dropped."""
    time = F.window("ts", width, slide) if slide else F.window("ts", width)
    return calls.withWatermark("ts", late).groupBy(time, "tool").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("result_tokens").alias("tokens"), F.sum("duration_ms").alias("latency_ms"),
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "tool", "calls", "tokens", "latency_ms")


def session_telemetry(calls: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Calls and tokens per burst of activity of one session."""
    return calls.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "session").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("result_tokens").alias("tokens"),
    ).select("session", F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "calls", "tokens")


# --- guardrails -------------------------------------------------------------

DECISION = [
    T.StructField("seq", T.LongType()), T.StructField("trigger", T.StringType()),
    T.StructField("calls_before", T.LongType()), T.StructField("tokens_before", T.LongType()),
]
GUARD_STATE = T.StructType([
    T.StructField("calls", T.LongType()), T.StructField("tokens", T.LongType()),
    T.StructField("signatures", T.ArrayType(T.StringType())),
    T.StructField("repos", T.ArrayType(T.StringType())), T.StructField("files", T.ArrayType(T.StringType())),
])


def guardrails(calls: DataFrame, limits: Limits = Limits(), ttl_ms: int | None = None, late: str = "1 hour") -> DataFrame:
    """Decision per call, as it arrives. The state of a session holds only its
    recorded calls, at most ``max_tool_calls``. With ``ttl_ms`` a session is
    forgotten once the watermark has passed its last call by that much."""
    schema = T.StructType([T.StructField("session", calls.schema["session"].dataType), *DECISION])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        calls_used, tokens, signatures, repos, files = state.get if state.exists else (0, 0, [], [], [])
        signatures, repos, files = list(signatures), set(repos), set(files)
        # arrival order within a micro-batch is not the call order
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for row in rows.itertuples(index=False):
            signature = f"{row.tool}\x00{row.args}"
            trigger = None
            if calls_used >= limits.max_tool_calls:
                trigger = "max_tool_calls"
            elif tokens >= limits.token_budget:
                trigger = "token_budget_exceeded"
            elif signatures.count(signature) >= limits.repeats:
                trigger = "cycle_detected"
            elif len(repos) > limits.max_repos:
                trigger = "blast_radius_repos"
            elif len(files) > limits.max_files:
                trigger = "blast_radius_files"
            out.append((key[0], row.seq, trigger, calls_used, tokens))
            if trigger is None:
                calls_used, tokens = calls_used + 1, tokens + int(row.result_tokens)
                signatures.append(signature)
                repos.update(row.repos)
                files.update(row.files)
        state.update((calls_used, tokens, signatures, sorted(repos), sorted(files)))
        if ttl_ms is not None:
            newest = int(rows["ts"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + ttl_ms)
        yield pd.DataFrame(out, columns=schema.names)

    slim = calls.select("session", "seq", "ts", "tool", "args", "result_tokens", "repos", "files")
    timeout = GroupStateTimeout.NoTimeout
    if ttl_ms is not None:
        # event time, so that a bounded run ends: processing-time timers never do
        slim, timeout = slim.withWatermark("ts", late), GroupStateTimeout.EventTimeTimeout
    return slim.groupBy("session").applyInPandasWithState(step, schema, GUARD_STATE, "append", timeout)


# --- conversation memory ----------------------------------------------------

MEMORY_STATE = T.StructType([
    T.StructField("turns", T.ArrayType(T.LongType())), T.StructField("roles", T.ArrayType(T.StringType())),
    T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("tokens", T.LongType()),
])


def conversation_memory(messages: DataFrame, window: int = WINDOW, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Summary rows as they are made, and a counter row per session and batch.
    The state is the session's window and counter."""
    schema = memory_schema(messages.schema["session"].dataType)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, tokens = [], 0
        if state.exists:
            turns, roles, texts, tokens = state.get
            kept = list(zip(turns, roles, texts))
        memory, out, turn = Memory(window, limit, kept, tokens), [], None
        rows = pd.concat(list(batches)).sort_values("turn")
        for turn, role, text in rows[["turn", "role", "text"]].itertuples(index=False, name=None):
            out += [(key[0], "summary", t, None, s, None, i) for i, (t, s) in enumerate(memory.add(turn, role, text or ""))]
        out.append((key[0], "counter", turn, None, None, memory.tokens, 0))
        state.update(([k[0] for k in memory.kept], [k[1] for k in memory.kept], [k[2] for k in memory.kept], memory.tokens))
        yield pd.DataFrame(out, columns=schema.names).astype({"turn": "Int64", "tokens": "Int64"})

    slim = messages.select("session", F.col("turn").cast("long"), "role", "text")
    return slim.groupBy("session").applyInPandasWithState(step, schema, MEMORY_STATE, "append", GroupStateTimeout.NoTimeout)


# --- ingest -----------------------------------------------------------------

STORED_EDGES = T.StructType([*EDGES.fields, T.StructField("home_repo", T.StringType()), T.StructField("home_path", T.StringType())])


def apply_changes(store: SnapshotStore, batch: DataFrame, batch_id: int | None, link: bool = True, version: str | None = None) -> bool:
    """Bring the stored graph up to date with ``batch(repo, file_path, content)``; False if there was nothing to do.

    A null content deletes the file. Of several rows of one path the one with
    the highest ``version`` column counts (without such a column: the greatest
    text). Symbols of changed files are replaced; cross-repository edges are
    linked again for the callers that the change can reach, and for no others.
    Nodes and edges become current by one commit, which carries the batch's
    number, so a batch that is repeated after it changes nothing.
    """
    now = store.current()
    if batch_id is not None and now.batch is not None and batch_id <= now.batch:
        return False
    text = F.struct("content")
    last = batch.groupBy("repo", "file_path").agg(F.max_by(text, F.struct(version, text) if version else text).alias("t"))
    changed = materialise(last.select("repo", "file_path", "t.content"), "changed")
    if changed.isEmpty():
        return False
    after = store.following(now, now.batch if batch_id is None else batch_id)
    keys = changed.select("repo", "file_path")
    found = materialise(extract_symbols(changed.where("content IS NOT NULL")), "fresh")
    fresh = conform(found, NODES)
    touched = store.buckets_of(keys)
    stored = store.read("nodes", NODES, now, only=touched)
    old = materialise(stored.join(keys, ["repo", "file_path"], "left_semi").select(*NODES.names), "old")
    store.stage(after, "nodes", stored.join(keys, ["repo", "file_path"], "left_anti").select(*NODES.names).unionByName(fresh), "repo", touched)

    home = [F.col("repo").alias("home_repo"), F.col("file_path").alias("home_path")]
    callers = fresh.select(F.col("id").alias("caller_id"), *home).distinct()
    edges = conform(defines_edges(found).unionByName(intra_file_calls(found)), EDGES)
    reached = callers.select("caller_id").limit(0)
    if link:
        nodes = with_ordinal(store.read("nodes", NODES, after))
        ids = reached_callers(nodes, with_ordinal(old), with_ordinal(fresh))
        linked = materialise(nodes.join(ids, "id", "left_semi"), "callers")
        edges = edges.unionByName(link_callers(linked, nodes))
        callers = materialise(callers.unionByName(linked.select(F.col("id").alias("caller_id"), *home)).distinct(), "homes")
        reached = callers.select("caller_id")
    edges = materialise(edges.join(callers, "caller_id").select(*STORED_EDGES.names), "edges")
    touched = store.buckets_of(keys.select("repo").unionByName(callers.select(F.col("home_repo").alias("repo"))))
    stored = store.read("edges", STORED_EDGES, now, only=touched)
    changed_files = keys.select(F.col("repo").alias("home_repo"), F.col("file_path").alias("home_path"))
    kept = stored.join(changed_files, ["home_repo", "home_path"], "left_anti")
    across = F.col("target_repo").isNotNull()
    kept = kept.where(~across).unionByName(kept.where(across).join(reached, "caller_id", "left_anti"))
    store.stage(after, "edges", kept.select(*STORED_EDGES.names).unionByName(edges), "home_repo", touched)
    store.commit(after)
    return True


def ingest(files: DataFrame, store: str, link: bool = True, version: str | None = None, buckets: int = BUCKETS):
    """Start a query that keeps the graph in the snapshot store ``store`` current; see ``apply_changes`` for a batch."""
    spark = files.sparkSession
    tables = SnapshotStore(spark, store, buckets)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if apply_changes(tables, batch, batch_id, link, version):
            tables.vacuum()

    return (files.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{store}/progress")
            .trigger(availableNow=True).start())
