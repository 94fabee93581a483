"""Bounded conversation memory over ``messages(session, turn, role, text)``."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from weftgraph.operators.scale import ordered_blocks, running_before, top_rows
from weftgraph.session import materialise

# The default window and token limit, and the excerpt lengths.
WINDOW = 20
TOKEN_LIMIT = 10_000
DROPPED_CHARS = 200
COMPACTED_CHARS = 150


def memory_schema(session: T.DataType) -> T.StructType:
    """Rows of a memory; a session keeps the type of its id."""
    return T.StructType([
        T.StructField("session", session),
        T.StructField("kind", T.StringType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("tokens", T.LongType()),
        T.StructField("step", T.IntegerType()),
    ])


def last_messages(messages: DataFrame, n: int = WINDOW) -> DataFrame:
    """The newest ``n`` messages of each session."""
    return top_rows(messages, ["session"], [F.desc("turn")], n, "age").drop("age")


def dropped_summaries(messages: DataFrame, n: int = WINDOW) -> DataFrame:
    """One summary per message that slid out of the window, in turn order.

    With one message added at a time each overflow drops one message, so the
    summaries are rows, not one growing text.
    """
    newest_first = running_before(
        messages.withColumn("_newest", -F.col("turn")), ["session"], ["_newest"], {"newer": F.lit(1)})
    return newest_first.where(F.col("newer") >= n).select(
        "session", "turn", F.concat(
            F.lit("Truncated 1 messages. Content: ["), "role", F.lit("]: "), F.left("text", F.lit(DROPPED_CHARS))).alias("text"))


class Memory:
    """The window, counter and summaries of one session.

    A sequential state machine: each message slides the window, and a counter
    above the limit compacts it. Used by the batch rounds and the stream.
    """

    def __init__(self, window: int, limit: int, kept: list[tuple], tokens: int) -> None:
        self.window, self.limit = window, limit
        self.kept, self.tokens = deque(kept), tokens

    def add(self, turn: int, role: str, text: str) -> list[tuple[int, str]]:
        """Returns the summaries this message causes, as (turn, text)."""
        made = []
        self.kept.append((turn, role, text))
        self.tokens += len(text) // 4
        if len(self.kept) > self.window:
            made.append((turn, self._drop(len(self.kept) - self.window, "Truncated {} messages. Content: ", DROPPED_CHARS)))
        if self.tokens > self.limit and len(self.kept) > 1:
            keep = max(1, min(self.window // 2, len(self.kept) // 2))
            made.append((turn, self._drop(len(self.kept) - keep, "Compacted {} messages due to token budget. ", COMPACTED_CHARS)))
            self.tokens = sum(len(t) // 4 for _, _, t in self.kept)
        return made

    def _drop(self, count: int, lead: str, chars: int) -> str:
        gone = [self.kept.popleft() for _ in range(count)]
        return lead.format(count) + " | ".join(f"[{role}]: {text[:chars]}" for _, role, text in gone)


def compact(messages: DataFrame, window: int = WINDOW, limit: int = TOKEN_LIMIT, blocks: int | None = None) -> DataFrame:
    """Memory of every session after its last message.

    Rows of kind ``summary`` (in ``turn, step`` order), ``window`` and ``counter``.
    The counter depends on every earlier compaction, so a session is folded in
    order. Its messages are cut into bounded chunks and round ``r`` folds
    chunk ``r`` of all sessions that have one, starting from the state of the
    round before: no task ever holds more than one chunk and one window. The
    chunks are stored by number, so that a round reads only its own.
    """
    schema = memory_schema(messages.schema["session"].dataType)

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("turn", kind="stable")
        state, fresh = rows[rows["kind"] != "message"], rows[rows["kind"] == "message"]
        kept = state[state["kind"] == "window"][["turn", "role", "text"]].itertuples(index=False, name=None)
        memory = Memory(window, limit, list(kept), int(state.loc[state["kind"] == "counter", "tokens"].sum()))
        out = []
        for turn, role, text in fresh[["turn", "role", "text"]].itertuples(index=False, name=None):
            out += [(key[0], "summary", t, None, s, None, i) for i, (t, s) in enumerate(memory.add(turn, role, text))]
        out += [(key[0], "window", t, r, s, None, 0) for t, r, s in memory.kept]
        out.append((key[0], "counter", int(rows["turn"].max()), None, None, memory.tokens, 0))
        return pd.DataFrame(out, columns=schema.names).astype({"turn": "Int64", "tokens": "Int64"})

    slim = messages.select("session", F.col("turn").cast("long"), "role", F.coalesce("text", F.lit("")).alias("text"))
    staged = ordered_blocks(slim, ["session"], ["turn"], blocks)
    # number a session's blocks 0, 1, 2, ...; the table has a row per session and block
    numbering = staged.select("session", "_block").distinct().withColumn(
        "chunk", F.row_number().over(Window.partitionBy("session").orderBy("_block")) - 1)
    chunks = materialise(staged.join(numbering, ["session", "_block"]).drop("_block"), "chunks", by="chunk")
    rounds = chunks.agg(F.max("chunk")).first()[0]
    if rounds is None:
        return messages.sparkSession.createDataFrame([], schema)
    done, state = [], None
    for number in range(rounds + 1):
        part = chunks.where(F.col("chunk") == number).select(
            "session", F.lit("message").alias("kind"), "turn", "role", "text",
            F.lit(None).cast("long").alias("tokens"), F.lit(0).alias("step"))
        if state is not None:
            live = part.select("session").distinct()
            done.append(state.join(live, "session", "left_anti"))
            part = part.unionByName(state.join(live, "session", "left_semi"))
        result = materialise(part.groupBy("session").applyInPandas(fold, schema), "memory")
        done.append(result.where(F.col("kind") == "summary"))
        state = result.where(F.col("kind") != "summary")
    out = state
    for piece in done:
        out = out.unionByName(piece)
    return out


def context_messages(memory: DataFrame) -> DataFrame:
    """Summaries first, then the window, as ``(session, part, ord, step, role, text)``.

    The first summary carries the heading; joining a session's summaries with
    newlines gives the single message a model would be sent.
    """
    first = memory.where("kind = 'summary'").groupBy("session").agg(F.min(F.struct("turn", "step")).alias("first"))
    summaries = memory.where("kind = 'summary'").join(first, "session").select(
        "session", F.lit(0).alias("part"), F.col("turn").alias("ord"), "step", F.lit("user").alias("role"),
        F.concat(F.when(F.struct("turn", "step") == F.col("first"), F.lit("[Prior conversation summary]: ")).otherwise(F.lit("")), "text").alias("text"))
    window = memory.where("kind = 'window'").select(
        "session", F.lit(1).alias("part"), F.col("turn").alias("ord"), "step", "role", "text")
    return summaries.unionByName(window)


def session_listing(messages: DataFrame, memory: DataFrame) -> DataFrame:
    """Turns, kept messages, tokens, and when each session began and was last
    active: times where the messages carry ``ts``, else turns."""
    at = "ts" if "ts" in messages.columns else "turn"
    seen = messages.groupBy("session").agg(
        F.count(F.lit(1)).alias("turn_count"), F.min(at).alias("created_at"), F.max(at).alias("last_active"))
    kept = memory.groupBy("session").agg(
        F.count_if(F.col("kind") == "window").alias("message_count"), F.max("tokens").alias("approx_tokens"))
    return seen.join(kept, "session")
