"""Budgets and guardrails over a table of tool calls.

``calls(session, seq, ts, tool, args, result_tokens, duration_ms, repos, files)``
with ``seq`` unique within a session. All running figures use blocked prefix
sums, so one session may own most of the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from weftgraph.operators.scale import lookup_join, ordered_blocks, running_before
from weftgraph.session import materialise


@dataclass(frozen=True)
class Limits:
    # The default budgets.
    max_tool_calls: int = 8
    token_budget: int = 12_000
    max_repos: int = 10
    max_files: int = 50
    repeats: int = 2


def _first_touch(calls: DataFrame, column: str) -> DataFrame:
    """How many values of an array column a call is the first to touch."""
    each = calls.select("session", "seq", F.explode(column).alias("value"))
    first = each.groupBy("session", "value").agg(F.min("seq").alias("seq"))
    return first.groupBy("session", "seq").agg(F.count(F.lit(1)).alias(f"new_{column}"))


def _with_touch(calls: DataFrame, counted: DataFrame) -> DataFrame:
    """Adds new_repos and new_files, where only ``counted`` calls touch."""
    out = calls
    for column in ("repos", "files"):
        out = out.join(_first_touch(counted, column), ["session", "seq"], "left").withColumn(
            f"new_{column}", F.coalesce(f"new_{column}", F.lit(0)))
    return out


def _with_repeats(calls: DataFrame) -> DataFrame:
    """Adds ``seen``: earlier calls of the session with the same tool and args."""
    return running_before(calls, ["session", "tool", "args"], ["seq"], {"seen": F.lit(1)}).drop("_block")


def usage_before(calls: DataFrame) -> DataFrame:
    """Calls, tokens, repeats, repositories and files used before each call,
    counting every call (no blocking)."""
    touched = _with_touch(_with_repeats(calls), calls)
    return running_before(touched, ["session"], ["seq"], {
        "calls_before": F.lit(1), "tokens_before": F.col("result_tokens"),
        "repos_before": F.col("new_repos"), "files_before": F.col("new_files"),
    }).drop("_block", "new_repos", "new_files")


def usage_flags(calls: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The five limits as independent flags, without feedback."""
    return usage_before(calls).select(
        "session", "seq",
        (F.col("calls_before") >= limits.max_tool_calls).alias("over_calls"),
        (F.col("tokens_before") >= limits.token_budget).alias("over_tokens"),
        (F.col("seen") >= limits.repeats).alias("repeated"),
        (F.col("repos_before") > limits.max_repos).alias("over_repos"),
        (F.col("files_before") > limits.max_files).alias("over_files"))


def decisions(calls: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """First limit that blocks each call, given that blocked calls do not count.

    The fold has a closed form. Until a session reaches one of its absorbing
    limits (calls, tokens, repositories, files), the calls that count are
    exactly the first ``repeats`` of each signature; from the first call that
    finds such a limit reached, nothing counts any more and the state is
    frozen. So prefix sums over the counting calls, the session's stopping
    point and the second sighting of each signature decide every call.
    """
    ranked = materialise(_with_repeats(calls), "ranked")
    counts = F.col("seen") < limits.repeats
    staged = ordered_blocks(_with_touch(ranked, ranked.where(counts)), ["session"], ["seq"])
    state = running_before(staged, ["session"], ["seq"], {
        "calls_before": F.when(counts, 1).otherwise(0),
        "tokens_before": F.when(counts, F.col("result_tokens")).otherwise(0),
        "repos_before": F.col("new_repos"), "files_before": F.col("new_files"),
    }).drop("_block", "new_repos", "new_files")
    used = ["calls_before", "tokens_before", "repos_before", "files_before"]
    absorbed = (
        (F.col("calls_before") >= limits.max_tool_calls) | (F.col("tokens_before") >= limits.token_budget)
        | (F.col("repos_before") > limits.max_repos) | (F.col("files_before") > limits.max_files))
    state = materialise(state, "state")
    stops = state.where(absorbed).groupBy("session").agg(
        F.min("seq").alias("stop_seq"), F.min_by(F.struct(*used), "seq").alias("stop"))
    decided = lookup_join(state, stops, ["session"], "left", ["seq"])
    # the call that makes a signature count to the limit
    last_counted = state.where(F.col("seen") == limits.repeats - 1).select("session", "tool", "args", F.col("seq").alias("full_seq"))
    decided = lookup_join(decided, last_counted, ["session", "tool", "args"], "left", ["seq"])
    frozen = F.coalesce(F.col("seq") >= F.col("stop_seq"), F.lit(False))
    for name in used:
        decided = decided.withColumn(name, F.when(frozen, F.col(f"stop.{name}")).otherwise(F.col(name)))
    repeated = F.coalesce(F.col("full_seq") < F.least("seq", F.coalesce("stop_seq", F.col("seq"))), F.lit(False))
    trigger = (
        F.when(F.col("calls_before") >= limits.max_tool_calls, "max_tool_calls")
        .when(F.col("tokens_before") >= limits.token_budget, "token_budget_exceeded")
        .when(repeated, "cycle_detected")
        .when(F.col("repos_before") > limits.max_repos, "blast_radius_repos")
        .when(F.col("files_before") > limits.max_files, "blast_radius_files"))
    return decided.withColumn("trigger", trigger).drop("stop", "stop_seq", "full_seq", "seen")


def telemetry(decided: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Roll-up of the recorded calls per session.

    Recorded calls number at most ``max_tool_calls`` per session, which is
    what bounds the tool sequence.
    """
    recorded = decided.where(F.col("trigger").isNull())
    base = recorded.groupBy("session").agg(
        F.count(F.lit(1)).alias("total_tool_calls"), F.sum("result_tokens").alias("approx_tokens_used"),
        F.sum("duration_ms").alias("total_tool_latency_ms"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "tool"))), lambda x: x["tool"]), ",").alias("tool_sequence"))
    for column in ("repos", "files"):
        touched = recorded.select("session", F.explode(column).alias("value")).groupBy("session").agg(
            F.count_distinct("value").alias(f"{column}_touched"))
        base = base.join(touched, "session", "left").withColumn(f"{column}_touched", F.coalesce(f"{column}_touched", F.lit(0)))
    return base.withColumn("budget_utilization_pct", F.round(
        F.col("approx_tokens_used") / F.lit(max(limits.token_budget, 1)) * 100, 1))


def safety_report(decided: DataFrame) -> DataFrame:
    """Blocked calls per session and limit, with the usage at the first block."""
    return decided.where(F.col("trigger").isNotNull()).groupBy("session", "trigger").agg(
        F.count(F.lit(1)).alias("blocked"), F.min("seq").alias("first_seq"),
        F.min_by("calls_before", "seq").alias("calls_at_first"), F.min_by("tokens_before", "seq").alias("tokens_at_first"))


def safety_summary(decided: DataFrame) -> DataFrame:
    """One row per session: calls and tokens used, triggers, all clear."""
    ok = F.col("trigger").isNull()
    return decided.groupBy("session").agg(
        F.count_if(ok).alias("tool_calls_used"), F.coalesce(F.sum(F.when(ok, F.col("result_tokens"))), F.lit(0)).alias("tokens_used"),
        F.count_if(~ok).alias("trigger_count"), F.bool_and(ok).alias("all_clear"))
