"""Guardrails on events and conversation memory on conversations."""

from pyspark.sql import functions as F

from weftgraph.operators import memory as m
from weftgraph.operators import meter as t
from weftgraph.plans.catalog.book import Book
from weftgraph.sources import views

BOOK = Book()
LIMITS = t.Limits(max_tool_calls=22, token_budget=1200, max_repos=10, max_files=18)


def calls(spark, sf):
    return views.view(spark, sf, views.TOOL_CALLS).select(
        "session", "seq", "ts", "tool", "args", "result_tokens", "duration_ms", F.array("repo_ref").alias("repos"), F.array("file_ref").alias("files"))


CALLS = f"WITH RECURSIVE c AS {views.duck(views.TOOL_CALLS)}"
BEFORE = CALLS + """, u AS (SELECT session, seq, count(*) OVER w AS calls_before, coalesce(CAST(sum(result_tokens) OVER w AS BIGINT), 0) AS tokens_before,
count(*) OVER (PARTITION BY session, tool, args ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen,
len(list_distinct(list(repo_ref) OVER w)) AS repos_before, len(list_distinct(list(file_ref) OVER w)) AS files_before
FROM c WINDOW w AS (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


@BOOK.query(BEFORE + "SELECT session, seq, calls_before >= 22 AS limited FROM u")
def call_count_limit(spark, sf):
    return t.usage_before(calls(spark, sf)).select("session", "seq", (F.col("calls_before") >= 22).alias("limited"))


@BOOK.query(BEFORE + "SELECT session, seq, tokens_before FROM u")
def token_budget(spark, sf):
    return t.usage_before(calls(spark, sf)).select("session", "seq", "tokens_before")


@BOOK.query(BEFORE + "SELECT session, seq, seen FROM u")
def repeated_calls(spark, sf):
    return t.usage_before(calls(spark, sf)).select("session", "seq", "seen")


@BOOK.query(BEFORE + "SELECT session, seq, coalesce(repos_before, 0) AS repos_before, coalesce(files_before, 0) AS files_before FROM u")
def blast_scope(spark, sf):
    return t.usage_before(calls(spark, sf)).select("session", "seq", "repos_before", "files_before")


@BOOK.query(BEFORE + "SELECT session, seq, calls_before >= 22 AS over_calls, tokens_before >= 1200 AS over_tokens, seen >= 2 AS repeated, coalesce(repos_before, 0) > 10 AS over_repos, coalesce(files_before, 0) > 18 AS over_files FROM u")
def usage_flags(spark, sf):
    return t.usage_flags(calls(spark, sf), LIMITS)


# The guardrails as the fold they are defined by, one call per step.
FOLD = CALLS + """, numbered AS (SELECT *, tool || '|' || args AS sig, row_number() OVER (PARTITION BY session ORDER BY seq) AS rn FROM c),
fold AS (
  SELECT session, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS trigger, 0 AS calls_before, CAST(0 AS BIGINT) AS tokens_before,
         0 AS calls_after, CAST(0 AS BIGINT) AS tokens_after, CAST([] AS VARCHAR[]) AS sigs, CAST([] AS VARCHAR[]) AS repos, CAST([] AS VARCHAR[]) AS files
  FROM (SELECT DISTINCT session FROM c)
  UNION ALL
  SELECT session, rn, seq, trigger, calls_before, tokens_before,
         calls_before + CASE WHEN trigger IS NULL THEN 1 ELSE 0 END, tokens_before + CASE WHEN trigger IS NULL THEN result_tokens ELSE 0 END,
         CASE WHEN trigger IS NULL THEN list_append(sigs, sig) ELSE sigs END,
         CASE WHEN trigger IS NULL THEN list_distinct(list_append(repos, repo_ref)) ELSE repos END,
         CASE WHEN trigger IS NULL THEN list_distinct(list_append(files, file_ref)) ELSE files END
  FROM (SELECT n.session, n.rn, n.seq, n.sig, n.repo_ref, n.file_ref, n.result_tokens, f.calls_after AS calls_before, f.tokens_after AS tokens_before, f.sigs, f.repos, f.files,
    CASE WHEN f.calls_after >= 22 THEN 'max_tool_calls' WHEN f.tokens_after >= 1200 THEN 'token_budget_exceeded'
         WHEN len(list_filter(f.sigs, lambda x: x = n.sig)) >= 2 THEN 'cycle_detected'
         WHEN len(f.repos) > 10 THEN 'blast_radius_repos' WHEN len(f.files) > 18 THEN 'blast_radius_files' END AS trigger
    FROM fold f JOIN numbered n ON n.session = f.session AND n.rn = f.rn + 1)
), d AS (SELECT f.session, f.seq, f.trigger, f.calls_before, f.tokens_before, c.tool, c.result_tokens, c.duration_ms, c.repo_ref, c.file_ref FROM fold f JOIN c USING (session, seq) WHERE f.rn > 0)
"""


@BOOK.query(FOLD + "SELECT session, seq, trigger, calls_before, tokens_before FROM d")
def guardrail_decisions(spark, sf):
    return t.decisions(calls(spark, sf), LIMITS).select("session", "seq", "trigger", "calls_before", "tokens_before")


@BOOK.query(FOLD + """SELECT session, count(*) AS total_tool_calls, CAST(sum(result_tokens) AS BIGINT) AS approx_tokens_used, round(sum(duration_ms), 4) AS total_tool_latency_ms,
string_agg(tool, ',' ORDER BY seq) AS tool_sequence, count(DISTINCT repo_ref) AS repos_touched, count(DISTINCT file_ref) AS files_touched,
round(sum(result_tokens) / 1200 * 100, 1) AS budget_utilization_pct FROM d WHERE trigger IS NULL GROUP BY session""")
def telemetry(spark, sf):
    return t.telemetry(t.decisions(calls(spark, sf), LIMITS), LIMITS).withColumn("total_tool_latency_ms", F.round("total_tool_latency_ms", 4))


@BOOK.query(FOLD + """SELECT session, trigger, count(*) AS blocked, min(seq) AS first_seq, arg_min(calls_before, seq) AS calls_at_first, arg_min(tokens_before, seq) AS tokens_at_first
FROM d WHERE trigger IS NOT NULL GROUP BY ALL""")
def safety_report(spark, sf):
    return t.safety_report(t.decisions(calls(spark, sf), LIMITS))


@BOOK.query(FOLD + """SELECT session, count(*) FILTER (trigger IS NULL) AS tool_calls_used, CAST(coalesce(sum(result_tokens) FILTER (trigger IS NULL), 0) AS BIGINT) AS tokens_used,
count(*) FILTER (trigger IS NOT NULL) AS trigger_count, bool_and(trigger IS NULL) AS all_clear FROM d GROUP BY session""")
def safety_summary(spark, sf):
    return t.safety_summary(t.decisions(calls(spark, sf), LIMITS))


# --- conversation memory ----------------------------------------------------

N, TOKENS = 4, 200


def messages(spark, sf):
    return views.view(spark, sf, views.MESSAGES)


@BOOK.query("SELECT conv_id AS session, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def last_messages(spark, sf):
    return m.last_messages(messages(spark, sf), N)


@BOOK.query("""SELECT conv_id AS session, turn, 'Truncated 1 messages. Content: [' || role || ']: ' || left(text, 200) AS text
FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 4""")
def dropped_summaries(spark, sf):
    return m.dropped_summaries(messages(spark, sf), N)


MEMORY = """WITH RECURSIVE msg AS (SELECT conv_id AS session, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
fold AS (
  SELECT session, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS turn, CAST([] AS STRUCT(turn BIGINT, role VARCHAR, text VARCHAR)[]) AS kept, CAST(0 AS BIGINT) AS tokens, CAST([] AS VARCHAR[]) AS made
  FROM (SELECT DISTINCT session FROM msg)
  UNION ALL
  SELECT session, rn, turn, CASE WHEN keep IS NULL THEN slid ELSE slid[len(slid) - keep + 1:] END,
         CASE WHEN keep IS NULL THEN tokens ELSE list_sum(list_transform(slid[len(slid) - keep + 1:], lambda x: length(x.text) // 4)) END,
         list_concat(CASE WHEN excess > 0 THEN ['Truncated ' || excess || ' messages. Content: ' || array_to_string(list_transform(grown[:excess], lambda x: '[' || x.role || ']: ' || left(x.text, 200)), ' | ')] ELSE [] END,
                     CASE WHEN keep IS NOT NULL THEN ['Compacted ' || (len(slid) - keep) || ' messages due to token budget. ' || array_to_string(list_transform(slid[:len(slid) - keep], lambda x: '[' || x.role || ']: ' || left(x.text, 150)), ' | ')] ELSE [] END)
  FROM (SELECT *, CASE WHEN tokens > 200 AND len(slid) > 1 THEN greatest(1, least(2, len(slid) // 2)) END AS keep
    FROM (SELECT *, greatest(len(grown) - 4, 0) AS excess, grown[greatest(len(grown) - 4, 0) + 1:] AS slid
      FROM (SELECT m.session, m.rn, m.turn, list_append(f.kept, {'turn': m.turn, 'role': m.role, 'text': m.text}) AS grown, f.tokens + length(m.text) // 4 AS tokens
        FROM fold f JOIN msg m ON m.session = f.session AND m.rn = f.rn + 1)))
), last AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY session ORDER BY rn DESC) = 1),
memory AS (SELECT session, 'summary' AS kind, turn, CAST(NULL AS VARCHAR) AS role, unnest(made) AS text, CAST(NULL AS BIGINT) AS tokens, generate_subscripts(made, 1) - 1 AS step FROM fold
UNION ALL SELECT session, 'window', k.turn, k.role, k.text, NULL, 0 FROM (SELECT session, unnest(kept) AS k FROM last)
UNION ALL SELECT session, 'counter', turn, NULL, NULL, tokens, 0 FROM last)
"""


@BOOK.query(MEMORY + "SELECT * FROM memory")
def compacted_memory(spark, sf):
    return m.compact(messages(spark, sf), N, TOKENS)


@BOOK.query(MEMORY + """SELECT session, 0 AS part, turn AS ord, step, 'user' AS role, CASE WHEN row_number() OVER (PARTITION BY session ORDER BY turn, step) = 1 THEN '[Prior conversation summary]: ' ELSE '' END || text AS text FROM memory WHERE kind = 'summary'
UNION ALL SELECT session, 1, turn, step, role, text FROM memory WHERE kind = 'window'""")
def context_messages(spark, sf):
    return m.context_messages(m.compact(messages(spark, sf), N, TOKENS))


@BOOK.query(MEMORY + """SELECT session, any_value(s.turn_count) AS turn_count, any_value(s.a) AS created_at, any_value(s.b) AS last_active,
count(*) FILTER (kind = 'window') AS message_count, max(tokens) AS approx_tokens FROM memory JOIN (SELECT session, count(*) AS turn_count, min(turn) AS a, max(turn) AS b FROM msg GROUP BY 1) s USING (session) GROUP BY session""")
def session_listing(spark, sf):
    msgs = messages(spark, sf)
    return m.session_listing(msgs, m.compact(msgs, N, TOKENS))
