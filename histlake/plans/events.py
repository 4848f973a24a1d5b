"""Queries on logs: turns, threads, statuses, conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from histlake.functions import constants as C
from histlake.functions.text import ASCII_BLANK, asset_types, event_category, event_status, normalize_text, semantic_projection, truncate
from histlake.operators import conversation, ingest, lineage, relations
from histlake.operators.stats import greedy_batches, token_cost, usage_totals
from histlake.plans.projection import MESSAGES_SQL, RUNS_SQL, THREADS_SQL, messages, runs, threads, with_
from histlake.plans.registry import query
from histlake.sources import read_table


def message_turns(spark, sf):
    rows = messages(spark, sf)
    user = F.col("role") == "user"
    return ingest.segment_turns(rows, started=user, ended=F.lit(False), speaks=user | (F.col("role") == "assistant"), reference=F.lit(None).cast("string"))


TURNS_SQL = f"""{MESSAGES_SQL},
opened AS (SELECT *, (role = 'user' OR (role = 'assistant' AND coalesce(count(CASE WHEN role IN ('user','assistant') THEN 1 END)
   OVER (PARTITION BY thread_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0))::INT AS op FROM messages),
turns AS (SELECT thread_id, line_no, role, text,
   CASE WHEN sum(op) OVER w > 0 THEN (sum(op) OVER w - 1)::BIGINT END AS turn_seq FROM opened WINDOW w AS (PARTITION BY thread_id ORDER BY line_no))"""


@query("turn_segmentation", f"WITH {TURNS_SQL} SELECT thread_id, line_no, role, turn_seq FROM turns")
def turn_segmentation(spark, sf):
    return message_turns(spark, sf).select("thread_id", "line_no", "role", "turn_seq")


@query(
    "turn_rollup",
    f"""WITH {TURNS_SQL},
said AS (SELECT *, lag(text) OVER (PARTITION BY thread_id, turn_seq, role ORDER BY line_no) AS prior FROM turns WHERE turn_seq IS NOT NULL AND text <> ''),
texts AS (SELECT thread_id, turn_seq, string_agg(CASE WHEN role = 'user' THEN text END, chr(10) || chr(10) ORDER BY line_no) AS u,
   string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10) || chr(10) ORDER BY line_no) AS a FROM said WHERE prior IS NULL OR prior <> text GROUP BY ALL)
SELECT t.thread_id, t.turn_seq, count(*) AS event_count, count(*) FILTER (WHERE role = 'user') AS user_count,
   count(*) FILTER (WHERE role = 'assistant') AS assistant_count, min(line_no) AS first_line, max(line_no) AS last_line,
   sha256(array_to_string(list(sha256(text) ORDER BY line_no), chr(31))) AS digest, coalesce(any_value(u), '') AS user_text, coalesce(any_value(a), '') AS assistant_text
FROM turns t LEFT JOIN texts x ON t.thread_id = x.thread_id AND t.turn_seq = x.turn_seq WHERE t.turn_seq IS NOT NULL GROUP BY t.thread_id, t.turn_seq""",
)
def turn_rollup(spark, sf):
    return ingest.roll_up_turns(message_turns(spark, sf))


@query(
    "turn_text_dedup_join",
    with_(MESSAGES_SQL)
    + """, x AS (SELECT *, lag(text) OVER (PARTITION BY thread_id, role ORDER BY line_no) AS prior FROM messages WHERE text <> '')
SELECT thread_id, role, line_no, length(text)::BIGINT AS n_chars FROM x WHERE prior IS NULL OR prior <> text""",
)
def turn_text_dedup_join(spark, sf):
    rows = ingest.drop_consecutive(messages(spark, sf), "text", ["thread_id", "role"], ["line_no"])
    return rows.select("thread_id", "role", "line_no", F.length("text").cast("long").alias("n_chars"))


@query(
    "thread_stats",
    with_(RUNS_SQL)
    + """SELECT thread_id, count(*) AS event_count, 0::BIGINT AS user_count, count(*) FILTER (WHERE role = 'assistant') AS assistant_count,
 count(*) FILTER (WHERE role = 'tool_call') AS tool_call_count, count(*) FILTER (WHERE role = 'tool_output') AS tool_output_count, 0::BIGINT AS goal_count,
 min(event_id) AS first_line, max(event_id) AS last_line FROM runs GROUP BY thread_id""",
)
def thread_stats(spark, sf):
    return ingest.thread_stats(runs(spark, sf).withColumnRenamed("event_id", "line_no"))


RUN_TURNS_SQL = f"""{RUNS_SQL},
a AS (SELECT *, event_type = 'signup' AS st, event_type = 'purchase' AS en, (event_type = 'signup' OR role IN ('assistant','tool_call','tool_output')) AS may FROM runs),
b AS (SELECT *, coalesce(sum(en::INT) OVER (PARTITION BY thread_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM a),
c AS (SELECT *, (st OR (may AND coalesce(sum(may::INT) OVER (PARTITION BY thread_id, seg ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0))::INT AS op FROM b),
d AS (SELECT *, sum(op) OVER (PARTITION BY thread_id, seg ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inseg,
   sum(op) OVER (PARTITION BY thread_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n,
   last_value(CASE WHEN st THEN event_id::VARCHAR END IGNORE NULLS) OVER (PARTITION BY thread_id, seg ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS src FROM c)"""


def run_turns(spark, sf):
    speaks = F.col("role").isin("assistant", "tool_call", "tool_output")
    reference = F.when(F.col("event_type") == "signup", F.col("event_id").cast("string"))
    return ingest.segment_turns(
        runs(spark, sf), started=F.col("payload_type") == "task_started", ended=F.col("payload_type") == "task_complete", speaks=speaks, reference=reference, order=["ts", "event_id"]
    )


@query("event_state_machine", f"WITH {RUN_TURNS_SQL} SELECT event_id, thread_id, CASE WHEN inseg > 0 THEN (n - 1)::BIGINT END AS turn_seq, CASE WHEN inseg > 0 THEN coalesce(src, (n - 1)::BIGINT::VARCHAR) END AS source_turn FROM d")
def event_state_machine(spark, sf):
    return run_turns(spark, sf).select("event_id", "thread_id", "turn_seq", "source_turn")


@query(
    "content_occurrence_ordinal",
    with_(RUNS_SQL) + "SELECT event_id, (row_number() OVER (PARTITION BY thread_id, sha256(event_type) ORDER BY event_id) - 1)::BIGINT AS occurrence FROM runs",
)
def content_occurrence_ordinal(spark, sf):
    rows = runs(spark, sf).select("thread_id", F.sha2("event_type", 256).alias("content_sha"), F.col("event_id").alias("line_no"))
    return ingest.event_ids(rows).select(F.col("line_no").alias("event_id"), "occurrence")


FAIL = r"(^|[^A-Za-z0-9_])(error|failed|failure|exception|traceback|exit code [1-9]|timed out|timeout|blocked)([^A-Za-z0-9_]|$)"


def classified(spark, sf):
    """Documents as events: goals, calls, outputs, reports and statements by id; some texts get a word of status."""
    words = F.element_at(F.array(*[F.lit(w) for w in STATUS_WORDS]), (F.col("doc_id") % len(STATUS_WORDS) + 1).cast("int"))
    role = F.element_at(F.array(*[F.lit(r) for r in ("user", "assistant", "tool_call", "tool_output", "goal")]), (F.floor(F.col("doc_id") / 2) % 5 + 1).cast("int"))
    return read_table(spark, sf, "documents").select("doc_id", role.alias("role"), F.concat_ws(" ", words, F.col("text")).alias("text"))


STATUS_WORDS = ("0 failed, 5 passed.", "exit code 0.", "Goal [complete]:", "Goal [blocked]:", "we decided:", "it must be so:", "todo:", "plain words,", "build succeeded.")
CLASSIFIED_SQL = (
    "classified AS (SELECT doc_id, ['user','assistant','tool_call','tool_output','goal'][(doc_id // 2) % 5 + 1] AS role, ["
    + ",".join(f"'{w}'" for w in STATUS_WORDS)
    + f"][doc_id % {len(STATUS_WORDS)} + 1] || ' ' || text AS text FROM documents)"
)


@query(
    "status_classifier",
    with_(CLASSIFIED_SQL)
    + rf""", x AS (SELECT *, lower(text) AS low, regexp_matches(text, '(?i){FAIL}') AS bad,
 regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])([1-9][0-9]* passed|exit code 0|tests? passed|build succeeded|verified)([^A-Za-z0-9_]|$)') AS good FROM classified)
SELECT doc_id, role, CASE role WHEN 'user' THEN 'user_intent' WHEN 'assistant' THEN 'assistant_response' WHEN 'goal' THEN 'goal_state' ELSE role END AS category,
 CASE WHEN role = 'goal' THEN CASE WHEN contains(low, '[complete]') OR contains(low, '[completed]') THEN 'goal_complete' WHEN contains(low, '[failed]') THEN 'failed' WHEN contains(low, '[blocked]') THEN 'blocked' ELSE 'active' END
  WHEN role = 'tool_call' THEN 'executed' WHEN role = 'tool_output' THEN CASE WHEN bad THEN 'failed' WHEN good THEN 'verified' ELSE 'executed' END
  WHEN role = 'assistant' THEN 'reported_outcome' ELSE 'stated_intent' END AS status,
 CASE WHEN role = 'goal' THEN CASE WHEN contains(low, '[complete]') OR contains(low, '[completed]') THEN 'executed' WHEN contains(low, '[failed]') THEN 'failed' WHEN contains(low, '[blocked]') THEN 'blocked' ELSE 'planned' END
  WHEN role = 'tool_call' THEN 'executed' WHEN role = 'tool_output' THEN CASE WHEN bad THEN 'failed' WHEN good THEN 'verified' ELSE 'executed' END
  WHEN role = 'assistant' THEN 'mixed' ELSE 'planned' END AS status_group FROM x""",
)
def status_classifier(spark, sf):
    rows = classified(spark, sf).withColumn("s", event_status("role", "text"))
    return rows.select("doc_id", "role", event_category("role").alias("category"), "s.status", "s.status_group")


@query(
    "asset_classifier",
    with_(CLASSIFIED_SQL)
    + rf""", x AS (SELECT *, lower(text) AS low FROM classified), y AS (SELECT doc_id, unnest(list_filter([
 CASE WHEN role = 'user' AND regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(prefer|must|should not|require)([^A-Za-z0-9_]|$)') THEN 'preferences' END,
 CASE WHEN role = 'user' AND regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(decided|choose|adopt|selected)([^A-Za-z0-9_]|$)') THEN 'decisions' END,
 CASE WHEN role = 'user' AND regexp_matches(text, '(?i){FAIL}') THEN 'failures' END,
 CASE WHEN (role = 'user' AND regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(todo|pending|unresolved|uncertain|planned)([^A-Za-z0-9_]|$)'))
  OR (role = 'goal' AND NOT contains(low, '[complete]') AND NOT contains(low, '[completed]')) THEN 'unresolved' END], lambda k: k IS NOT NULL)) AS asset_type FROM x)
SELECT doc_id, asset_type FROM y""",
)
def asset_classifier(spark, sf):
    return classified(spark, sf).select("doc_id", F.explode(asset_types("role", "text")).alias("asset_type"))


NORM = r"trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')"


@query("truncate_text", f"SELECT doc_id, CASE WHEN length(n) <= 200 THEN n ELSE rtrim(left(n, 197), ' ') || '...' END AS short FROM (SELECT doc_id, {NORM} AS n FROM documents)")
def truncate_text(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", truncate("text", 200, blank=ASCII_BLANK).alias("short"))


@query(
    "semantic_projection",
    """SELECT doc_id, md5(CASE WHEN length(text) <= 3900 THEN text ELSE text[1:1530] || chr(10) || '[semantic projection: middle sample]' || chr(10)
 || text[greatest(0, length(text) // 2 - 478) + 1 : greatest(0, length(text) // 2 - 478) + 956] || chr(10) || '[semantic projection: tail sample]' || chr(10) || right(text, 1340) END) AS projected FROM documents""",
)
def semantic_projection_q(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.md5(semantic_projection("text").cast("binary")).alias("projected"))


@query(
    "relations_call_asof",
    with_(RUNS_SQL)
    + """, x AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY thread_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM runs)
SELECT event_id AS source, 'validates' AS relation, c AS target FROM x WHERE event_type = 'error' AND c IS NOT NULL""",
)
def relations_call_asof(spark, sf):
    return relations.validates_calls(runs(spark, sf), call=F.col("event_type") == "click", verified=F.col("event_type") == "error", partition=["thread_id"], order=["ts", "event_id"], key="event_id")


@query(
    "relations_goal_asof",
    with_(RUNS_SQL)
    + """, x AS (SELECT *, json_extract_string(props, '$.k') AS k FROM runs),
y AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY thread_id, k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM x)
SELECT event_id AS source, 'validates' AS relation, c AS target FROM y WHERE event_type = 'purchase' AND c IS NOT NULL""",
)
def relations_goal_asof(spark, sf):
    rows = runs(spark, sf).withColumn("k", F.get_json_object("props", "$.k"))
    return relations.completes_goals(rows, active=F.col("event_type") == "signup", complete=F.col("event_type") == "purchase", partition=["thread_id", "k"], order=["ts", "event_id"], key="event_id")


@query(
    "relations_incident",
    with_(RUNS_SQL)
    + """, x AS (SELECT event_id AS source, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY thread_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target, event_type FROM runs),
r AS (SELECT source, target FROM x WHERE event_type = 'error' AND target IS NOT NULL), m AS (SELECT min(target) AS id FROM r)
SELECT 'outgoing' AS direction, 'validates' AS relation, target AS other FROM r, m WHERE source = id
UNION ALL SELECT 'incoming', 'validates', source FROM r, m WHERE target = id""",
)
def relations_incident(spark, sf):
    edges = relations_call_asof(spark, sf)
    return relations.incident(edges, edges.agg(F.min("target")).first()[0] or -1)


@query(
    "family_components",
    with_(THREADS_SQL).replace("WITH ", "WITH RECURSIVE ")
    + """, e AS (SELECT t.thread_id AS a, p.thread_id AS b FROM threads t JOIN threads p ON t.parent_id = p.thread_id),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT thread_id AS node, thread_id AS root FROM threads UNION SELECT g.b, reach.root FROM reach JOIN g ON reach.node = g.a),
c AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT root AS family_root, count(*) AS member_count, string_agg(node::VARCHAR, ',' ORDER BY first_at, node) AS members, min(first_at) AS first_at
FROM c JOIN threads ON node = thread_id GROUP BY root HAVING count(*) >= 2""",
)
def family_components(spark, sf):
    rows = threads(spark, sf)
    known = rows.select(F.col("thread_id").alias("parent"))
    edges = rows.where("parent_id is not null").select(F.col("thread_id").alias("child"), F.col("parent_id").alias("parent")).join(known, "parent", "left_semi").select("child", "parent")
    return lineage.families(rows, edges)


@query(
    "dual_write_suppression",
    with_(MESSAGES_SQL)
    + """, d AS (SELECT thread_id, line_no, role, text, false AS pref FROM messages UNION ALL SELECT thread_id, line_no + 1000000, role, text, true FROM messages WHERE line_no % 2 = 0),
x AS (SELECT *, row_number() OVER (PARTITION BY thread_id, role, text, pref ORDER BY line_no) AS n, sum(pref::INT) OVER (PARTITION BY thread_id, role, text) AS kept FROM d)
SELECT thread_id, line_no, NOT pref AND n <= kept AS suppressed FROM x""",
)
def dual_write_suppression(spark, sf):
    rows = messages(spark, sf)
    twice = rows.withColumn("pref", F.lit(False)).union(rows.where("line_no % 2 = 0").withColumn("line_no", F.col("line_no") + 1_000_000).withColumn("pref", F.lit(True)))
    out = conversation.suppress_twice_recorded(twice, preferred=F.col("pref"), key=["thread_id", "role", "text"], order=["line_no"])
    return out.select("thread_id", "line_no", "suppressed")


@query("conversation_export", f"WITH {TURNS_SQL} SELECT thread_id, line_no, turn_seq + 1 AS turn_no, role, text FROM turns WHERE turn_seq + 1 BETWEEN 1 AND 3 AND role IN ('user', 'assistant')")
def conversation_export(spark, sf):
    rows = message_turns(spark, sf).withColumn("turn_no", F.col("turn_seq") + 1)
    return conversation.export(rows, turns="1:3").select("thread_id", "line_no", "turn_no", "role", "text")


@query(
    "conversation_document",
    f"""WITH {TURNS_SQL} SELECT thread_id, count(*) AS n_messages, md5(string_agg(role || ':' || text, chr(31) ORDER BY line_no)) AS digest FROM turns WHERE role IN ('user', 'assistant') GROUP BY thread_id""",
)
def conversation_document(spark, sf):
    rows = conversation.export(message_turns(spark, sf).withColumn("turn_no", F.col("turn_seq") + 1))
    item = F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.concat_ws(":", "role", "text").alias("t")))), lambda x: x["t"])
    return rows.groupBy("thread_id").agg(F.count("*").alias("n_messages"), F.md5(F.array_join(item, "\u001f").cast("binary")).alias("digest"))


@query(
    "thread_resolution",
    with_(THREADS_SQL)
    + """, s AS (SELECT unnest(['3', 'thread 7', 'READ 1', 'nothing here']) AS selector),
h AS (SELECT selector, thread_id, CASE WHEN thread_id::VARCHAR = selector THEN 0 WHEN lower(title) = lower(selector) THEN 1 WHEN contains(lower(title), lower(selector)) OR contains(thread_id::VARCHAR, lower(selector)) THEN 2 END AS level FROM threads, s)
SELECT selector, thread_id, level FROM h WHERE level IS NOT NULL QUALIFY level = min(level) OVER (PARTITION BY selector)""",
)
def thread_resolution(spark, sf):
    return conversation.resolve(threads(spark, sf), ["3", "thread 7", "READ 1", "nothing here"])


@query("thread_list", with_(THREADS_SQL) + "SELECT thread_id, title, first_at FROM threads WHERE contains(lower(title), 'thread') AND contains(lower(title), '1') ORDER BY first_at DESC, title, thread_id LIMIT 15")
def thread_list(spark, sf):
    rows = threads(spark, sf).withColumnRenamed("first_at", "last_at")
    return conversation.list_threads(rows, "thread 1", 15).select("thread_id", "title", F.col("last_at").alias("first_at"))


@query(
    "internal_context",
    with_(MESSAGES_SQL, "marked AS (SELECT thread_id, line_no, ltrim(CASE WHEN role = 'system' THEN '  <skills_instructions>' || text ELSE text END, ' ') AS t FROM messages)")
    + "SELECT thread_id, line_no, " + " OR ".join(f"starts_with(t, '{tag}')" for tag in C.INTERNAL_CONTEXT) + " AS internal FROM marked",
)
def internal_context(spark, sf):
    marked = messages(spark, sf).withColumn("text", F.when(F.col("role") == "system", F.concat(F.lit("  <skills_instructions>"), F.col("text"))).otherwise(F.col("text")))
    return marked.select("thread_id", "line_no", conversation.is_internal(F.col("text")).alias("internal"))


@query(
    "retrieval_echo",
    f"""WITH {RUN_TURNS_SQL}, t AS (SELECT *, CASE WHEN inseg > 0 THEN n - 1 END AS turn_seq, CASE WHEN role IN ('tool_call','tool_output') THEN json_extract_string(props, '$.k')::INT % 10 END AS call_id FROM d),
x AS (SELECT *, call_id IN (0, 1) AND role = 'tool_call' AS asks FROM t),
ids AS (SELECT DISTINCT thread_id, turn_seq, call_id FROM x WHERE asks),
y AS (SELECT x.*, i.call_id IS NOT NULL AS mine FROM x LEFT JOIN ids i ON x.thread_id = i.thread_id AND x.turn_seq IS NOT DISTINCT FROM i.turn_seq AND x.call_id = i.call_id)
SELECT thread_id, turn_seq::BIGINT AS turn_seq, count(*) FILTER (WHERE role = 'tool_call' AND NOT mine) = 0 AS pure, count(*) FILTER (WHERE mine) AS n_events FROM y GROUP BY thread_id, turn_seq HAVING count(*) FILTER (WHERE mine) > 0""",
)
def retrieval_echo(spark, sf):
    call = F.when(F.col("role").isin("tool_call", "tool_output"), (F.get_json_object("props", "$.k").cast("int") % 10).cast("string"))
    text = F.when((F.col("role") == "tool_call") & call.isin("0", "1"), F.lit("python lookup.py search words")).otherwise(F.col("event_type"))
    rows = run_turns(spark, sf).select("thread_id", "turn_seq", "role", F.col("event_id").alias("line_no"), call.alias("call_id"), text.alias("text"))
    found = conversation.retrieval_echo(rows, call_patterns=(r"lookup\.py\s+(search|context|trace)\b",), output_marks=("# Linked knowledge",))
    return found.select("thread_id", "turn_seq", "pure", F.size("events").cast("long").alias("n_events"))


@query(
    "usage_ledger",
    """SELECT event_type AS kind, count(*) AS calls, count(*) FILTER (WHERE event_id % 3 = 0) AS cache_hits, count(*) FILTER (WHERE event_id % 5 = 0) AS failures,
 sum(event_id % 100)::BIGINT AS input_tokens, sum(event_id % 40)::BIGINT AS cached_input_tokens, sum(event_id % 60)::BIGINT AS output_tokens FROM events GROUP BY event_type""",
)
def usage_ledger(spark, sf):
    e = F.col("event_id")
    ledger = read_table(spark, sf, "events").select(
        F.col("event_type").alias("kind"), (e % 3 == 0).alias("cache_hit"), F.when(e % 5 == 0, "failed").otherwise("ok").alias("status"),
        (e % 100).alias("input_tokens"), (e % 40).alias("cached_input_tokens"), (e % 60).alias("output_tokens"),
    )
    return usage_totals(ledger, ["kind"])


@query("usage_cost", "SELECT event_id, round(((event_id % 100) * 10.0::DOUBLE + (event_id % 40) * 2.0::DOUBLE + (event_id % 60) * 20.0::DOUBLE) / 1000000, 9) AS cost FROM events")
def usage_cost(spark, sf):
    e = F.col("event_id")
    return read_table(spark, sf, "events").select("event_id", F.round(token_cost(e % 100, e % 40, e % 60, (10.0, 2.0, 20.0)), 9).alias("cost"))


@query(
    "greedy_batches",
    f"""WITH RECURSIVE {MESSAGES_SQL},
o AS (SELECT thread_id, line_no, length(text) AS n, row_number() OVER (PARTITION BY thread_id ORDER BY line_no) AS k FROM messages),
b AS (SELECT thread_id, line_no, k, n AS used, 0::BIGINT AS batch FROM o WHERE k = 1
  UNION ALL SELECT o.thread_id, o.line_no, o.k, CASE WHEN b.used + o.n > 600 THEN o.n ELSE b.used + o.n END, b.batch + (b.used + o.n > 600)::BIGINT FROM b JOIN o ON o.thread_id = b.thread_id AND o.k = b.k + 1)
SELECT thread_id, line_no, batch FROM b""",
)
def greedy_batches_q(spark, sf):
    rows = messages(spark, sf).withColumn("n", F.length("text"))
    return greedy_batches(rows, group="thread_id", order="line_no", size="n", limit=600)


@query(
    "session_gaps",
    with_(RUNS_SQL)
    + """, x AS (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY thread_id ORDER BY ts, event_id) + INTERVAL 6 HOURS, true)::INT AS fresh FROM runs)
SELECT event_id, (sum(fresh) OVER (PARTITION BY thread_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS session_no FROM x""",
)
def session_gaps(spark, sf):
    by = Window.partitionBy("thread_id").orderBy("ts", "event_id")
    rows = runs(spark, sf).withColumn("fresh", F.coalesce(F.col("ts") > F.lag("ts").over(by) + F.expr("interval 6 hours"), F.lit(True)).cast("int"))
    return rows.select("event_id", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("session_no"))


@query(
    "event_key_counts",
    "SELECT json_extract_string(props, '$.k')::BIGINT AS k, event_type, count(*) AS n FROM events GROUP BY ALL",
)
def event_key_counts(spark, sf):
    return read_table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type").agg(F.count("*").alias("n"))


@query("normalized_text", f"SELECT doc_id, sha256({NORM}) AS sha FROM documents")
def normalized_text(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.sha2(normalize_text("text", ASCII_BLANK), 256).alias("sha"))
