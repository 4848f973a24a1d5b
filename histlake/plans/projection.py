"""The driver's tables seen as the domain's: messages, runs, knowledge, evidence, vectors.

Each projection comes twice, as DataFrame and as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histlake.functions import constants as C
from histlake.functions.text import ASCII_BLANK, normalize_text
from histlake.sources import read_table

EPOCH = "2024-01-01 00:00:00"
INDEXED = "2024-06-01 00:00:00"


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("line_no"), "role", "text")


MESSAGES_SQL = "messages AS (SELECT conv_id AS thread_id, turn AS line_no, role, text FROM conversations)"

RUN_ROLES = {"signup": "event", "purchase": "event", "click": "tool_call", "error": "tool_output", "view": "assistant"}
RUN_KINDS = {"signup": "task_started", "purchase": "task_complete", "click": "function_call", "error": "function_call_output", "view": "agent_message"}


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as runs of an agent: thread per user, in order of (ts, event_id)."""
    pick = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("event_type")]
    rows = read_table(spark, sf, "events").select(F.col("user_id").alias("thread_id"), "ts", "event_id", "event_type", "value", "props")
    return rows.withColumns({"role": F.coalesce(pick(RUN_ROLES), F.lit("event")), "payload_type": F.coalesce(pick(RUN_KINDS), F.lit("other"))})


RUNS_SQL = """runs AS (SELECT user_id AS thread_id, ts, event_id, event_type, value, props,
  CASE event_type WHEN 'click' THEN 'tool_call' WHEN 'error' THEN 'tool_output' WHEN 'view' THEN 'assistant' ELSE 'event' END AS role
  FROM events)"""


def threads(spark: SparkSession, sf: str) -> DataFrame:
    """One row per conversation; the parent is the one before, but for every third."""
    ids = read_table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("thread_id")).agg(F.count("*").alias("n_messages"))
    parent = F.when(F.col("thread_id") % 3 != 0, F.col("thread_id") - 1)
    return ids.select("thread_id", F.concat(F.lit("Thread "), F.col("thread_id")).alias("title"), "n_messages", parent.alias("parent_id"), (F.col("thread_id") % 7).alias("first_at"))


THREADS_SQL = """threads AS (SELECT conv_id AS thread_id, 'Thread ' || conv_id AS title, count(*) AS n_messages,
  CASE WHEN conv_id % 3 <> 0 THEN conv_id - 1 END AS parent_id, conv_id % 7 AS first_at FROM conversations GROUP BY conv_id)"""


def knowledge(spark: SparkSession, sf: str, *, merge: bool = False) -> DataFrame:
    """``merge``: labels are joined by a merge at every size, so that what it costs follows the input."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    labels = read_table(spark, sf, "labels")
    labels = labels.hint("merge") if merge else labels
    tier = F.element_at(F.array(*[F.lit(t) for t in C.ALL_TIERS]), (F.col("doc_id") % 5 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(t) for t in C.ASSET_TYPES]), (F.floor(F.col("doc_id") / 5) % 5 + 1).cast("int"))
    start = F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("doc_id").cast("int"), F.lit(0), F.lit(0))
    hours = lambda n: F.expr(f"interval {n} hours")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("record_id"),
        F.col("source").alias("scope_id"),
        F.concat(F.lit("Scope "), F.col("source")).alias("scope_title"),
        tier.alias("tier"),
        F.when(F.col("doc_id") % 5 == 0, kind).otherwise(F.lit("")).alias("asset_type"),
        F.col("lang").alias("category"),
        F.lit("").alias("theme"),
        "text",
        F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "failed").otherwise("uncertain").alias("status_group"),
        (F.col("doc_id") % 7).alias("evidence_count"),
        start.alias("occurred_start"),
        (start + hours(6)).alias("occurred_end"),
        F.when(F.col("doc_id") % 4 != 0, start + hours(24)).alias("asserted_at"),
        F.lit(INDEXED).cast("timestamp_ntz").alias("indexed_at"),
        start.alias("valid_from"),
        F.when(F.col("toxic") == 1, start + hours(720)).alias("valid_to"),
        F.when(F.col("doc_id") % 9 == 0, "scope_range").otherwise("exact_turn_range").alias("temporal_confidence"),
        (F.col("doc_id") % 11 != 0).alias("retrieval_eligible"),
        F.when(F.col("doc_id") % 7 == 0, C.OUTDATED_CLASSIFIER).alias("derived_by"),
    )


KNOWLEDGE_SQL = """knowledge AS (SELECT d.doc_id::VARCHAR AS record_id, d.source AS scope_id, 'Scope ' || d.source AS scope_title,
  CASE d.doc_id % 5 WHEN 0 THEN 'asset' WHEN 1 THEN 'overview' WHEN 2 THEN 'ledger' WHEN 3 THEN 'fact_block' ELSE 'core' END AS tier,
  CASE WHEN d.doc_id % 5 <> 0 THEN '' ELSE CASE (d.doc_id // 5) % 5 WHEN 0 THEN 'decisions' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'failures' WHEN 3 THEN 'capabilities' ELSE 'preferences' END END AS asset_type,
  d.lang AS category, '' AS theme, d.text,
  CASE WHEN quality = 1 THEN 'verified' WHEN quality = 0 THEN 'failed' ELSE 'uncertain' END AS status_group,
  d.doc_id % 7 AS evidence_count,
  TIMESTAMP '2024-01-01' + to_hours(d.doc_id) AS occurred_start, TIMESTAMP '2024-01-01' + to_hours(d.doc_id + 6) AS occurred_end,
  CASE WHEN d.doc_id % 4 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(d.doc_id + 24) END AS asserted_at,
  TIMESTAMP '2024-06-01' AS indexed_at, TIMESTAMP '2024-01-01' + to_hours(d.doc_id) AS valid_from,
  CASE WHEN toxic = 1 THEN TIMESTAMP '2024-01-01' + to_hours(d.doc_id + 720) END AS valid_to,
  CASE WHEN d.doc_id % 9 = 0 THEN 'scope_range' ELSE 'exact_turn_range' END AS temporal_confidence,
  d.doc_id % 11 <> 0 AND NOT (d.doc_id % 5 = 0 AND d.doc_id % 7 = 0) AS retrieval_eligible
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence: distinct normalized texts by language; one occurrence per document."""
    norm = normalize_text("text", ASCII_BLANK)
    ident = F.concat(F.lit("evidence-"), F.substring(F.sha2(F.concat_ws("\u001f", norm, "lang"), 256), 1, 24))
    return read_table(spark, sf, "documents").select(
        ident.alias("evidence_id"), F.col("doc_id").alias("occurrence_id"), (F.col("doc_id") % 97).alias("thread_id"), F.col("source").alias("scope_id"),
        F.col("doc_id").alias("position"), F.col("doc_id").alias("at"), F.col("doc_id").cast("string").alias("record_id"),
    )


OCCURRENCES_SQL = r"""occurrences AS (SELECT 'evidence-' || left(sha256(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ') || chr(31) || lang), 24) AS evidence_id,
  doc_id AS occurrence_id, doc_id % 97 AS thread_id, source AS scope_id, doc_id AS position, doc_id AS "at", doc_id::VARCHAR AS record_id FROM documents)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
