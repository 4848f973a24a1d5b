"""Queries on upkeep: changes, versions, merging, digests, inventories, estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from histlake.operators import digest, lifecycle, merge, stats
from histlake.operators.evidence import orphans
from histlake.operators.search import eligible
from histlake.plans.projection import KNOWLEDGE_SQL, MESSAGES_SQL, OCCURRENCES_SQL, knowledge, messages, occurrences, with_
from histlake.plans.registry import query
from histlake.sources import read_table

SIDES_SQL = """cur AS (SELECT doc_id, length(text)::BIGINT AS size, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS sha,
  CASE WHEN doc_id % 7 = 0 AND doc_id % 2 = 0 THEN sha256(text) ELSE sha256('?' || text) END AS prefix FROM documents WHERE doc_id % 10 <> 0),
old AS (SELECT doc_id, (length(text) - 1)::BIGINT AS size, sha256(text) AS sha FROM documents WHERE doc_id % 13 <> 0)"""


def _sides(spark, sf):
    docs, n = read_table(spark, sf, "documents").select("doc_id", "text"), F.col("doc_id")
    sha = F.sha2("text", 256)
    current = docs.where(n % 10 != 0).select(
        "doc_id", F.length("text").cast("long").alias("size"), F.when(n % 7 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(sha).alias("content_sha"),
        F.when((n % 7 == 0) & (n % 2 == 0), sha).otherwise(F.sha2(F.concat(F.lit("?"), "text"), 256)).alias("prefix_sha"),
    )
    return current, docs.where(n % 13 != 0).select("doc_id", (F.length("text") - 1).cast("long").alias("size"), sha.alias("content_sha"))


CHANGES_SQL = f"""{SIDES_SQL}, changes AS (SELECT coalesce(c.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN c.doc_id IS NULL THEN 'deleted' WHEN c.sha = o.sha THEN 'unchanged'
 WHEN c.size > o.size AND c.prefix = o.sha THEN 'appended' ELSE 'rewritten' END AS kind FROM cur c FULL JOIN old o ON c.doc_id = o.doc_id)"""


@query("change_detection", f"WITH {CHANGES_SQL} SELECT * FROM changes")
def change_detection(spark, sf):
    return lifecycle.classify_changes(*_sides(spark, sf), key="doc_id")


@query("change_counts", f"WITH {CHANGES_SQL} SELECT kind, count(*) AS n, CASE kind WHEN 'added' THEN 0 WHEN 'appended' THEN 1 WHEN 'rewritten' THEN 2 WHEN 'deleted' THEN 3 ELSE 4 END AS place FROM changes GROUP BY kind")
def change_counts(spark, sf):
    kinds = lifecycle.classify_changes(*_sides(spark, sf), key="doc_id").groupBy("kind").agg(F.count("*").alias("n"))
    return kinds.withColumn("place", lifecycle.change_place(F.col("kind")))


@query("incremental_diff", f"WITH {SIDES_SQL} SELECT doc_id FROM cur WHERE (doc_id, sha) NOT IN (SELECT doc_id, sha FROM old)")
def incremental_diff(spark, sf):
    current, old = _sides(spark, sf)
    return lifecycle.new_rows(current, old, ["doc_id", "content_sha"]).select("doc_id")


@query("upsert_rows", f"WITH {SIDES_SQL} SELECT doc_id, sha FROM old WHERE doc_id NOT IN (SELECT doc_id FROM cur) UNION ALL SELECT doc_id, sha FROM cur")
def upsert_rows(spark, sf):
    current, old = _sides(spark, sf)
    both = [d.select("doc_id", F.col("content_sha").alias("sha")) for d in (old, current)]
    return lifecycle.upsert(*both, ["doc_id"])


@query("apply_patch", f"WITH {SIDES_SQL} SELECT doc_id, sha FROM old WHERE doc_id % 17 <> 0 AND doc_id NOT IN (SELECT doc_id FROM cur WHERE doc_id % 3 = 0) UNION ALL SELECT doc_id, sha FROM cur WHERE doc_id % 3 = 0")
def apply_patch(spark, sf):
    current, old = _sides(spark, sf)
    base, patch = (d.select("doc_id", F.col("content_sha").alias("sha")) for d in (old, current.where("doc_id % 3 = 0")))
    return lifecycle.apply_patch(base, patch, old.where("doc_id % 17 = 0"), "doc_id")


@query(
    "supersede_scd2",
    with_(KNOWLEDGE_SQL)
    + "SELECT record_id, scope_id, lead(occurred_start) OVER w AS valid_to, lead(record_id) OVER w AS superseded_by FROM knowledge WHERE tier = 'overview' WINDOW w AS (PARTITION BY scope_id ORDER BY occurred_start, record_id)",
)
def supersede_scd2(spark, sf):
    rows = knowledge(spark, sf).where("tier = 'overview'").select("record_id", "scope_id", "occurred_start")
    return lifecycle.supersede(rows, key=["scope_id"], at="occurred_start", record="record_id").select("record_id", "scope_id", "valid_to", "superseded_by")


@query("version_numbers", with_(OCCURRENCES_SQL) + 'SELECT occurrence_id, (row_number() OVER (PARTITION BY evidence_id ORDER BY "at", occurrence_id))::BIGINT AS version_no FROM occurrences')
def version_numbers(spark, sf):
    return lifecycle.version_numbers(occurrences(spark, sf), ["evidence_id"], ["at", "occurrence_id"]).select("occurrence_id", "version_no")


@query(
    "archive_next_version",
    with_(OCCURRENCES_SQL)
    + """, v AS (SELECT evidence_id, count(*) AS last FROM occurrences WHERE occurrence_id % 2 = 0 GROUP BY 1), r AS (SELECT DISTINCT evidence_id FROM occurrences)
SELECT evidence_id, (coalesce(last, 0) + 1)::BIGINT AS version_no FROM r LEFT JOIN v USING (evidence_id)""",
)
def archive_next_version(spark, sf):
    occ = occurrences(spark, sf)
    versions = lifecycle.version_numbers(occ.where("occurrence_id % 2 = 0"), ["evidence_id"], ["occurrence_id"])
    return lifecycle.archive(occ.select("evidence_id").distinct(), versions, "evidence_id").select("evidence_id", "version_no")


@query("delete_cascade", with_(OCCURRENCES_SQL) + "SELECT DISTINCT evidence_id FROM occurrences WHERE thread_id % 4 <> 1")
def delete_cascade(spark, sf):
    occ = occurrences(spark, sf)
    tables = {"occurrences": occ, "evidence": occ.select("evidence_id").distinct()}
    return lifecycle.delete_threads(tables, occ.where("thread_id % 4 = 1"))["evidence"]


@query(
    "authority_patch_closure",
    with_(OCCURRENCES_SQL)
    + """, s AS (SELECT DISTINCT scope_id FROM occurrences WHERE thread_id IN (3, 5)), r AS (SELECT DISTINCT record_id FROM occurrences WHERE scope_id IN (SELECT scope_id FROM s))
SELECT 'thread' AS kind, thread_id::VARCHAR AS id FROM (SELECT DISTINCT thread_id FROM occurrences WHERE thread_id IN (3, 5)) UNION ALL SELECT 'scope', scope_id FROM s UNION ALL SELECT 'record', record_id FROM r
UNION ALL SELECT DISTINCT 'evidence', evidence_id FROM occurrences WHERE record_id IN (SELECT record_id FROM r)""",
)
def authority_patch_closure(spark, sf):
    occ = occurrences(spark, sf)
    return lifecycle.patch_closure(occ.where("thread_id in (3, 5)"), occ.select("scope_id", "thread_id"), occ.select("record_id", "scope_id"), occ.select("record_id", "evidence_id"))


@query("retained_builds", "SELECT event_id AS build_id FROM events WHERE event_id = (SELECT min(event_id) FROM events) UNION ALL SELECT event_id FROM (SELECT event_id FROM events WHERE event_id > (SELECT min(event_id) FROM events) ORDER BY ts DESC, event_id LIMIT 4)")
def retained_builds(spark, sf):
    rows = read_table(spark, sf, "events").select(F.col("event_id").alias("build_id"), F.col("ts").alias("built_at"))
    least = rows.agg(F.min("build_id")).first()[0]
    return lifecycle.retain(rows.withColumn("active", F.col("build_id") == F.lit(least)), 5).select("build_id")


VARIANTS_SQL = f"""{MESSAGES_SQL},
a AS (SELECT thread_id, line_no, sha256(text) AS sha, CASE WHEN line_no % 5 <> 4 THEN line_no END AS "at" FROM messages WHERE thread_id % 6 <> 5 AND NOT (thread_id % 6 = 2 AND line_no > 3) AND NOT (thread_id % 6 = 3 AND line_no = 1)),
b AS (SELECT thread_id, line_no, sha256(text) AS sha, CASE WHEN line_no % 5 <> 4 THEN line_no END AS "at" FROM messages WHERE thread_id % 6 <> 4 AND NOT (thread_id % 6 = 3 AND line_no = 2)),
la AS (SELECT thread_id, list(sha ORDER BY line_no) AS x FROM a GROUP BY 1), lb AS (SELECT thread_id, list(sha ORDER BY line_no) AS y FROM b GROUP BY 1),
methods AS (SELECT coalesce(la.thread_id, lb.thread_id) AS thread_id, CASE WHEN y IS NULL THEN 'only_left' WHEN x IS NULL THEN 'only_right' WHEN x = y THEN 'exact'
  WHEN x[1:least(len(x), len(y))] = y[1:least(len(x), len(y))] THEN 'prefix' ELSE 'union' END AS method FROM la FULL JOIN lb ON la.thread_id = lb.thread_id)"""


def _variants(spark, sf):
    m = messages(spark, sf).select("thread_id", "line_no", F.sha2("text", 256).alias("content_sha"), F.when(F.col("line_no") % 5 != 4, F.col("line_no")).alias("at"))
    k = F.col("thread_id") % 6
    left = m.where((k != 5) & ~((k == 2) & (F.col("line_no") > 3)) & ~((k == 3) & (F.col("line_no") == 1)))
    return left, m.where((k != 4) & ~((k == 3) & (F.col("line_no") == 2)))


@query("variant_methods", f"WITH {VARIANTS_SQL} SELECT * FROM methods")
def variant_methods(spark, sf):
    return merge.variant_methods(*_variants(spark, sf))


@query(
    "variant_merge",
    f"""WITH {VARIANTS_SQL}, u AS (SELECT *, 0 AS side FROM a UNION ALL SELECT *, 1 FROM b), f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY thread_id, sha ORDER BY side, line_no) = 1)
SELECT f.thread_id, (row_number() OVER (PARTITION BY f.thread_id ORDER BY "at" NULLS LAST, side, line_no))::BIGINT AS line_no, sha AS content_sha, method FROM f JOIN methods USING (thread_id)""",
)
def variant_merge(spark, sf):
    return merge.merge_variants(*_variants(spark, sf)).select("thread_id", "line_no", "content_sha", "method")


ROW_HASH = "sha256(coalesce({a}::VARCHAR, chr(0)) || chr(31) || coalesce({b}::VARCHAR, chr(0)) || chr(31) || coalesce({c}::VARCHAR, chr(0)))"
DIGEST_SQL = f"""h AS (SELECT source, {ROW_HASH.format(a='doc_id', b='text', c='lang')} AS h FROM documents),
p AS (SELECT source, left(h, 2) AS b, sha256(array_to_string(list(h ORDER BY h), chr(31))) AS d, count(*) AS n FROM h GROUP BY ALL),
digests AS (SELECT source, sum(n)::BIGINT AS n_rows, sha256(array_to_string(list(d ORDER BY b), chr(31))) AS digest FROM p GROUP BY source)"""


@query("table_digest", f"WITH {DIGEST_SQL} SELECT * FROM digests")
def table_digest(spark, sf):
    return digest.table_digest(read_table(spark, sf, "documents"), ["doc_id", "text", "lang"], ["source"])


@query(
    "digest_compare",
    f"""WITH {DIGEST_SQL}, d2 AS (SELECT source, CASE WHEN source = 'src3' THEN 'x' ELSE digest END AS digest FROM digests WHERE source <> 'src5'),
d1 AS (SELECT source, digest FROM digests WHERE source <> 'src7')
SELECT coalesce(d1.source, d2.source) AS name, CASE WHEN d2.source IS NULL THEN 'only_left' WHEN d1.source IS NULL THEN 'only_right' WHEN d1.digest = d2.digest THEN 'equal' ELSE 'different' END AS verdict FROM d1 FULL JOIN d2 ON d1.source = d2.source""",
)
def digest_compare(spark, sf):
    one = table_digest(spark, sf).select(F.col("source").alias("name"), "digest")
    other = one.where("name <> 'src5'").withColumn("digest", F.when(F.col("name") == "src3", "x").otherwise(F.col("digest")))
    return digest.compare_digests(one.where("name <> 'src7'"), other)


@query(
    "integrity_audit",
    with_(KNOWLEDGE_SQL)
    + """SELECT 'labels_of_documents' AS "check", count(*) AS problems, count(*) = 0 AS ok FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'documents_without_labels', count(*), count(*) = 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'closed_before_open', count(*), count(*) = 0 FROM knowledge WHERE valid_to < valid_from""",
)
def integrity_audit(spark, sf):
    docs, labels = (read_table(spark, sf, t).select("doc_id") for t in ("documents", "labels"))
    return digest.audit({"labels_of_documents": orphans(labels, docs, "doc_id"), "documents_without_labels": orphans(docs, labels, "doc_id"), "closed_before_open": knowledge(spark, sf).where("valid_to < valid_from")})


@query("citation_check", "SELECT conv_id, len(list_filter(list_distinct(list(turn)), lambda t: t % 2 = 1)) = 0 AS ok, count(*) FILTER (WHERE turn % 2 = 1) AS unknown FROM conversations GROUP BY conv_id")
def citation_check(spark, sf):
    rows = read_table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("turn").alias("cited"), F.collect_set(F.when(F.col("turn") % 2 == 0, F.col("turn"))).alias("known"))
    unknown = F.size(digest.cited_but_unknown(F.col("cited"), F.col("known"))).cast("long")
    return rows.select("conv_id", (unknown == 0).alias("ok"), unknown.alias("unknown"))


COUNTED = ("documents", "labels", "pages", "conversations", "events", "embeddings")


@query("library_stats", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in COUNTED))
def library_stats(spark, sf):
    return stats.table_counts({t: read_table(spark, sf, t) for t in COUNTED})


@query("library_breakdown", with_(KNOWLEDGE_SQL) + "SELECT tier, asset_type, status_group, count(*) AS n FROM knowledge GROUP BY ALL")
def library_breakdown(spark, sf):
    return knowledge(spark, sf).groupBy("tier", "asset_type", "status_group").agg(F.count("*").alias("n"))


@query("coverage_report", with_(KNOWLEDGE_SQL) + "SELECT scope_id, tier, count(*) AS n_rows, count(asserted_at) AS n_timed, min(asserted_at) AS first_at, max(asserted_at) AS last_at FROM knowledge GROUP BY ALL")
def coverage_report(spark, sf):
    return stats.coverage(knowledge(spark, sf), "asserted_at", ["scope_id", "tier"])


@query(
    "source_inventory",
    """WITH c AS (SELECT conv_id AS source_id, turn AS chunk_index, sha256(text) AS sha, length(text)::BIGINT AS size FROM conversations)
SELECT source_id, count(*) AS chunk_count, count(DISTINCT sha) AS distinct_chunks, sum(size)::BIGINT AS total_bytes, max(chunk_index) = count(*) - 1 AS complete, sha256(array_to_string(list(sha ORDER BY chunk_index), chr(31))) AS digest FROM c GROUP BY source_id""",
)
def source_inventory(spark, sf):
    rows = read_table(spark, sf, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("chunk_index"), F.sha2("text", 256).alias("sha"), F.length("text").cast("long").alias("size"))
    return stats.source_inventory(rows)


ESTIMATES = {"tokens": "b / 3.0::DOUBLE", "input_tokens": "b / 3.0::DOUBLE * 0.3::DOUBLE", "output_tokens": "b / 3.0::DOUBLE * 0.08::DOUBLE", "embedding_tokens": "b / 3.0::DOUBLE * 0.15::DOUBLE", "low_input_tokens": "b / 3.0::DOUBLE * 0.3::DOUBLE * 0.65::DOUBLE", "high_input_tokens": "b / 3.0::DOUBLE * 0.3::DOUBLE * 1.65::DOUBLE", "database_bytes": "b * 0.18::DOUBLE", "artifact_bytes": "b * 0.08::DOUBLE", "semantic_bytes": "b * 0.05::DOUBLE"}


@query("cost_estimate", "WITH s AS (SELECT source, sum(n_chars)::DOUBLE AS b FROM documents GROUP BY 1) SELECT source, " + ", ".join(f"ceil({e})::BIGINT AS {n}" for n, e in ESTIMATES.items()) + " FROM s")
def cost_estimate(spark, sf):
    sizes = read_table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").cast("double").alias("b"))
    return sizes.select("source", *[c.cast("long").alias(n) for n, c in stats.estimate(F.col("b")).items()])


@query(
    "pollution_audit",
    with_(KNOWLEDGE_SQL)
    + "SELECT tier, count(*) FILTER (WHERE NOT retrieval_eligible) AS switched_off, sum(CASE WHEN NOT retrieval_eligible THEN length(text) ELSE 0 END)::BIGINT AS chars, count(DISTINCT CASE WHEN NOT retrieval_eligible THEN scope_id END) AS scopes FROM knowledge GROUP BY tier",
)
def pollution_audit(spark, sf):
    off = ~eligible()
    return knowledge(spark, sf).groupBy("tier").agg(
        F.count(F.when(off, 1)).alias("switched_off"), F.sum(F.when(off, F.length("text")).otherwise(0)).cast("long").alias("chars"), F.countDistinct(F.when(off, F.col("scope_id"))).alias("scopes")
    )
