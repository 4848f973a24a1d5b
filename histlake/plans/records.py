"""Queries on knowledge records: claims, evidence, provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from histlake.functions import constants as C
from histlake.functions.text import remap_path
from histlake.operators import evidence, knowledge as K
from histlake.operators.lifecycle import latest
from histlake.operators.paths import candidate_paths, capture_plan, exclusion_reason
from histlake.plans.projection import KNOWLEDGE_SQL, OCCURRENCES_SQL, knowledge, occurrences, with_
from histlake.plans.registry import query
from histlake.sources import read_table

CLAIMS_SQL = r"""parts AS (SELECT record_id, text, list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?。！？])[ \t\n\r\f\v]+', '\1' || chr(31), 'g'), '\n+', chr(31), 'g'), chr(31)), lambda p: trim(p, ' ') <> '') AS p FROM knowledge),
claims AS (SELECT record_id, text, unnest(range(len(p))) AS ordinal, unnest(p) AS claim FROM parts)"""


@query("sentence_claims", with_(KNOWLEDGE_SQL, CLAIMS_SQL) + "SELECT record_id, ordinal, claim FROM claims")
def sentence_claims(spark, sf):
    return K.claims(knowledge(spark, sf)).select("record_id", "ordinal", "claim")


@query(
    "claim_offsets",
    with_(KNOWLEDGE_SQL, CLAIMS_SQL)
    + """, x AS (SELECT *, coalesce(sum(length(claim)) OVER (PARTITION BY record_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seen FROM claims)
SELECT record_id, ordinal, (seen + strpos(substring(text, seen + 1), claim) - 1)::BIGINT AS char_start FROM x""",
)
def claim_offsets(spark, sf):
    return K.claims(knowledge(spark, sf, merge=True)).select("record_id", "ordinal", "char_start")


@query(
    "claim_support",
    with_(KNOWLEDGE_SQL, CLAIMS_SQL)
    + """, g AS (SELECT record_id, tier, category || '/' || evidence_count AS scope_id FROM knowledge),
o AS (SELECT c.record_id, c.ordinal, g.scope_id FROM claims c JOIN g USING (record_id) WHERE g.tier = 'overview'),
f AS (SELECT scope_id, record_id AS fact_id, row_number() OVER (PARTITION BY scope_id ORDER BY record_id) - 1 AS fact_no FROM g WHERE tier = 'fact_block'),
m AS (SELECT scope_id, max(fact_no) AS last FROM f GROUP BY scope_id)
SELECT o.record_id, o.ordinal, f.fact_id FROM o JOIN m USING (scope_id) JOIN f ON f.scope_id = o.scope_id AND f.fact_no = least(o.ordinal, m.last)""",
)
def claim_support(spark, sf):
    from histlake.operators.lineage import ordinals

    # no source holds both overviews and facts here, so a language's share stands for the scope
    rows = knowledge(spark, sf).withColumn("scope_id", F.concat_ws("/", "category", "evidence_count"))
    claimed = K.claims(rows.where("tier = 'overview'")).join(rows.select("record_id", "scope_id"), "record_id")
    facts = ordinals(rows.where("tier = 'fact_block'").select("scope_id", "record_id"), ["scope_id"], ["record_id"], "fact_no")
    return K.support(claimed.select("record_id", "ordinal", "scope_id"), facts, "scope_id").select("record_id", "ordinal", "fact_id")


@query(
    "claims_nested",
    with_(KNOWLEDGE_SQL, CLAIMS_SQL) + "SELECT record_id, count(*) AS n_claims, md5(string_agg(claim, chr(31) ORDER BY ordinal)) AS digest FROM claims GROUP BY record_id",
)
def claims_nested(spark, sf):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "claim"))), lambda x: x["claim"])
    return K.claims(knowledge(spark, sf)).groupBy("record_id").agg(F.count("*").alias("n_claims"), F.md5(F.array_join(listed, "\u001f").cast("binary")).alias("digest"))


@query(
    "evidence_rollup",
    with_(OCCURRENCES_SQL)
    + """SELECT evidence_id, count(*) AS occurrence_count, count(DISTINCT thread_id) AS thread_count, count(DISTINCT scope_id) AS scope_count,
 min("at") AS first_at, max("at") AS last_at, first(occurrence_id ORDER BY thread_id, position, occurrence_id) AS representative FROM occurrences GROUP BY evidence_id""",
)
def evidence_rollup(spark, sf):
    return evidence.roll_up(occurrences(spark, sf))


@query(
    "evidence_scope_match",
    with_(OCCURRENCES_SQL)
    + "SELECT b.record_id, b.evidence_id, o.occurrence_id, b.scope_id = o.scope_id AS scope_match FROM occurrences b JOIN occurrences o ON b.evidence_id = o.evidence_id",
)
def evidence_scope_match(spark, sf):
    occ = occurrences(spark, sf)
    return evidence.scope_matches(occ.select("record_id", "evidence_id"), occ.select("evidence_id", "occurrence_id", "scope_id"), occ.select("record_id", "scope_id"))


@query("orphan_audit", with_(KNOWLEDGE_SQL) + "SELECT record_id FROM knowledge WHERE record_id NOT IN (SELECT doc_id::VARCHAR FROM labels)")
def orphan_audit(spark, sf):
    child = read_table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("record_id"))
    return evidence.orphans(knowledge(spark, sf).select("record_id"), child, "record_id")


@query(
    "duplicate_overviews",
    with_(KNOWLEDGE_SQL)
    + "SELECT record_id, scope_id FROM knowledge k WHERE tier = 'overview' AND valid_to IS NULL AND EXISTS (SELECT 1 FROM knowledge o WHERE o.tier = 'overview' AND o.valid_to IS NULL AND o.scope_id = k.scope_id AND o.record_id <> k.record_id)",
)
def duplicate_overviews(spark, sf):
    # a scope with several current overviews: counted, not joined with itself
    rows = knowledge(spark, sf).where("tier = 'overview' and valid_to is null").select("record_id", "scope_id")
    several = rows.groupBy("scope_id").agg(F.countDistinct("record_id").alias("n")).where("n > 1")
    return rows.join(several, "scope_id", "left_semi").select("record_id", "scope_id")


@query(
    "linked_records",
    with_(KNOWLEDGE_SQL, OCCURRENCES_SQL)
    + """SELECT o.evidence_id, k.record_id, k.tier, (row_number() OVER (PARTITION BY o.evidence_id ORDER BY CASE k.tier WHEN 'asset' THEN 0 WHEN 'overview' THEN 1 WHEN 'ledger' THEN 2 WHEN 'fact_block' THEN 3 ELSE 4 END, k.record_id))::BIGINT AS place
 FROM occurrences o JOIN knowledge k ON o.record_id = k.record_id""",
)
def linked_records(spark, sf):
    from pyspark.sql import Window

    place = F.lit(len(C.ALL_TIERS))
    for i, t in enumerate(C.ALL_TIERS):
        place = F.when(F.col("tier") == t, i).otherwise(place)
    linked = occurrences(spark, sf).select("evidence_id", "record_id").join(knowledge(spark, sf).select("record_id", "tier"), "record_id")
    by = Window.partitionBy("evidence_id").orderBy(place, "record_id")
    return linked.select("evidence_id", "record_id", "tier", F.row_number().over(by).cast("long").alias("place"))


@query(
    "occurrence_timeline",
    with_(OCCURRENCES_SQL)
    + 'SELECT evidence_id, occurrence_id, thread_id, (row_number() OVER (PARTITION BY evidence_id ORDER BY "at", occurrence_id))::BIGINT AS place, lag("at") OVER (PARTITION BY evidence_id ORDER BY "at", occurrence_id) AS before FROM occurrences',
)
def occurrence_timeline(spark, sf):
    from pyspark.sql import Window

    by = Window.partitionBy("evidence_id").orderBy("at", "occurrence_id")
    return occurrences(spark, sf).select("evidence_id", "occurrence_id", "thread_id", F.row_number().over(by).cast("long").alias("place"), F.lag("at").over(by).alias("before"))


@query("exact_duplicate_groups", with_(OCCURRENCES_SQL) + "SELECT evidence_id, count(*) AS copies, min(occurrence_id) AS first_doc FROM occurrences GROUP BY evidence_id HAVING count(*) > 1")
def exact_duplicate_groups(spark, sf):
    return occurrences(spark, sf).groupBy("evidence_id").agg(F.count("*").alias("copies"), F.min("occurrence_id").alias("first_doc")).where("copies > 1")


@query(
    "evidence_prefix_lookup",
    with_(OCCURRENCES_SQL) + "SELECT DISTINCT evidence_id FROM occurrences WHERE starts_with(evidence_id, (SELECT left(min(evidence_id), 20) FROM occurrences)) ORDER BY 1 LIMIT 2",
)
def evidence_prefix_lookup(spark, sf):
    rows = occurrences(spark, sf).select("evidence_id").distinct()
    prefix = rows.agg(F.substring(F.min("evidence_id"), 1, 20)).first()[0] or ""
    return rows.where(F.col("evidence_id").startswith(prefix)).orderBy("evidence_id").limit(2)


PAGE_TEXT = "'see ' || regexp_replace(url, '^[a-z]+://', '/') || ' and C:/Work/page' || page_id || '.html for it'"


@query(
    "path_extraction",
    rf"""WITH t AS (SELECT page_id, {PAGE_TEXT} AS t FROM pages)
SELECT page_id, unnest(list_sort(list_distinct(list_concat(regexp_extract_all(t, '(?:^|[ \t\n\r"''`(=:,])((?:/[A-Za-z0-9._@+-]+)+/?[A-Za-z0-9_@+-])', 1),
 regexp_extract_all(t, '(?:^|[ \t\n\r"''`(=,])([A-Za-z]:(?:[/\\][A-Za-z0-9._@ +-]+)+)', 1))))) AS path FROM t""",
)
def path_extraction(spark, sf):
    text = F.concat(F.lit("see "), F.regexp_replace("url", "^[a-z]+://", "/"), F.lit(" and C:/Work/page"), F.col("page_id"), F.lit(".html for it"))
    return read_table(spark, sf, "pages").select("page_id", F.explode(candidate_paths(text)).alias("path"))


@query(
    "path_remap",
    """WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'c:\\Work\\a' || page_id WHEN 1 THEN '/home/me/x/' || page_id ELSE '/srv/' || page_id END AS path FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/mnt/work/a' || page_id WHEN 1 THEN '/data/x/' || page_id ELSE path END AS mapped, CASE WHEN page_id % 3 < 2 THEN path END AS original FROM p""".replace("\\\\", "\\"),
)
def path_remap(spark, sf):
    n = F.col("page_id")
    path = F.when(n % 3 == 0, F.concat(F.lit("c:\\Work\\a"), n)).when(n % 3 == 1, F.concat(F.lit("/home/me/x/"), n)).otherwise(F.concat(F.lit("/srv/"), n))
    mapped = remap_path(path, [("/home", "/old"), ("C:/Work", "/mnt/work"), ("/home/me/x", "/data/x")])
    return read_table(spark, sf, "pages").select("page_id", mapped.alias("m")).select("page_id", "m.mapped", "m.original")


@query(
    "capture_policy",
    """SELECT CASE WHEN starts_with(url, 'https://site1') THEN 'excluded_root' WHEN page_id % 10 = 0 THEN 'missing' WHEN length(html) > 2000 THEN 'too_large' END AS reason, count(*) AS n_paths FROM pages GROUP BY 1""",
)
def capture_policy(spark, sf):
    size = F.when(F.col("page_id") % 10 != 0, F.length("html"))
    under = F.col("url").startswith("https://site1")
    rows = read_table(spark, sf, "pages")
    path = F.when(under, F.concat(F.lit("/skip/"), "page_id")).otherwise(F.col("url"))
    return capture_plan(rows.select("page_id", "url", "html"), exclusion_reason(path, size, roots=("/skip",), max_bytes=2000))


@query(
    "latest_overview",
    with_(KNOWLEDGE_SQL) + "SELECT scope_id, first(record_id ORDER BY asserted_at DESC NULLS LAST, record_id) AS record_id FROM knowledge WHERE tier = 'overview' AND valid_to IS NULL GROUP BY scope_id",
)
def latest_overview(spark, sf):
    rows = knowledge(spark, sf).where("tier = 'overview' and valid_to is null").select("scope_id", "record_id", "asserted_at")
    return latest(rows, key=["scope_id"], order=[F.desc_nulls_last("asserted_at"), F.asc("record_id")]).select("scope_id", "record_id")
