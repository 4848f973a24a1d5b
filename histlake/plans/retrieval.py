"""Queries on retrieval: ranked search, filters, federation."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from histlake.functions import constants as C
from histlake.operators import search as S
from histlake.operators.lexical import bm25
from histlake.operators.postings import Index, build_index
from histlake.operators.semantic import embedding_plan, semantic_candidates, semantic_documents
from histlake.plans.projection import KNOWLEDGE_SQL, OCCURRENCES_SQL, knowledge, occurrences, with_
from histlake.plans.registry import query
from histlake.sources import read_table, work_path

BODY_TEXT = "lower(text || chr(10) || theme || chr(10) || category || chr(10) || asset_type || chr(10) || tier)"


def _has(column: str, group: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t.lower()}')" for t in group) + ")"


def search_sql(groups: list[list[str]], *, name: str = "found", source: str = "knowledge", mode: str = "any", unwanted: tuple[str, ...] = (), limit: int | None = 10, where: str = "retrieval_eligible AND valid_to IS NULL", semantic: str | None = None) -> str:
    """The search as common table expressions over ``source``; the last is ``name``. Without a limit there are no quotas."""
    p = name
    phrases = list(dict.fromkeys(t for g in groups for t in g if len(t) >= 3))
    tf = lambda c, t: f"((length(lower({c})) - length(replace(lower({c}), '{t.lower()}', ''))) / {len(t)})::DOUBLE"
    engines = {"body": S.BODY, "title": ["scope_title"]}
    tfs = "".join(f"({' + '.join(tf(c, t) for c in cols)}) AS {e}{i}, " for e, cols in engines.items() for i, t in enumerate(phrases))
    dls = ", ".join(f"({' + '.join(f'greatest(0, length({c}) - 2)' for c in cols)})::DOUBLE AS dl_{e}" for e, cols in engines.items())
    dfs = "".join(f", count(*) FILTER (WHERE {e}{i} > 0)::DOUBLE AS df_{e}{i}" for e in engines for i in range(len(phrases)))
    one = lambda e, i: f"greatest(ln((n - df_{e}{i} + 0.5) / (df_{e}{i} + 0.5)), 1e-6) * {e}{i} * 2.2 / ({e}{i} + 1.2 * (0.25 + 0.75 * dl_{e} / mean_{e}))"
    score = lambda e: " + ".join(one(e, i) for i in range(len(phrases))) or "0"
    long_groups = [g for g in ([t for t in g if len(t) >= 3] for g in groups) if g]
    match = lambda e: (" AND " if mode == "all" else " OR ").join("(" + " OR ".join(f"{e}{phrases.index(t)} > 0" for t in g) + ")" for g in long_groups) or "false"
    nb = " + ".join(f"{_has('body', g)}::INT" for g in groups) or "0"
    nt = " + ".join(f"(NOT {_has('body', g)} AND {_has('title', g)})::INT" for g in groups) or "0"
    bad = f"NOT ({_has('body', list(unwanted))} OR {_has('title', list(unwanted))})" if unwanted else "true"
    accepted = {"all": f"nb + nt = {len(groups)} AND nb >= 1", "any": "nb + nt > 0 OR similarity IS NOT NULL", "semantic": "similarity IS NOT NULL"}[mode]
    within = "true" if limit is None else "within OR similarity IS NOT NULL"
    quota = C.LEXICAL_LEAST if limit is None else max(C.LEXICAL_QUOTA * limit, C.LEXICAL_LEAST)
    top = "" if limit is None else f" LIMIT {limit}"
    near = f"LEFT JOIN {semantic} sem ON sem.record_id = k.record_id" if semantic else ""
    sim = "sem.similarity" if semantic else "NULL::DOUBLE"
    pick = lambda m, d: "CASE " + " ".join(f"WHEN {k} THEN {v}" for k, v in m.items()) + f" ELSE {d} END"
    bonus = pick({f"tier = '{t}'": f"{v}::DOUBLE" for t, v in C.TIER_BONUS.items()}, "0::DOUBLE")
    strength = pick({f"status_group = '{s}'": v for s, v in C.STATUS_STRENGTH.items()}, 0)
    place = pick({f"tier = '{t}'": i for i, t in enumerate(C.ALL_TIERS)}, len(C.ALL_TIERS))
    order = "title_only, score DESC, nb DESC, nb + nt DESC, coalesce(nullif(similarity, 0), -1) DESC, tier_place, bm DESC NULLS LAST, strength DESC, evidence_count DESC, occurred_end DESC NULLS LAST, record_id"
    return f"""{p}_rows AS (SELECT *, {BODY_TEXT} AS body, lower(scope_title) AS title FROM {source} WHERE {where}),
{p}_tf AS (SELECT record_id, {tfs}{dls} FROM {source}),
{p}_stats AS (SELECT count(*)::DOUBLE AS n, avg(dl_body) AS mean_body, avg(dl_title) AS mean_title{dfs} FROM {p}_tf),
{p}_bm AS (SELECT record_id, CASE WHEN {match('body')} THEN {score('body')} END AS bm_body, CASE WHEN {match('title')} THEN {score('title')} END AS bm_title FROM {p}_tf, {p}_stats),
{p}_hit AS (SELECT k.*, {nb} AS nb, {nt} AS nt, {sim} AS similarity FROM {p}_rows k {near} WHERE {bad}),
{p}_ok AS (SELECT h.*, greatest(bm_body / 8, bm_title) AS bm, bm_body IS NOT NULL AND row_number() OVER (PARTITION BY tier, bm_body IS NULL ORDER BY bm_body DESC, h.record_id) <= {quota}
  OR bm_title IS NOT NULL AND row_number() OVER (PARTITION BY tier, bm_title IS NULL ORDER BY bm_title DESC, h.record_id) <= {quota}
  OR nb + nt > 0 AND row_number() OVER (PARTITION BY tier, nb + nt > 0 ORDER BY h.record_id) <= {quota} AS within FROM {p}_hit h JOIN {p}_bm b ON b.record_id = h.record_id WHERE {accepted}),
{p}_scored AS (SELECT *, round(1.4::DOUBLE * nb + 0.15::DOUBLE * nt + coalesce(similarity, 0) + {bonus} + 0.01::DOUBLE * {strength}, 6) AS score, {strength} AS strength, {place} AS tier_place,
  (nb = 0 AND nt > 0)::INT AS title_only, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') AS same FROM {p}_ok WHERE {within}),
{p}_first AS (SELECT *, row_number() OVER (PARTITION BY tier, same ORDER BY {order}) AS fst, count(*) OVER (PARTITION BY tier, same) AS cnt, list(record_id) OVER (PARTITION BY tier, same) AS everyone, list(scope_id) OVER (PARTITION BY tier, same) AS scopes FROM {p}_scored),
{p} AS (SELECT row_number() OVER (ORDER BY {order}) AS rank, record_id, tier, scope_id, score, nb AS body_matches, nt AS title_matches, cnt - 1 AS duplicate_count,
  array_to_string(list_sort(list_filter(everyone, lambda r: r <> record_id)), ',') AS duplicates,
  array_to_string(list_sort(list_distinct(list_filter(scopes, lambda x: x <> scope_id))), ',') AS duplicate_scopes FROM {p}_first WHERE fst = 1 ORDER BY {order}{top})"""


def full_search(groups, **options) -> str:
    return with_(KNOWLEDGE_SQL, search_sql(groups, **options)) + "SELECT * FROM found"


@query("search_any", full_search([["anties"], ["mente"], ["pfer"]], limit=20))
def search_any(spark, sf):
    return S.search(knowledge(spark, sf), S.SearchSpec("anties mente pfer", limit=20))


@query("search_all", full_search([["tion"], ["src3"]], mode="all", limit=15))
def search_all(spark, sf):
    return S.search(knowledge(spark, sf), S.SearchSpec("tion src3", mode="all", limit=15))


def indexed(spark, sf):
    path = work_path(spark, "index")
    build_index(knowledge(spark, sf, merge=True), path)
    return Index(spark, path)


@query("search_indexed", full_search([["anties"], ["mente"], ["pfer"]], limit=20))
def search_indexed(spark, sf):
    """The rows of ``search_any``, by an index of trigrams."""
    return indexed(spark, sf).search(S.SearchSpec("anties mente pfer", limit=20))


@query("search_negative_terms", full_search([["ever"]], unwanted=("the", "scope src1"), limit=12))
def search_negative_terms(spark, sf):
    return S.search(knowledge(spark, sf), S.SearchSpec('ever -the -"scope src1"', limit=12))


@query("search_alias", full_search([["wissen", "heit", "mente"]], limit=10))
def search_alias(spark, sf):
    return S.search(knowledge(spark, sf), S.SearchSpec("wissen", aliases=(("wissen", "heit"), ("mente", "wissen"))))


@query("search_phrase", full_search([["of the"], ["in the"]], limit=10))
def search_phrase(spark, sf):
    return S.search(knowledge(spark, sf), S.SearchSpec('"of the" "in the"'))


@query("search_scoped_history", full_search([["the"]], limit=25, where="retrieval_eligible AND scope_id IN ('src1', 'src2') AND tier NOT IN ('core')").replace("tier NOT IN ('core')", "tier IN ('asset', 'overview')"))
def search_scoped_history(spark, sf):
    f = S.Filters(scopes=("src1", "src2"), tiers=("asset", "overview"), history=True)
    return S.search(knowledge(spark, sf), S.SearchSpec("the", limit=25, filters=f))


BM25_SQL = with_(KNOWLEDGE_SQL, search_sql([["anties"], ["mente"]], where="true")) + "SELECT record_id, round(bm_body, 6) AS bm25 FROM found_bm WHERE bm_body IS NOT NULL ORDER BY round(bm_body, 6) DESC, record_id LIMIT 50"


@query("bm25_topk", BM25_SQL)
def bm25_topk(spark, sf):
    rows = knowledge(spark, sf).select("record_id", *S.BODY)
    return bm25(rows, S.BODY, ["anties", "mente"]).select("record_id", F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "record_id").limit(50)


@query(
    "artifact_bm25_weighted",
    """WITH t AS (SELECT page_id, ((length(lower(url)) - length(replace(lower(url), 'page', ''))) / 4) * 8.0::DOUBLE + ((length(lower(html)) - length(replace(lower(html), 'page', ''))) / 4) * 2.0::DOUBLE AS tf,
  (greatest(0, length(url) - 2) + greatest(0, length(html) - 2))::DOUBLE AS dl FROM pages),
s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean, count(*) FILTER (WHERE tf > 0)::DOUBLE AS df FROM t)
SELECT page_id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)), 9) AS bm25 FROM t, s WHERE tf > 0""",
)
def artifact_bm25_weighted(spark, sf):
    rows = read_table(spark, sf, "pages").select("page_id", "url", "html")
    return bm25(rows, ["url", "html"], ["page"], weights=(8.0, 2.0)).select("page_id", F.round("bm25", 9).alias("bm25"))


def _vector_query(spark, sf) -> list[float] | None:
    """Vector 0, if there is one."""
    found = read_table(spark, sf, "embeddings").where("vec_id = 0").first()
    return [float(x) for x in found["embedding"]] if found and found["embedding"] else None


def _bridge(documents):
    return documents.select("doc_id", F.col("doc_id").cast("string").alias("record_id"))


def _semantic(spark, sf, limit):
    documents = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    vector = _vector_query(spark, sf)
    near = documents if vector else documents.where("false")
    return semantic_candidates(near, _bridge(near), vector or [1.0], limit=limit)


DOT = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
NORM = "sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)))"
SEMANTIC_SQL = f"""semantic AS (SELECT e.vec_id::VARCHAR AS record_id, round({DOT} / ({NORM.format(v='e.embedding')} * {NORM.format(v='q.embedding')}), 6) AS similarity
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {DOT} / ({NORM.format(v='e.embedding')} * {NORM.format(v='q.embedding')}) DESC, e.vec_id LIMIT 1000)"""


@query("semantic_topk", with_(SEMANTIC_SQL) + "SELECT * FROM semantic ORDER BY similarity DESC, record_id LIMIT 50")
def semantic_topk(spark, sf):
    found = _semantic(spark, sf, 10).select("record_id", F.round("similarity", 6).alias("similarity"))
    return found.orderBy(F.desc("similarity"), "record_id").limit(50)


@query("hybrid_search", with_(KNOWLEDGE_SQL, SEMANTIC_SQL, search_sql([["tion"], ["heit"]], limit=20, semantic="semantic")) + "SELECT * FROM found")
def hybrid_search(spark, sf):
    near = _semantic(spark, sf, 10).select("record_id", F.round("similarity", 6).alias("similarity"))
    return S.search(knowledge(spark, sf), S.SearchSpec("tion heit", limit=20), semantic=near)


@query("semantic_search", with_(KNOWLEDGE_SQL, SEMANTIC_SQL, search_sql([["tion"]], limit=10, mode="semantic", semantic="semantic")) + "SELECT * FROM found")
def semantic_search(spark, sf):
    near = _semantic(spark, sf, 10).select("record_id", F.round("similarity", 6).alias("similarity"))
    return S.search(knowledge(spark, sf), S.SearchSpec("tion", mode="semantic"), semantic=near)


@query(
    "collapse_duplicates",
    with_(KNOWLEDGE_SQL, search_sql([["e"]], limit=None)) + "SELECT record_id, duplicate_count, duplicates FROM found WHERE duplicate_count > 0",
)
def collapse_duplicates(spark, sf):
    found = S.search(knowledge(spark, sf), S.SearchSpec("e", limit=None))
    return found.where("duplicate_count > 0").select("record_id", "duplicate_count", "duplicates")


@query(
    "context_packet",
    with_(
        KNOWLEDGE_SQL,
        search_sql([["the"], ["mente"]], name="hi", limit=8, where="retrieval_eligible AND valid_to IS NULL AND tier IN ('asset', 'overview', 'ledger')"),
        search_sql([["the"], ["mente"]], name="lo", limit=8, where="retrieval_eligible AND valid_to IS NULL AND tier IN ('fact_block', 'core')"),
        "parts AS (SELECT 0 AS part, rank, record_id FROM hi UNION ALL SELECT 1, rank, record_id FROM lo)",
    )
    + r"""SELECT part, rank, record_id, scope_id FROM parts JOIN knowledge USING (record_id)
QUALIFY row_number() OVER (PARTITION BY scope_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ') ORDER BY part, rank) = 1""",
)
def context_packet(spark, sf):
    return S.context_packet(knowledge(spark, sf), S.SearchSpec("the mente"))


@query("asset_list", with_(KNOWLEDGE_SQL) + "SELECT record_id, scope_id, status_group, evidence_count FROM knowledge WHERE retrieval_eligible AND valid_to IS NULL AND tier = 'asset' AND asset_type = 'decisions' ORDER BY scope_id, status_group, evidence_count DESC, record_id LIMIT 25")
def asset_list(spark, sf):
    return S.asset_list(knowledge(spark, sf), "decisions", 25)


KEY = r"sha256(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' '))"


@query("compare_scopes", with_(KNOWLEDGE_SQL) + f"SELECT {KEY} AS text_sha FROM knowledge WHERE retrieval_eligible AND valid_to IS NULL AND scope_id = 'src2' INTERSECT SELECT {KEY} FROM knowledge WHERE retrieval_eligible AND valid_to IS NULL AND scope_id = 'src14'")
def compare_scopes(spark, sf):
    return S.compare_scopes(knowledge(spark, sf), "src2", "src14")


FEDERATED_KEY = r"sha256(lower(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) || chr(31) || k.tier || chr(31) || asset_type || chr(31) || status_group)"


@query(
    "federated_search",
    with_(
        KNOWLEDGE_SQL,
        "la AS (SELECT * FROM knowledge WHERE record_id::BIGINT % 3 <> 0)",
        "lb AS (SELECT * FROM knowledge WHERE record_id::BIGINT % 3 <> 1)",
        search_sql([["tion"], ["heit"]], name="fa", source="la", limit=60),
        search_sql([["tion"], ["heit"]], name="fb", source="lb", limit=60),
        f"parts AS (SELECT 'desk' AS library, f.record_id, f.score, {FEDERATED_KEY} AS key FROM fa f JOIN la k ON f.record_id = k.record_id UNION ALL SELECT 'lap', f.record_id, f.score, {FEDERATED_KEY} FROM fb f JOIN lb k ON f.record_id = k.record_id)",
    )
    + """SELECT first(record_id ORDER BY score DESC, library, record_id) AS record_id, first(library ORDER BY score DESC, library, record_id) AS library, max(score) AS score, count(*) AS duplicate_count,
 array_to_string(list_sort(list(DISTINCT library)), ',') AS libraries FROM parts GROUP BY key ORDER BY score DESC, duplicate_count DESC, record_id, library LIMIT 15""",
)
def federated_search(spark, sf):
    k = knowledge(spark, sf)
    n = F.col("record_id").cast("long") % 3
    return S.federated({"desk": k.where(n != 0), "lap": k.where(n != 1)}, S.SearchSpec("tion heit", limit=15))


@query(
    "exclude_threads",
    with_(KNOWLEDGE_SQL, OCCURRENCES_SQL)
    + "SELECT record_id, scope_id FROM knowledge WHERE record_id NOT IN (SELECT b.record_id FROM occurrences b JOIN occurrences o ON b.evidence_id = o.evidence_id WHERE o.thread_id IN (3, 5, 8))",
)
def exclude_threads(spark, sf):
    occ = occurrences(spark, sf)
    return S.exclude_threads(knowledge(spark, sf), occ.select("record_id", "evidence_id"), occ.select("evidence_id", "thread_id"), [3, 5, 8]).select("record_id", "scope_id")


AT = datetime(2024, 1, 20, 12, tzinfo=timezone.utc)


@query(
    "as_of",
    with_(KNOWLEDGE_SQL)
    + """SELECT record_id FROM knowledge WHERE retrieval_eligible AND coalesce(asserted_at, indexed_at, occurred_end, occurred_start) <= TIMESTAMP '2024-01-20 12:00:00'
 AND (valid_from IS NULL OR valid_from <= TIMESTAMP '2024-01-20 12:00:00') AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-20 12:00:00')""",
)
def as_of(spark, sf):
    return knowledge(spark, sf).where(S.predicate(S.Filters(as_of=AT))).select("record_id")


def _window(match: str) -> S.Filters:
    return S.Filters(since=datetime(2024, 1, 5, tzinfo=timezone.utc), until=datetime(2024, 1, 12, 3, tzinfo=timezone.utc), time_match=match)


@query("time_overlaps", with_(KNOWLEDGE_SQL) + "SELECT record_id FROM knowledge WHERE retrieval_eligible AND valid_to IS NULL AND occurred_end >= TIMESTAMP '2024-01-05' AND occurred_start <= TIMESTAMP '2024-01-12 03:00:00'")
def time_overlaps(spark, sf):
    return knowledge(spark, sf).where(S.predicate(_window("overlaps"))).select("record_id")


@query("time_contained", with_(KNOWLEDGE_SQL) + "SELECT record_id FROM knowledge WHERE retrieval_eligible AND valid_to IS NULL AND occurred_start >= TIMESTAMP '2024-01-05' AND occurred_end <= TIMESTAMP '2024-01-12 03:00:00'")
def time_contained(spark, sf):
    return knowledge(spark, sf).where(S.predicate(_window("contained"))).select("record_id")


@query("recent_window", with_(KNOWLEDGE_SQL) + "SELECT record_id FROM knowledge WHERE retrieval_eligible AND valid_to IS NULL AND asserted_at >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAYS AND asserted_at <= TIMESTAMP '2024-01-20 12:00:00'")
def recent_window(spark, sf):
    from histlake.functions.queries import recent_since

    f = S.Filters(since=recent_since("7d", AT), until=AT, time_field="asserted")
    return knowledge(spark, sf).where(S.predicate(f)).select("record_id")


@query("current_vs_history", with_(KNOWLEDGE_SQL) + "SELECT scope_id, count(*) FILTER (WHERE valid_to IS NULL) AS current_rows, count(*) AS all_rows FROM knowledge WHERE retrieval_eligible AND temporal_confidence <> 'scope_range' GROUP BY scope_id")
def current_vs_history(spark, sf):
    rows = knowledge(spark, sf).where(S.predicate(S.Filters(history=True, exclude_inherited=True)))
    return rows.groupBy("scope_id").agg(F.count(F.when(F.col("valid_to").isNull(), 1)).alias("current_rows"), F.count("*").alias("all_rows"))


@query(
    "embedding_refresh_plan",
    "SELECT doc_id, 'embed' AS action FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'delete' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)",
)
def embedding_refresh_plan(spark, sf):
    return embedding_plan(read_table(spark, sf, "documents").select("doc_id"), read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")))


@query("semantic_documents", with_(KNOWLEDGE_SQL) + "SELECT sha256(text) AS doc_id, count(*) AS record_count FROM knowledge GROUP BY 1")
def semantic_documents_q(spark, sf):
    documents, _ = semantic_documents(knowledge(spark, sf), F.col("text"))
    return documents.select("doc_id", "record_count")
