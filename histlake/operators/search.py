"""Ranked retrieval over the knowledge table: filters, candidates, fusion, order, collapse."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histlake.functions import constants as C
from histlake.functions.queries import alias_groups, parse_terms
from histlake.functions.text import ASCII_BLANK, normalize_text
from histlake.operators.lexical import with_bm25
from histlake.operators.semantic import semantic_candidates

BODY = ["text", "theme", "category", "asset_type", "tier"]
#: BM25 scores, and the columns of each.
ENGINES = {"__body_bm25": BODY, "__title_bm25": ["scope_title"]}


def body_text() -> Column:
    """What terms are looked for in."""
    return F.lower(F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in BODY]))


def title_text() -> Column:
    return F.lower(F.coalesce("scope_title", F.lit("")))


@dataclass(frozen=True)
class Filters:
    """Predicates on knowledge rows. Bounds are inclusive; a point in time excludes the window."""

    scopes: tuple[str, ...] = ()
    exclude_scopes: tuple[str, ...] = ()
    exclude_records: tuple[str, ...] = ()
    tiers: tuple[str, ...] = ()
    asset_type: str | None = None
    status: str | None = None
    history: bool = False
    as_of: datetime | None = None
    since: datetime | None = None
    until: datetime | None = None
    time_field: str = "occurred"
    time_match: str = "overlaps"
    exclude_inherited: bool = False


def _at(moment: datetime) -> Column:
    """A moment as a timestamp without zone, in UTC."""
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def eligible() -> Column:
    """Rows meant for retrieval: not switched off, and no asset that an outdated classifier derived."""
    outdated = (F.col("tier") == "asset") & (F.coalesce("derived_by", F.lit("")) == C.OUTDATED_CLASSIFIER)
    return F.coalesce(F.col("retrieval_eligible"), F.lit(True)) & ~outdated


def predicate(f: Filters) -> Column:
    if f.as_of and (f.since or f.until):
        raise ValueError("a point in time excludes a window")
    out = eligible()
    if f.as_of:
        p = _at(f.as_of)
        known = F.coalesce("asserted_at", "indexed_at", "occurred_end", "occurred_start") <= p
        open_ = (F.col("valid_from").isNull() | (F.col("valid_from") <= p)) & (F.col("valid_to").isNull() | (F.col("valid_to") > p))
        out = out & known & open_
    elif not f.history:
        out = out & F.col("valid_to").isNull()
    for values, column, wanted in ((f.scopes, "scope_id", True), (f.exclude_scopes, "scope_id", False), (f.exclude_records, "record_id", False), (f.tiers, "tier", True)):
        if values:
            out = out & (F.col(column).isin(*values) if wanted else ~F.col(column).isin(*values))
    if f.asset_type:
        out = out & (F.col("asset_type") == f.asset_type)
    if f.status:
        out = out & (F.col("status_group") == f.status)
    if f.exclude_inherited:
        out = out & (F.coalesce("temporal_confidence", F.lit("")) != "scope_range")
    return out & time_window(f)


def time_window(f: Filters) -> Column:
    if f.time_field == "occurred":
        start, end = F.coalesce("occurred_start", "occurred_end"), F.coalesce("occurred_end", "occurred_start")
    else:
        start = end = F.col(f"{f.time_field}_at")
    low, high = (end, start) if f.time_match == "overlaps" else (start, end)
    out = F.lit(True)
    if f.since:
        out = out & (low >= _at(f.since))
    if f.until:
        out = out & (high <= _at(f.until))
    return out


def exclude_threads(rows: DataFrame, bridge: DataFrame, occurrences: DataFrame, threads: list[str]) -> DataFrame:
    """Without records that have evidence in the given threads.

    ``bridge``: record_id, evidence_id; ``occurrences``: evidence_id, thread_id.
    """
    touched = bridge.join(occurrences.where(F.col("thread_id").isin(*threads)), "evidence_id").select("record_id").distinct()
    return rows.join(touched, "record_id", "left_anti")


@dataclass(frozen=True)
class SearchSpec:
    query: str
    mode: str = "any"
    limit: int | None = 10
    exclude: tuple[str, ...] = ()
    aliases: tuple[tuple[str, str], ...] = ()
    filters: Filters = field(default_factory=Filters)


def _has(text: Column, group: list[str]) -> Column:
    out = F.lit(False)
    for term in group:
        out = out | text.contains(term.lower())
    return out


def _sum(flags: list[Column]) -> Column:
    out = F.lit(0)
    for f in flags:
        out = out + f.cast("int")
    return out


def _pick(values: dict, key: str, default) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(F.col(key) == name, F.lit(value)).otherwise(out)
    return out


def search(knowledge: DataFrame, spec: SearchSpec, semantic: DataFrame | None = None, *, facts: DataFrame | None = None) -> DataFrame:
    """Ranked records: rank, record_id, tier, scope_id, score, body_matches, title_matches, duplicate_count, duplicates, duplicate_scopes.

    Candidates are, per tier, the best by BM25 of bodies, the best by BM25 of titles and the
    first that contain a term, each within a quota of its own, and all of ``semantic``
    (record_id, similarity). The query's terms are literals: a row that is found scores in its
    scan and goes on as numbers and hashes, once for each way it was found, so that Spark cuts
    every quota before the exchange. Without a limit there are no quotas. Equal texts of a tier
    (case kept) are one result. ``facts``: if ``knowledge`` are only the records that may hold a
    term, the row count and mean lengths of all (see ``with_bm25``).
    """
    wanted, unwanted = parse_terms(spec.query, spec.exclude)
    groups = alias_groups(wanted, spec.aliases)
    rows = knowledge.where(predicate(spec.filters))
    rows = rows.withColumns({"__body": body_text(), "__title": title_text()})
    if unwanted:
        rows = rows.where(~(_has(F.col("__body"), unwanted) | _has(F.col("__title"), unwanted)))
    in_body = [_has(F.col("__body"), g) for g in groups]
    in_title = [~b & _has(F.col("__title"), g) for b, g in zip(in_body, groups, strict=True)]
    rows = rows.withColumns({"__nb": _sum(in_body), "__nt": _sum(in_title)})
    if semantic is None:
        rows = rows.withColumn("similarity", F.lit(None).cast("double"))
    else:
        rows = rows.join(semantic.select("record_id", "similarity"), "record_id", "left")
    n, near = F.col("__nb") + F.col("__nt"), F.col("similarity").isNotNull()
    if spec.mode == "all":
        accepted = (n == len(groups)) & (F.col("__nb") >= 1)
    elif spec.mode == "semantic":
        accepted = near
    else:
        accepted = (n > 0) | near
    scored = with_bm25(rows.where(accepted), knowledge, ENGINES, groups, require="all" if spec.mode == "all" else "any", facts=facts)
    lexical = F.greatest(F.col("__body_bm25") / C.BODY_ENGINE, F.col("__title_bm25") / C.TITLE_ENGINE)
    # a hash, so that no text is exchanged
    ranked = scored.withColumns({"bm25": lexical, "__key": F.sha2(normalize_text("text", ASCII_BLANK), 256)}).drop(*BODY[:3], "__body", "__title", "scope_title")
    if spec.limit is not None:
        ways = [F.col("__body_bm25"), F.col("__title_bm25"), F.when(n > 0, 0.0)]
        found = F.filter(F.array(*[F.struct(F.lit(i).alias("way"), w.alias("worth")) for i, w in enumerate(ways)]), lambda x: x["worth"].isNotNull())
        place = F.row_number().over(Window.partitionBy("tier", "__found.way").orderBy(F.desc("__found.worth"), "record_id"))
        quota = max(C.LEXICAL_QUOTA * spec.limit, C.LEXICAL_LEAST)
        lexical_rows = ranked.withColumn("__found", F.explode(found)).withColumn("__place", place).where(F.col("__place") <= quota).drop("__found", "__place")
        ranked = lexical_rows if semantic is None else lexical_rows.unionByName(ranked.where(near))
    strength = _pick(C.STATUS_STRENGTH, "status_group", 0)
    score = C.BODY_WEIGHT * F.col("__nb") + C.TITLE_WEIGHT * F.col("__nt") + F.coalesce("similarity", F.lit(0.0)) + _pick(C.TIER_BONUS, "tier", 0.0) + C.STRENGTH_WEIGHT * strength
    tier_place = _pick({t: i for i, t in enumerate(C.ALL_TIERS)}, "tier", len(C.ALL_TIERS))
    ranked = ranked.withColumns({"score": F.round(score, 6), "__strength": strength, "__tier": tier_place, "__title_only": ((F.col("__nb") == 0) & (F.col("__nt") > 0)).cast("int")})
    order = [
        F.asc("__title_only"), F.desc("score"), F.desc("__nb"), F.desc(n), F.desc(F.when(F.col("similarity") != 0, F.col("similarity")).otherwise(-1.0)), F.asc("__tier"), F.desc_nulls_last("bm25"),
        F.desc("__strength"), F.desc("evidence_count"), F.desc_nulls_last("occurred_end"), F.asc("record_id"),
    ]
    same = Window.partitionBy("tier", "__key")
    # an aggregate over the numbered rows: a set per group, in which a row found twice is one
    shown = ["record_id", "scope_id", "score", "similarity", "bm25", "evidence_count", "occurred_end", "__nb", "__nt", "__title_only", "__strength", "__tier"]
    collapsed = (
        ranked.withColumn("__first", F.row_number().over(same.orderBy(*order)))
        .groupBy("tier", "__key")
        .agg(F.min_by(F.struct(*shown), "__first").alias("__row"), F.collect_set("record_id").alias("__all"), F.collect_set("scope_id").alias("__scopes"))
        .select("tier", "__row.*", "__all", "__scopes")
    )
    top = collapsed if spec.limit is None else collapsed.orderBy(*order).limit(spec.limit)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    others = F.array_sort(F.filter("__all", lambda r: r != F.col("record_id")))
    scopes = F.array_sort(F.filter("__scopes", lambda x: ~x.eqNullSafe(F.col("scope_id"))))
    return top.select(
        rank.alias("rank"), "record_id", "tier", "scope_id", "score", F.col("__nb").alias("body_matches"), F.col("__nt").alias("title_matches"),
        (F.size("__all") - 1).cast("long").alias("duplicate_count"), F.array_join(others, ",").alias("duplicates"), F.array_join(scopes, ",").alias("duplicate_scopes"),
    )


def asset_list(knowledge: DataFrame, asset_type: str, limit: int) -> DataFrame:
    """Assets of one kind without a query: by scope, status group, evidence (most first), id."""
    rows = knowledge.where(eligible() & F.col("valid_to").isNull() & (F.col("tier") == "asset") & (F.col("asset_type") == asset_type))
    return rows.orderBy("scope_id", "status_group", F.desc("evidence_count"), "record_id").limit(limit).select("record_id", "scope_id", "status_group", "evidence_count")


def context_packet(knowledge: DataFrame, spec: SearchSpec, *, high: int = 8, deep: int = 8) -> DataFrame:
    """The best of the condensed tiers, then of the deep ones; one row per scope and text."""
    from dataclasses import replace

    parts = []
    for place, (tiers, n) in enumerate(((C.HIGH_TIERS, high), (C.ALL_TIERS[3:], deep))):
        found = search(knowledge, replace(spec, limit=n, filters=replace(spec.filters, tiers=tiers)))
        parts.append(found.select(F.lit(place).alias("part"), "rank", "record_id"))
    both = parts[0].union(parts[1]).join(knowledge.select("record_id", "scope_id", "text"), "record_id")
    first = Window.partitionBy("scope_id", normalize_text("text", ASCII_BLANK)).orderBy("part", "rank")
    return both.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("part", "rank", "record_id", "scope_id")


def compare_scopes(knowledge: DataFrame, left: str, right: str) -> DataFrame:
    """Texts that both scopes hold, as their SHA-256."""
    current = knowledge.where(eligible() & F.col("valid_to").isNull())
    key = F.sha2(normalize_text("text", ASCII_BLANK), 256).alias("text_sha")
    return current.where(F.col("scope_id") == left).select(key).intersect(current.where(F.col("scope_id") == right).select(key))


def knowledge_key() -> Column:
    """What makes two libraries' records the same statement."""
    return F.sha2(F.concat_ws("\u001f", F.lower(normalize_text("text", ASCII_BLANK)), "tier", F.coalesce("asset_type", F.lit("")), "status_group"), 256)


def federated(libraries: dict[str, DataFrame], spec: SearchSpec) -> DataFrame:
    """One search over several libraries: equal statements merge, the best score wins."""
    from dataclasses import replace

    per_library = max(4 * spec.limit, 40)
    parts = []
    for name, knowledge in libraries.items():
        found = search(knowledge, replace(spec, limit=per_library)).select("record_id", "score")
        parts.append(found.join(knowledge.select("record_id", knowledge_key().alias("key")), "record_id").withColumn("library", F.lit(name)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = every.groupBy("key").agg(
        F.round(F.max("score"), 6).alias("score"),
        F.count("*").alias("duplicate_count"),
        F.min_by(F.struct("library", "record_id"), F.struct((-F.col("score")).alias("s"), "library", "record_id")).alias("best"),
        F.array_join(F.array_sort(F.collect_set("library")), ",").alias("libraries"),
    )
    return merged.select("best.record_id", "best.library", "score", "duplicate_count", "libraries").orderBy(F.desc("score"), F.desc("duplicate_count"), "record_id", "library").limit(spec.limit)
