"""Scalar text functions as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from histlake.functions import constants as C

#: All 29 characters that Unicode-aware pattern engines take as blanks, and the four separators.
BLANK = r"(?U)[\s\x1c-\x1f]+"
#: The six ASCII blanks, for places where another engine must agree.
ASCII_BLANK = r"[ \t\n\r\f\x0B]+"

# Marks between the parts of a projected text
STAGE_MARKS = ("\n[semantic projection: middle sample]\n", "\n[semantic projection: tail sample]\n")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(text: str | Column, blank: str = BLANK) -> Column:
    """Blanks collapsed to one, none at the ends."""
    return F.trim(F.regexp_replace(_col(text), blank, " "))


def truncate(text: str | Column, limit: int, mark: str = "...", blank: str = BLANK) -> Column:
    """Normalized; if longer than ``limit``, cut so that it fits with the mark."""
    t = normalize_text(text, blank)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - len(mark))), F.lit(mark)))


def canonical_json(text: str | Column) -> Column:
    """Keys sorted, no blanks (Variant's form); null for what isn't JSON."""
    return F.to_json(F.try_parse_json(_col(text)))


def json_literal(value: str | Column) -> Column:
    """A string as a JSON string."""
    v = _col(value)
    inner = F.to_json(F.struct(v.alias("v")))
    return F.when(v.isNull(), F.lit("null")).otherwise(F.substring(inner, F.lit(6), F.length(inner) - 6))


def stable_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    """prefix-hash over the parts' JSON forms. Strings are quoted, numbers bare, nulls 'null'."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, length))


def slug(text: str | Column, limit: int = 64) -> Column:
    """Lower case, runs of other characters as one dash, none at the ends."""
    dashed = F.regexp_replace(F.lower(_col(text)), r"(?U)[^\w.-]+", "-")
    return F.substring(F.regexp_replace(dashed, r"^[-.]+|[-.]+$", ""), 1, limit)


def human_bytes(n: str | Column, digits: int = 1) -> Column:
    """1536 -> 1.5 KiB."""
    v = _col(n).cast("double")
    out = F.format_string("%d B", _col(n).cast("long"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(v >= 1024.0**k, F.format_string(f"%.{digits}f {unit}", v / 1024.0**k)).otherwise(out)
    return out


def strip_environment(text: str | Column) -> Column:
    """Without <environment_context> blocks."""
    return F.regexp_replace(_col(text), r"(?is)<environment_context>.*?</environment_context>\s*", "")


def person_text(text: str | Column) -> Column:
    """What a person wrote: no environment block, normalized."""
    return normalize_text(strip_environment(text))


def semantic_projection(text: str | Column, limit: int = C.PROJECTION_CHARS) -> Column:
    """Long texts as head (40 %), middle (25 %) and tail with marks between, ``limit`` characters in all."""
    t = _col(text)
    room = limit - sum(map(len, STAGE_MARKS))
    head, middle = int(room * 0.40), int(room * 0.25)
    tail = room - head - middle
    n = F.length(t)
    start = F.greatest(F.lit(0), F.floor(n / 2).cast("int") - middle // 2)
    cut = F.concat(
        F.substring(t, 1, head), F.lit(STAGE_MARKS[0]), F.substring(t, start + 1, F.lit(middle)), F.lit(STAGE_MARKS[1]), F.substring(t, n - tail + 1, F.lit(tail))
    )
    return F.when(n <= limit, t).otherwise(cut)


def sentence_parts(text: str | Column) -> Column:
    """Sentences: cut after . ! ? and their full-width forms before blanks, and at line ends."""
    marked = F.regexp_replace(_col(text), r"([.!?。！？])[ \t\n\r\f\x0B]+|\n+", "$1\u001f")
    return F.filter(F.split(marked, "\u001f"), lambda p: F.trim(p) != "")


def event_category(role: str | Column) -> Column:
    out = F.lit("event")
    for name, category in C.EVENT_CATEGORIES.items():
        out = F.when(_col(role) == name, F.lit(category)).otherwise(out)
    return out


def _found(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?iu){pattern}"), F.lit(False))


def event_status(role: str | Column, text: str | Column) -> Column:
    """struct(status, status_group, confidence) of an event; a word of failure outweighs one of success."""
    r, t = _col(role), F.coalesce(_col(text), F.lit(""))
    low = F.lower(t)

    def out(status: str, group: str, confidence: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(group).alias("status_group"), F.lit(confidence).alias("confidence"))

    goal = (
        F.when(low.contains("[complete]") | low.contains("[completed]"), out("goal_complete", "executed", "direct_goal_state"))
        .when(low.contains("[failed]"), out("failed", "failed", "direct_goal_state"))
        .when(low.contains("[blocked]"), out("blocked", "blocked", "direct_goal_state"))
        .otherwise(out("active", "planned", "direct_goal_state"))
    )
    output = (
        F.when(_found(t, C.FAILURE), out("failed", "failed", "direct_tool_output"))
        .when(_found(t, C.VERIFIED), out("verified", "verified", "direct_tool_output"))
        .otherwise(out("executed", "executed", "direct_tool_output"))
    )
    return (
        F.when(r == "goal", goal)
        .when(r == "tool_call", out("executed", "executed", "direct_tool_call"))
        .when(r == "tool_output", output)
        .when(r == "assistant", out("reported_outcome", "mixed", "assistant_report"))
        .otherwise(out("stated_intent", "planned", "user_statement"))
    )


def asset_types(role: str | Column, text: str | Column) -> Column:
    """Kinds of asset that a person's statement or a goal gives, in fixed order."""
    r, t = _col(role), F.coalesce(_col(text), F.lit(""))
    user, low = r == "user", F.lower(t)
    open_goal = (r == "goal") & ~low.contains("[complete]") & ~low.contains("[completed]")
    kinds = F.array(
        F.when(user & _found(t, C.PREFERENCE), F.lit("preferences")),
        F.when(user & _found(t, C.DECISION), F.lit("decisions")),
        F.when(user & _found(t, C.FAILURE), F.lit("failures")),
        F.when((user & _found(t, C.UNRESOLVED)) | open_goal, F.lit("unresolved")),
    )
    return F.filter(kinds, lambda k: k.isNotNull())


def attachment_kind(mime: str | Column, name: str | Column) -> Column:
    """image, pdf, text, archive or document."""
    m, ext = F.lower(F.coalesce(_col(mime), F.lit(""))), F.lower(F.regexp_extract(F.coalesce(_col(name), F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(m.startswith("image/") | ext.isin("png", "jpg", "jpeg", "gif", "webp", "bmp", "svg"), F.lit("image"))
        .when((m == "application/pdf") | (ext == "pdf"), F.lit("pdf"))
        .when(m.startswith("text/") | (m == "application/json") | ext.isin("txt", "md", "json", "jsonl", "csv", "tsv", "log", "yaml", "yml", "toml", "xml", "html", "py", "js", "ts", "sh"), F.lit("text"))
        .when(ext.isin("zip", "gz", "tar", "tgz", "bz2", "xz", "7z"), F.lit("archive"))
        .otherwise(F.lit("document"))
    )


def remap_path(path: str | Column, mappings: list[tuple[str, str]]) -> Column:
    """struct(mapped, original) by the longest matching prefix (of equal ones, the last); drive letters in any case.

    ``original`` is null where no prefix matches. Mappings are configuration: a handful.
    """
    p = _col(path)
    slashed = F.regexp_replace(p, r"\\", "/")
    out = F.struct(p.alias("mapped"), F.lit(None).cast("string").alias("original"))
    ordered = sorted(enumerate(mappings), key=lambda x: (len(x[1][0].replace("\\", "/")), x[0]))
    for _, (prefix, local) in ordered:
        prefix = prefix.replace("\\", "/")
        drive = len(prefix) > 2 and prefix[1] == ":" and prefix[0].isalpha()
        mine, theirs = (F.lower(slashed), prefix.lower()) if drive else (slashed, prefix)
        match = (mine == theirs) | mine.startswith(theirs.rstrip("/") + "/")
        rest = F.regexp_replace(F.substring(slashed, F.lit(len(prefix) + 1), F.length(slashed)), r"^/+", "")
        mapped = F.when(rest == "", F.lit(local)).otherwise(F.concat(F.lit(local.rstrip("/") + "/"), rest))
        out = F.when(match, F.struct(mapped.alias("mapped"), p.alias("original"))).otherwise(out)
    return out


def safe_cas_path(path: str | Column) -> Column:
    """A path within the content store, without its leading folder; null if it is absolute or climbs."""
    p = F.regexp_replace(_col(path), r"\\", "/")
    bad = p.startswith("/") | p.rlike(r"^[A-Za-z]:") | p.rlike(r"(^|/)\.\.(/|$)") | (p == "")
    return F.when(~bad, F.regexp_replace(p, r"^(\./)*(cas/)?", ""))
