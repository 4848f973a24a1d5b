"""Scalar functions against plain Python."""

import hashlib
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from histlake.functions import constants
from histlake.functions import queries as Q
from histlake.functions import text as T
from histlake.operators import digest, lexical, search


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


BLANKS = [c for c in map(chr, range(0x3001)) if re.match(r"\s", c)]


def test_normalize_takes_every_blank(spark):
    raw = "".join(f"{b}a{b}{b}" for b in BLANKS)
    assert one(spark, T.normalize_text("t"), t=raw) == re.sub(r"\s+", " ", raw).strip()
    assert one(spark, T.normalize_text("t"), t="\u200ba") == "\u200ba"


@pytest.mark.parametrize("n", [5, 19, 20, 21, 40])
def test_truncate(spark, n):
    raw = "ab  cd " * n
    flat = re.sub(r"\s+", " ", raw).strip()
    assert one(spark, T.truncate("t", 20), t=raw) == (flat if len(flat) <= 20 else flat[:17].rstrip() + "...")
    assert one(spark, T.truncate("t", 20, "…"), t=raw) == (flat if len(flat) <= 20 else flat[:19].rstrip() + "…")


def test_stable_id(spark):
    want = "x-" + hashlib.sha256('"a\\"b"\x1f7'.encode()).hexdigest()[:24]
    assert one(spark, T.stable_id("x", T.json_literal("t"), F.col("n").cast("string")), t='a"b', n=7) == want


def test_canonical_json(spark):
    assert one(spark, T.canonical_json("t"), t='{"b": 1, "a": [true, null]}') == '{"a":[true,null],"b":1}'
    assert one(spark, T.canonical_json("t"), t="{bad") is None


def test_projection_keeps_head_middle_and_tail(spark):
    raw = "H" * 6000 + "M" * 6000 + "T" * 6000
    out = one(spark, T.semantic_projection("t"), t=raw)
    assert len(out) == 3900 and out.startswith("H" * 1530) and out.endswith("T" * 1340) and "M" * 956 in out
    assert one(spark, T.semantic_projection("t"), t="short") == "short"


@pytest.mark.parametrize(
    "role, text, status, group",
    [
        ("goal", "Goal [Complete]: x", "goal_complete", "executed"), ("goal", "Goal [active]: x", "active", "planned"), ("tool_output", "0 failed, 5 passed", "failed", "failed"),
        ("tool_output", "5 passed", "verified", "verified"), ("tool_output", "失败error", "failed", "failed"), ("tool_output", "fine", "executed", "executed"),
        ("tool_call", "error", "executed", "executed"), ("assistant", "x", "reported_outcome", "mixed"), ("user", None, "stated_intent", "planned"),
    ],
)
def test_status(spark, role, text, status, group):
    out = one(spark, T.event_status("r", "t"), r=role, t=text)
    assert (out["status"], out["status_group"]) == (status, group)


def test_assets(spark):
    assert one(spark, T.asset_types("r", "t"), r="user", t="we must, and decided; todo after the error") == ["preferences", "decisions", "failures", "unresolved"]
    assert one(spark, T.asset_types("r", "t"), r="goal", t="Goal [active]") == ["unresolved"]
    assert one(spark, T.asset_types("r", "t"), r="assistant", t="must") == []


def test_paths(spark):
    maps = [("/home", "/old"), ("C:\\Work", "/mnt/w"), ("/home/me", "/data")]
    got = {p: tuple(one(spark, T.remap_path("t", maps), t=p)) for p in ("c:\\work\\a", "/home/me/b", "/home/mex", "/etc/x", "/home/me")}
    assert got == {"c:\\work\\a": ("/mnt/w/a", "c:\\work\\a"), "/home/me/b": ("/data/b", "/home/me/b"), "/home/mex": ("/old/mex", "/home/mex"), "/etc/x": ("/etc/x", None), "/home/me": ("/data", "/home/me")}
    assert [one(spark, T.safe_cas_path("t"), t=p) for p in ("cas/ab/c", "ab/c", "/ab", "a/../b", "C:/x")] == ["ab/c", "ab/c", None, None, None]


def test_small_formats(spark):
    assert one(spark, T.slug("t"), t="  Héllo Wörld/x!! ") == "héllo-wörld-x"
    assert [one(spark, T.human_bytes("n"), n=n) for n in (5, 1536, 3 << 20)] == ["5 B", "1.5 KiB", "3.0 MiB"]
    assert one(spark, T.attachment_kind("m", "f"), m="", f="a.PDF") == "pdf"
    assert one(spark, T.sentence_parts("t"), t="One. Two!\n\nThree 。 four") == ["One.", "Two!", "Three 。", "four"]


def test_terms():
    assert Q.parse_terms('a -b "c d" -"e f" a', ["g "]) == (["a", "c d"], ["g", "b", "e f"])
    assert Q.alias_groups(["WSL2", "x"], [("wsl2", "wsl"), ("wsl", "linux")]) == [["WSL2", "wsl", "wsl2"], ["x"]]


def test_times():
    assert Q.parse_time("2025-01-02", end_of_day=True) == datetime(2025, 1, 2, 23, 59, 59, 999999, timezone.utc)
    assert Q.parse_time("2025-01-02T03:00:00+02:00") == datetime(2025, 1, 2, 1, tzinfo=timezone.utc)
    now = datetime(2025, 1, 10, tzinfo=timezone.utc)
    assert Q.recent_since("2w", now) == now - timedelta(days=14)
    with pytest.raises(ValueError):
        Q.recent_since("5x", now)


@pytest.mark.parametrize("value, want", [("7", (7, 7)), ("4:12", (4, 12)), (":5", (None, 5)), ("8:", (8, None)), (None, (None, None))])
def test_turn_ranges(value, want):
    assert Q.parse_turn_range(value) == want


@pytest.mark.parametrize("value", ["0", "5:4", "x", ":"])
def test_bad_turn_ranges(value):
    with pytest.raises(ValueError):
        Q.parse_turn_range(value)


def test_digest_ignores_order_and_partitions(spark):
    rows = [(i, None if i % 7 == 0 else f"t{i}") for i in range(500)]
    one_, two = (digest.table_digest(spark.createDataFrame(r, "a long, b string").repartition(n), ["a", "b"]).first() for r, n in ((rows, 3), (rows[::-1], 7)))
    assert one_ == two and one_["n_rows"] == 500
    other = digest.table_digest(spark.createDataFrame(rows[1:] + [(0, "")], "a long, b string"), ["a", "b"]).first()
    assert other["digest"] != one_["digest"]


KNOWLEDGE = "record_id string, scope_id string, scope_title string, tier string, asset_type string, category string, theme string, text string, status_group string, evidence_count long, occurred_start timestamp_ntz, occurred_end timestamp_ntz, asserted_at timestamp_ntz, indexed_at timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz, temporal_confidence string, retrieval_eligible boolean, derived_by string"


def record(i, text, tier="asset", title="plain", status="mixed", eligible=True, to=None, derived=None, scope="s"):
    at = datetime(2025, 1, 1) + timedelta(days=i)
    return (f"r{i}", scope, title, tier, "", "", "", text, status, 1, at, at, None, at, at, to, "", eligible, derived)


def test_search_order_and_rules(spark):
    rows = [
        record(1, "alpha beta"), record(2, "alpha  beta", scope="s2"), record(3, "alpha", "core"), record(4, "other", title="Alpha things"), record(5, "alpha hidden", eligible=False),
        record(6, "alpha closed", to=datetime(2025, 6, 1)), record(7, "alpha gamma"), record(8, None),
    ]
    df = spark.createDataFrame(rows, KNOWLEDGE)
    found = lambda **k: [r["record_id"] for r in search.search(df, search.SearchSpec(**k)).orderBy("rank").collect()]
    # of equal texts the shorter spelling ranks first; texts that differ in case are two results
    assert found(query="alpha beta") == ["r1", "r7", "r3", "r4"]
    top = search.search(df, search.SearchSpec("alpha beta")).orderBy("rank").first()
    assert top["duplicate_count"] == 1 and top["duplicates"] == "r2" and top["duplicate_scopes"] == "s2"
    assert found(query="alpha beta", mode="all") == ["r1"]
    assert found(query="alpha -gamma") == ["r1", "r3", "r4"]
    assert found(query="") == [] and found(query="", mode="all") == []
    assert found(query="alpha", filters=search.Filters(history=True, tiers=("asset",))) == ["r1", "r7", "r6", "r4"]
    assert set(found(query="alpha", filters=search.Filters(as_of=datetime(2025, 1, 7, 12, tzinfo=timezone.utc)))) == {"r1", "r3", "r4", "r6"}


def test_search_keeps_case_apart_and_leaves_outdated_assets_out(spark):
    rows = [record(1, "alpha beta"), record(2, "Alpha beta"), record(3, "alpha old", derived=constants.OUTDATED_CLASSIFIER), record(4, "alpha old", "core", derived=constants.OUTDATED_CLASSIFIER)]
    found = search.search(spark.createDataFrame(rows, KNOWLEDGE), search.SearchSpec("alpha")).orderBy("rank").collect()
    assert {r["record_id"] for r in found} == {"r1", "r2", "r4"} and all(r["duplicate_count"] == 0 for r in found)


def test_search_quotas_are_per_way_and_zero_similarity_ranks_last(spark):
    """A title match with no body match stays within its own quota; a similarity of 0 counts as none in the order."""
    rows = [record(i, f"alpha {i}") for i in range(200)] + [record(900, "other", title="alpha " * 9)]
    df = spark.createDataFrame(rows, KNOWLEDGE)
    found = search.search(df, search.SearchSpec("alpha", limit=1))
    assert found.count() == 1 and "WindowGroupLimit" in found._jdf.queryExecution().toString()
    wide = search.search(df, search.SearchSpec("alpha", limit=6))
    assert wide.count() == 6 and "r900" not in {r["record_id"] for r in wide.collect()}  # titles alone rank last
    near = spark.createDataFrame([("a", 0.0), ("b", -0.5)], "record_id string, similarity double")
    two = spark.createDataFrame([("a", *record(1, "x")[1:]), ("b", *record(1, "y")[1:])], KNOWLEDGE)
    got = search.search(two, search.SearchSpec("", mode="semantic"), near).orderBy("rank").collect()
    assert [r["record_id"] for r in got] == ["a", "b"]


def test_bm25_statistics_are_those_of_the_table(spark):
    table = spark.createDataFrame([(i, "alpha" if i < 3 else "gamma delta") for i in range(50)], "i long, t string")
    part = table.where("i in (0, 40)")
    whole = lexical.bm25(table, ["t"], ["alpha"]).where("i = 0").first()["bm25"]
    got = lexical.with_bm25(part, table, {"s": ["t"]}, [["alpha"]]).orderBy("i").collect()
    assert got[0]["s"] == whole and got[1]["s"] is None
