"""Logs to answers: build, ask, save, grow; and row streams and deltas."""

import pytest
from pyspark.sql import functions as F

from histlake.library import Library, federated_search
from histlake.operators import lifecycle
from histlake.operators.snapshots import Snapshots
from histlake.sources.rowfiles import apply_delta, export_delta, read_row_stream, write_row_stream
from test_ingest import line, transcript


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("logs")
    for t in ("a", "b"):
        (top / f"{t}.jsonl").write_text("\n".join(transcript(t)) + "\n", encoding="utf-8")
    child = transcript("c")
    child[0] = line("session_meta", {"id": "c", "parent_thread_id": "a"})
    child.append(line("event_msg", {"type": "thread_goal_updated", "goal": {"status": "complete", "objective": "ship"}}, 9))
    (top / "c.jsonl").write_text("\n".join(child) + "\n", encoding="utf-8")
    return top


@pytest.fixture(scope="module")
def lib(spark, folder):
    return Library.build(spark, f"file://{folder}")


def test_tables(lib):
    assert {r["thread_id"]: r["turn_count"] for r in lib.threads.collect()} == {"a": 1, "b": 1, "c": 1}
    tiers = {r["tier"]: r["count"] for r in lib.knowledge.groupBy("tier").count().collect()}
    assert tiers == {"core": 3 * 6 + 1, "asset": 3, "fact_block": 3, "overview": 3}
    fact = lib.knowledge.where("tier = 'fact_block' and scope_id = 'a'").first()["text"]
    assert fact == "Intent: fix it please\nTools: shell\nEvidence: 5 passed\nOutcome: done"
    same = lib.evidence.where("occurrence_count = 3").count()
    assert same >= 4
    assert [(r["family_root"], r["members"]) for r in lib.families.collect()] == [("a", "a,c")]
    assert lib.relations.where("relation = 'validates'").count() == 4  # an output per thread, and a goal
    assert all(r["ok"] for r in lib.audit().collect())
    assert lib.knowledge.select("record_id").distinct().count() == lib.knowledge.count()


def test_questions(lib, folder, tmp_path):
    assert lib.search("passed", limit=3).count() > 0
    assert lib.context("passed").count() > 0
    assert lib.unresolved().count() == 3 and lib.asset("decisions").count() == 0
    record = lib.relations.first()["source"]
    found = lib.trace(record)
    assert found["record"].count() == 1 and found["occurrences"].count() == 3 and found["relations"].count() == 1
    with pytest.raises(LookupError):
        lib.trace("record-")
    shots = Snapshots(lib.events.sparkSession, f"file://{tmp_path}/shots", chunk_bytes=200)
    shots.take(f"file://{folder}")
    raw = lib.trace(record, shots)["raw"].collect()
    assert len(raw) == 3 and all(r["raw"] == (folder / f"{r['thread_id']}.jsonl").read_text().split("\n")[r["line_no"] - 1] for r in raw)
    talk = [(r["role"], r["text"]) for r in lib.conversation(["a"]).collect()]
    assert talk == [("user", "fix it\nplease"), ("assistant", "done")]
    assert lib.conversation(["a"], turns="2:").count() == 0
    assert lib.compare("a", "b").count() > 0
    assert federated_search({"x": lib, "y": lib}, "passed").first()["libraries"] == "x,y"
    assert {r["table_name"] for r in lib.stats().collect()} >= {"threads", "events"}
    assert lib.list_threads("a").count() == 1 and lib.claims_of("a").count() > 0 and lib.coverage().count() == 4


def test_save_and_grow(spark, lib, folder, tmp_path):
    lib.save(f"file://{tmp_path}/lib")
    again = Library.open(spark, f"file://{tmp_path}/lib")
    want = {r["name"]: r["digest"] for r in lib.digests().collect()}
    assert {r["name"]: r["digest"] for r in again.digests().collect()} == want
    grown = tmp_path / "logs"
    grown.mkdir()
    for t in ("a", "b"):
        extra = [line("event_msg", {"type": "user_message", "message": "more"}, 20)] if t == "a" else []
        (grown / f"{t}.jsonl").write_text("\n".join(transcript(t) + extra) + "\n", encoding="utf-8")
    (grown / "d.jsonl").write_text("\n".join(transcript("d")) + "\n", encoding="utf-8")
    later = Library.build(spark, f"file://{grown}")
    assert {r["thread_id"]: r["kind"] for r in later.changes(lib).collect()} == {"a": "appended", "b": "unchanged", "c": "deleted", "d": "added"}
    assert later.generation() != lib.generation()


def test_row_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, None, 2.5)], "k long, t string, x double")
    path = f"file://{tmp_path}/s"
    write_row_stream(rows, path, "things")
    assert sorted(read_row_stream(spark, path).collect()) == sorted(rows.collect())
    rows.limit(1).write.mode("append").json(f"{path}/rows")
    with pytest.raises(ValueError):
        read_row_stream(spark, path)


def test_deltas(spark, tmp_path):
    old = {"t": spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, t string")}
    new = {"t": spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "k long, t string")}
    path = f"file://{tmp_path}/d"
    export_delta(old, new, {"t": ["k"]}, path)
    assert spark.read.parquet(f"{path}/t/upserts").count() == 2
    got = apply_delta(spark, old, {"t": ["k"]}, path)["t"]
    assert sorted(got.collect(), key=lambda r: r["k"]) == sorted(new["t"].collect(), key=lambda r: r["k"])
    assert got.where(F.col("k") == 3).count() == 0


def test_an_empty_row_stream_reads_back(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    write_row_stream(spark.createDataFrame([], "a long, b string"), path, "nothing")
    assert read_row_stream(spark, path).count() == 0


def test_upsert_replaces_a_null_key(spark):
    old = spark.createDataFrame([(None, "old"), (1, "one")], "k long, v string")
    new = spark.createDataFrame([(None, "new"), (2, "two")], "k long, v string")
    assert sorted((r["k"] or 0, r["v"]) for r in lifecycle.upsert(old, new, ["k"]).collect()) == [(0, "new"), (1, "one"), (2, "two")]
    assert [tuple(r) for r in lifecycle.new_rows(new, old, ["k"]).collect()] == [(2, "two")]


def test_deleting_a_thread_takes_what_only_it_showed(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "threads": frame([("a",), ("b",)], "thread_id string"),
        "occurrences": frame([("a", "e1"), ("a", "e2"), ("b", "e2"), ("b", "e3")], "thread_id string, evidence_id string"),
        "evidence": frame([("e1",), ("e2",), ("e3",)], "evidence_id string"),
        "bridge": frame([("r1", "e1"), ("r2", "e1"), ("r2", "e2")], "record_id string, evidence_id string"),
        "knowledge": frame([("r1",), ("r2",), ("r3",)], "record_id string"),
        "claims": frame([("r1", 1), ("r2", 1)], "record_id string, ordinal int"),
        "relations": frame([("e3", "validates", "e1"), ("e3", "validates", "e2"), ("r1", "refines", "r2")], "source string, relation string, target string"),
    }
    left = {n: sorted(tuple(r) for r in t.collect()) for n, t in lifecycle.delete_threads(tables, frame([("a",)], "thread_id string")).items()}
    assert left["threads"] == [("b",)] and left["evidence"] == [("e2",), ("e3",)] and left["bridge"] == [("e2", "r2")]
    assert left["knowledge"] == [("r2",), ("r3",)] and left["claims"] == [("r2", 1)] and left["relations"] == [("e3", "validates", "e2")]


def test_semantic_and_hybrid_search(lib):
    texts = lib.semantic_texts()
    told = F.when(F.col("content").contains("passed"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    vectors = texts.select("doc_id", told.alias("vector"))
    found = lib.search("", mode="semantic", vectors=vectors, vector=[1.0, 0.0], limit=20).orderBy("rank").collect()
    near = lib.knowledge.where(F.col("text").contains("passed"))
    best = {r["record_id"] for r in near.select("record_id").collect()}
    n = near.select("tier", "text").distinct().count()  # equal texts of a tier are one result
    assert n > 0 and [r["record_id"] in best for r in found] == [True] * n + [False] * (len(found) - n)
    hybrid = lib.search("fix", vectors=vectors, vector=[1.0, 0.0], limit=5)
    assert hybrid.count() == 5
    with pytest.raises(ValueError):
        lib.search("fix", mode="semantic")
