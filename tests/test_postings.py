"""Searches by an index give the rows of searches without one."""

import pytest
from pyspark.sql import functions as F

from histlake.operators import postings
from histlake.operators import search as S
from histlake.plans.projection import knowledge

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def records(spark):
    rows = knowledge(spark, SF)
    odd = [("q1", "Üben İst \U0001f600\U0001f600x"), ("q2", "a\nb"), ("q3", None), ("q4", "ab"), ("q5", "the the the"), ("q6", "l'été d'İstanbul"), ("q6", "l'été twice")]
    extra = spark.createDataFrame(odd, "record_id string, t string")
    like = rows.limit(1).drop("record_id", "text")
    return rows.unionByName(extra.crossJoin(like).withColumnRenamed("t", "text").select(*rows.columns)).cache()


@pytest.fixture(scope="module")
def index(spark, records, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    postings.build_index(records, path, block_rows=16)
    return postings.Index(spark, path)


def rows(df):
    return [tuple(r) for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize(
    "spec",
    [
        S.SearchSpec("anties mente pfer", limit=20),
        S.SearchSpec("tion src3", mode="all", limit=15),
        S.SearchSpec('ever -the -"scope src1"', limit=12),
        S.SearchSpec("wissen", aliases=(("wissen", "heit"), ("mente", "wissen"))),
        S.SearchSpec('"of the" "in the"', limit=None),
        S.SearchSpec("the", limit=25, filters=S.Filters(scopes=("src1", "src2"), tiers=("asset", "overview"), history=True)),
        S.SearchSpec("nowhere zzzzqq", limit=5),
        S.SearchSpec("zzzzqq the", mode="all"),
        S.SearchSpec("ab", limit=5),
        S.SearchSpec("", limit=5),
        S.SearchSpec("İst ÉTÉ", limit=5),
        S.SearchSpec('"\U0001f600\U0001f600x"', limit=5),
        S.SearchSpec("scope", limit=None),
    ],
    ids=lambda s: s.query or "none",
)
def test_same_rows(records, index, spec):
    assert rows(index.search(spec)) == rows(S.search(records, spec))


def test_semantic_candidates_are_found_too(spark, records, index):
    near = records.where("record_id in ('3', '8', 'q4')").select("record_id", F.lit(0.5).alias("similarity"))
    for spec in (S.SearchSpec("anties", limit=9), S.SearchSpec("anties", mode="semantic", limit=9)):
        assert rows(index.search(spec, near)) == rows(S.search(records, spec, near))


def test_blocks_without_candidates_are_not_opened(spark, records, index, tmp_path):
    found = index.candidates([["twice"]])
    assert 1 <= found.count() < 10 and index.docs.select("block").distinct().count() > 10
    plan = index.search(S.SearchSpec("twice"))._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [Or" in plan or "In(gram" in plan


def test_an_index_of_nothing(spark, records, tmp_path):
    postings.build_index(records.limit(0), f"file://{tmp_path}/i")
    assert postings.Index(spark, f"file://{tmp_path}/i").search(S.SearchSpec("the")).count() == 0


def test_long_texts_take_time_in_proportion(spark, records, tmp_path):
    import time

    text = " ".join(f"w{i:x}" for i in range(90_000))  # 600,000 characters
    long = records.where("record_id = '1'").withColumns({"record_id": F.lit("long"), "text": F.lit(text)})
    began = time.time()
    postings.build_index(long, f"file://{tmp_path}/i")
    index = postings.Index(spark, f"file://{tmp_path}/i")
    spec = S.SearchSpec("w15f8f", filters=S.Filters(history=True))
    assert rows(index.search(spec)) == rows(S.search(long, spec)) != []
    assert time.time() - began < 60


def test_lists_of_texts_that_are_cut(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(postings, "SLICE_CHARS", 7)
    texts = ["abcabcabcabcdefghijkl", "ab", "", "\U0001f600\U0001f600xab", "bcabcabc"]
    titles = ["abc", "abc", "xyz", "", "scope"]
    batch = pa.RecordBatch.from_pydict({"block": [1, 1, 1, 2, 2], "place": [1, 2, 3, 1, 2], "body": texts, "title": titles})
    found = set()
    for out in postings.posting_lists(iter([batch])):
        for gram, block, places, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
            assert len(set(places)) == len(places) == n
            found |= {(gram, block, p) for p in places}
    where = [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]
    assert found == {(t[i : i + 3], *at) for at, *both in zip(where, texts, titles) for t in both for i in range(len(t) - 2)}
