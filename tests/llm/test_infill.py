"""Fill-in-the-middle: against a loop over characters, and exact restoration."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from histlake.llm.infill import infill_documents, restored


def by_hand(doc_id, text, percent=100, spm=50, seed=7, pattern=r"[^\n]*\n|[^\n]+", marks=("<P>", "<S>", "<M>")):
    t = text or ""
    units = re.findall(pattern, t)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in marks) or h[2] % 100 >= percent:
        return n, "plain", None, None, t
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m
    return n, "psm", len(p), len(m), marks[0] + p + marks[1] + s + marks[2] + m


ODD_TEXTS = [
    "\n", "\n\n\n", "a", "a\n", "\nb", "x<P>y\nz", "a<S>\n", "<M>", "<", "<P\n>S>\n<", "\U0001f600é\n \r\nß<\nM>", "  \t\n \n", "<\n<\n<\n", "P>\nS>\nM>\n", "\r\n" * 5, "l\n" * 30_000,
]


@pytest.fixture(scope="module")
def texts(odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows] + [(100 + i, t) for i, t in enumerate(ODD_TEXTS * 3)]
    return rows + [(7, "one\ntwo\n"), (7, "one\ntwo\nthree\n"), (0, "zero\nnull\n"), (None, "zero\nnull\n")]


@pytest.mark.parametrize("percent, spm", [(100, 50), (40, 0), (0, 50), (70, 100)])
def test_every_row_as_by_hand(spark, texts, percent, spm):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    made = infill_documents(docs, percent=percent, spm_percent=spm).withColumn("back", restored())
    got = sorted([tuple(r[c] for c in ("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "back")) for r in made.collect()], key=repr)
    want = sorted([(i, t, *by_hand(i, t, percent, spm), t or "") for i, t in texts], key=repr)
    assert got == want


def test_units_and_sentinels_of_ones_own(spark, texts):
    marks, words = ("{pre}", "{suf}", "{mid}"), r"[^ ]* |[^ ]+"
    docs = spark.createDataFrame(texts[:12], "doc_id long, text string")
    made = infill_documents(docs, units=words, sentinels=marks, seed=3).withColumn("back", restored(sentinels=marks))
    for r in made.collect():
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == by_hand(r["doc_id"], r["text"], seed=3, pattern=words, marks=marks)
        assert r["back"] == (r["text"] or "")
    with pytest.raises(ValueError, match="sentinels"):
        infill_documents(docs, sentinels=("<P>", "<S>", "<S>"))
    with pytest.raises(ValueError, match="sentinels"):
        infill_documents(docs, sentinels=("<P<", "<S>", "<M>"))


def test_other_columns_stay_and_outputs_are_replaced(spark, odd, odd_rows, empty):
    made = infill_documents(odd.withColumn("Form", F.lit("own")).withColumn("low", F.lit(1)).withColumn("length", F.lit(2)))
    assert made.columns == [*odd.columns, "low", "length", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(repr(tuple(r)[:10]) for r in made.collect()) == sorted(repr(tuple(r)) for r in odd.collect())
    assert made.count() == len(odd_rows)
    assert infill_documents(empty).count() == 0


def test_many_rows_alike(spark):
    docs = spark.range(5000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("a\nb\nc\n").alias("text")).repartition(4)
    made = infill_documents(docs)
    assert [tuple(r) for r in made.distinct().collect()] == [(3, "a\nb\nc\n", *by_hand(3, "a\nb\nc\n"))] and made.count() == 5000


def test_texts_meet_their_offsets_by_one_exchange(spark, tmp_path):
    """On tables too large to broadcast: the text is exchanged once, the units without it."""
    spark.range(300).selectExpr("id doc_id", "repeat(concat('line ', id, '\n'), 20) text").write.parquet(f"{tmp_path}/d")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = infill_documents(spark.read.parquet(f"{tmp_path}/d"))
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "Window" not in plan
        assert all(tuple(r)[2:] == by_hand(r["doc_id"], r["text"]) for r in made.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
