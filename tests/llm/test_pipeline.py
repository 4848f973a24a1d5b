"""The stages one by one: columns, effect, and what each leaves alone."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from test_dups import brute, shingles
from test_native import brute_lines

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    sentence = lambda: " ".join("".join(rng.choice(["ta", "ri", "mo", "len", "ka"]) for _ in range(rng.randint(1, 4))) for _ in range(14))
    rows, labels = [], []
    for doc in range(240):
        t = "\n".join(sentence() for _ in range(rng.randint(2, 6)))
        good = doc % 6 != 0
        if not good:
            t = " ".join(w + "***" for w in t.split())
        elif doc % 10 == 5:
            w = rows[doc - 4][1].split(" ")
            w[2] = "changed"
            t = " ".join(w)
        rows.append((doc, t, "en", f"s{doc % 4}", len(t)))
        labels.append((doc, int(good), 0))
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0)]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, dict((d, g) for d, g, _ in labels)


def test_stages(spark, folder):
    path, rows, good = folder
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.write_and_read(stage(spark, docs, path), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = [tuple(r) for r in docs.collect()]
    first = {r[0] for r in kept["quality"]}
    assert sum((d in first) == bool(g) for d, g in good.items()) > 0.97 * len(good)
    want = brute_lines([r[:2] for r in kept["quality"]])
    got = {r[0]: r[1] for r in kept["line_dedup"]}
    before = {r[0]: r[1] for r in kept["quality"]}
    assert got == {d: t for d, t in want.items() if (t or "").strip() or not (before[d] or "").strip()}
    assert all(r[4] == (len(r[1]) if r[1] is not None else None) for r in kept["line_dedup"])
    groups = brute([r[:2] for r in kept["line_dedup"]])
    assert sorted(r[0] for r in kept["near_dedup"]) == sorted(set(groups.values()))
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, mixed = sum(count(r[1]) for r in kept["near_dedup"]), sum(count(r[1]) for r in kept["mixing"])
    assert abs(mixed - 1.5 * total) <= 4
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    by = defaultdict(int)
    for p in pieces:
        by[p["sequence_id"]] += p["length"]
    assert max(by.values()) <= 1024
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0) == Counter(r[0] for r in kept["mixing"])
    assert shingles("a b c d e")
    assert corpus_pipeline.run(spark, path).count() > 0


def test_stages_on_an_empty_table(spark, folder, tmp_path):
    path = f"file://{tmp_path}"
    docs = spark.createDataFrame([], DOCUMENTS)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
