"""Mixing, sharding and line dedup against brute force in plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from histlake.llm.line_dedup import dedup_lines
from histlake.llm.mixing import mix_documents, mix_plan
from histlake.llm.sharding import shard_documents, write_shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def fill(sizes, weights, ratio, epochs):
    budget, targets, free = ratio * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        level = (budget - sum(targets[i] for i in range(len(sizes)) if i not in free)) / sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * level > epochs * sizes[i]}
        if not over:
            for i in free:
                targets[i] = weights[i] * level
            break
        for i in over:
            targets[i] = float(epochs * sizes[i])
        free -= over
    return targets


def queue(rows, packet, ratio=1.5, epochs=2, weights=(5, 2, 1)):
    """Words taken of each (source, id, text), and the targets: sources send packets in turn, whichever would finish first."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None] * any(r[2] is None for r in rows)
    docs = {s: sorted((md5(f"mix:{'null' if r[0] is None else r[0]}:{md5(r[1] or '')}"), n, len(words(r[1]))) for n, r in enumerate(rows) if r[2] == s) for s in names}
    sizes = [sum(d[2] for d in docs[s]) for s in names]
    targets = fill(sizes, [weights[i % len(weights)] for i in range(len(names))], ratio, epochs)

    def packets(k):
        sent = 0
        for _ in range(epochs):
            for _, n, size in docs[names[k]]:
                for at in range(0, size, packet):
                    sent += min(packet, size - at)
                    yield sent / targets[k], k, n, min(packet, size - at)

    waiting = [(p, it) for p, it in ((next(it, None), it) for it in map(packets, range(len(names)))) if p]
    left, taken = min(math.floor(ratio * sum(sizes) + 0.5), epochs * sum(sizes)), Counter()
    while left and waiting:
        first = min(range(len(waiting)), key=lambda i: waiting[i][0][:2])
        (_, _, n, size), it = waiting[first]
        taken[n] += min(size, left)
        left -= min(size, left)
        following = next(it, None)
        waiting[first : first + 1] = [(following, it)] if following else []
    return taken, dict(zip(names, targets, strict=True))


@pytest.mark.parametrize("packet", [7, 256])
def test_mix_matches_a_queue(spark, odd, odd_rows, packet):
    got = mix_plan(odd, packet_words=packet, bucket_rows=2).collect()
    taken, targets = queue(odd_rows, packet)
    assert Counter((r["doc_id"], r["text"], r["source"], int(r["size"]), r["taken"]) for r in got) == Counter((r[0], r[1], r[2], len(words(r[1])), taken[n]) for n, r in enumerate(odd_rows))
    for name, target in targets.items():
        assert abs(sum(r["taken"] for r in got if r["source"] == name) - target) <= 2 * packet
        assert all(abs(r["target"] - target) < 1e-6 for r in got if r["source"] == name)
    total = sum(int(r["size"]) for r in got)
    assert sum(r["taken"] for r in got) == math.floor(1.5 * total + 0.5)


def test_mix_of_rows_all_alike(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit(5)).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"))
    got = mix_plan(rows).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("taken").alias("most")).collect()
    assert sum(r["taken"] for r in got) == 135_000
    assert all(abs(r["taken"] - r["target"]) <= 6 and r["most"] <= 6 for r in got)


def test_mix_leaves_columns_of_its_own_names_alone(spark):
    rows = [(i, "some words here", "s", 17, "mine", "so", 1.5, "x", 3) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, size string, target string, finish double, taken string, source_size int")
    mixed = mix_documents(docs)
    assert mixed.dtypes == docs.dtypes
    assert {tuple(r)[4:] for r in mixed.collect()} == {("mine", "so", 1.5, "x", 3)}


def test_mix_gives_whole_documents_in_order(spark, odd):
    plan, mixed = mix_plan(odd).collect(), mix_documents(odd)
    assert mixed.columns == odd.columns
    rows = mixed.collect()
    assert sum(len(words(r["text"])) for r in rows) == sum(r["taken"] for r in plan)
    again = mix_documents(odd.repartition(5)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in again)


def test_empty_tables(empty):
    assert mix_plan(empty).count() == 0
    assert mix_documents(empty).count() == 0
    assert shard_documents(empty).count() == 0
    assert dedup_lines(empty).count() == 0


@pytest.mark.parametrize("bucket_bytes", [500, 1 << 20])
def test_shards_hold_every_row_once(odd, odd_rows, bucket_bytes, tmp_path):
    sharded = shard_documents(odd, 7, bucket_bytes=bucket_bytes)
    rows = sharded.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(x[:2] for x in odd_rows)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(7)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    key = lambda rs: sorted((r["doc_id"] or -1, zlib.crc32((r["text"] or "").encode()), r["shard"], r["slot"]) for r in rs)
    assert key(rows) == key(shard_documents(odd.repartition(6), 7, bucket_bytes=bucket_bytes).collect())
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["slot"], r["shard"]))]
    assert order != sorted(order, key=lambda x: (x is None, x))
    write_shards(sharded, f"file://{tmp_path}/shards")
    assert odd.sparkSession.read.parquet(f"file://{tmp_path}/shards").count() == len(rows)


def norm(line):
    return tuple(words(line.lower()))


def near(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_lines(rows, min_words=5, near_min_words=10):
    """doc_id -> text, for rows with distinct ids."""
    first = {}
    for doc, text in sorted(rows):
        for no, line in enumerate((text or "").split("\n") if text is not None else []):
            if len(norm(line)) >= min(min_words, near_min_words):
                first.setdefault(norm(line), (doc, no))
    long_lines = [w for w in first if len(w) >= near_min_words]
    bad = {a for a in long_lines for b in long_lines if first[b] < first[a] and near(a, b)}
    out = {}
    for doc, text in rows:
        if text is None:
            out[doc] = None
            continue
        out[doc] = "\n".join(
            x for no, x in enumerate(text.split("\n")) if not (norm(x) in bad or (norm(x) in first and len(norm(x)) >= min_words and first[norm(x)] < (doc, no)))
        )
    return out


def test_line_dedup_matches_all_pairs(spark):
    rng = random.Random(2)
    vocabulary = ["ab", "cd", "ef"]
    rows = []
    for doc in range(60):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 4, 5, 6, 7]))) for _ in range(6)]
        rows.append((doc, "\n".join(lines)))
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, "  AB\tcd  ef ab cd ef")]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), min_words=3, near_min_words=5).collect()}
    assert got == brute_lines(rows, 3, 5)


def test_line_dedup_on_odd_rows(odd, odd_rows):
    out = dedup_lines(odd)
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    assert {"n_lines", "n_exact_dropped", "n_near_dropped"} <= set(out.columns)
    texts = defaultdict(set)
    for r in rows:
        texts[r["doc_id"]].add(r["text"])
    assert texts[22] == {None} and texts[23] == {""} and texts[24] == {" \n\t\n"}
    assert texts[20] == {""}  # copies of document 0's lines
    assert texts[21] == {""}  # its first line is a copy, its second has one word more
    assert len(texts[20]) == 1


def test_line_dedup_takes_short_lines(spark):
    nine = "we thank all of our readers for their patience"
    five = "terms of use and privacy"
    rows = [(0, f"All rights reserved.\n{nine}\n{five}\nHome"), (1, f"all RIGHTS reserved.\n{nine} today\nterms of use or privacy\nhome\nhome page\n\n"), (2, "terms of sale\nterms of use")]
    got = {r["doc_id"]: (r["text"], r["n_exact_dropped"], r["n_near_dropped"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (rows[0][1], 0, 0), 1: ("home page\n\n", 2, 2), 2: (rows[2][1], 0, 0)}
    assert {d: t for d, (t, _, _) in got.items()} == brute_lines(rows, 1, 5)


def test_shards_of_rows_all_alike(spark):
    """No bucket takes all of a row that fills the table, with an id or without."""
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same words").alias("text"))
    rows = rows.union(spark.range(20_000).select(F.lit(7).alias("doc_id"), F.lit("other words").alias("text"))).repartition(5)
    out = shard_documents(rows, 7, bucket_bytes=20_000)
    counts = {r["shard"]: (r["n"], r["slots"], r["last"]) for r in out.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()}
    assert sorted(counts) == list(range(7)) and sum(n for n, _, _ in counts.values()) == 40_000
    assert all(n == slots == last + 1 and n in (5714, 5715) for n, slots, last in counts.values())
