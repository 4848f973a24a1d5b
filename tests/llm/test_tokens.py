"""Encoding, token files and packing: exact round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from histlake.llm.packing import assign, pack_documents, tokenizer_path
from histlake.llm.token_files import EliasFano, TokenShard, encode_shard, read_token_files, write_token_files
from histlake.llm.tokens import ChunkEncoder
from histlake.sources import work_path

ALPHABET = " \n\t\r\x0b\x0c\x1c\x85\xa0 　ab'sSΣσİé\xe9<|endoftext|> 12!?,.\U0001f600"


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_encode_as_whole_texts(name):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += ["", " ", "a\n\nb", "don't  stop 's", "<|endoftext|>x", "café " * 3000]
    encoder = ChunkEncoder(tokenizer_path(name), cache_bytes=100_000)
    assert encoder.kind != "whole"
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=700))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    coded = EliasFano.from_bytes(EliasFano.of(np.array(values, dtype=np.uint64)).to_bytes())
    assert coded.values().tolist() == values
    assert [coded.select(i) for i in range(len(values))] == values


def test_boundaries_are_small():
    bounds = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    assert len(EliasFano.of(bounds).to_bytes()) < 10_000 * 14 / 8


def test_shard_gives_documents_by_number():
    shard = TokenShard(encode_shard([np.arange(3), np.arange(5), np.arange(1)], [-7, 2**40, None], 2))
    assert [shard.name(i) for i in range(3)] == [-7, 2**40, None]
    assert [shard.document(i).tolist() for i in range(3)] == [[0, 1, 2], [0, 1, 2, 3, 4], [0]]


@pytest.mark.parametrize("file_bytes", [2000, 1 << 25])
def test_token_files_round_trip(spark, odd, odd_rows, file_bytes):
    path = tokenizer_path("word_bpe_49k.json")
    manifest = write_token_files(odd, path, work_path(spark, "t"), file_bytes=file_bytes, id_bytes=2)
    got = [tuple(r) for r in read_token_files(manifest).orderBy("start").collect()]
    encoder = ChunkEncoder(path)
    want, at = [], 0
    spark_hash = {r["text"]: r["x"] for r in odd.select("text", F.xxhash64("text").alias("x")).collect()}
    for row in sorted(odd_rows, key=lambda r: (r[0] is None, r[0] or 0, spark_hash[r[1]])):
        ids = np.append(encoder.encode([row[1] or ""])[0], 2).astype("<u4")
        want.append((row[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_token_files_of_rows_all_alike(spark):
    """One id in all rows, and none in as many: several files, none of more than its tokens."""
    rows = spark.range(4000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("some words of it").alias("text"))
    rows = rows.union(spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("none").alias("text"))).repartition(4)
    manifest = write_token_files(rows, tokenizer_path("word_bpe_49k.json"), work_path(spark, "t"), file_bytes=20_000, file_tokens=1500)
    files = manifest.collect()
    assert len({f["part"] for f in files}) > 3 and all(f["n_tokens"] <= 1500 for f in files) and sum(f["n_docs"] for f in files) == 8000
    got = [(r["start"], r["n_tokens"], r["doc_id"]) for r in read_token_files(manifest).orderBy("start").collect()]
    at = 0
    for start, n, _ in got:
        assert start == at
        at += n
    assert [d for _, _, d in got] == [3] * 4000 + [None] * 4000


def test_folders_that_workers_cannot_reach_are_refused(odd):
    with pytest.raises(ValueError, match="Python workers"):
        write_token_files(odd, tokenizer_path("word_bpe_49k.json"), "viewfs://store/t")


def test_a_very_long_text_is_cut_bit_by_bit(monkeypatch):
    from histlake.llm import tokens

    monkeypatch.setattr(tokens, "_CHARS", 50)
    monkeypatch.setattr(tokens, "_CHUNKS", 7)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = ChunkEncoder(tokenizer_path(name), cache_bytes=3000)
        texts = ["don't stop,  me now \n" * 40, "", "x"]
        assert [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_files_of_nothing(spark, empty):
    manifest = write_token_files(empty, tokenizer_path("word_bpe_49k.json"), work_path(spark, "t"))
    assert read_token_files(manifest).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 400), max_size=80))
def test_assignment_wastes_less_than_a_sequence(lengths):
    pieces = assign(lengths, 64, 1.0, 0.1)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, n, sequence, offset in pieces:
        by_doc[doc].append((start, n))
        by_sequence[sequence].append((offset, n))
    for doc, length in enumerate(lengths):
        assert sum(n for _, n in by_doc[doc]) == length
    for parts in [*by_doc.values(), *by_sequence.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
    assert all(sum(n for _, n in parts) <= 64 for parts in by_sequence.values())
    assert len(by_sequence) == -(-sum(lengths) // 64)


def test_assignment_balances_cost():
    rng = random.Random(1)
    pieces = assign([rng.randint(10, 300) for _ in range(400)], 1024, 1.0, 4 / 1024)
    cost = defaultdict(float)
    for _, _, n, sequence, _ in pieces:
        cost[sequence] += n + 4 / 1024 * n * n
    costs = sorted(cost.values())
    assert costs[-2] < 1.6 * costs[1]


def test_packed_documents(odd, odd_rows, empty):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = pack_documents(odd, path, block_tokens=4000).collect()
    encoder = ChunkEncoder(path)
    want = sorted(((r[0] if r[0] is not None else -1), np.append(encoder.encode([r[1] or ""])[0], 0).tolist()) for r in odd_rows)
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"] if r["doc_id"] is not None else -1].append(r)
        assert len(r["ids"]) == 4 * r["length"]
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024
    for doc in docs:
        assert sum(r["length"] for r in docs[doc]) == sum(len(ids) for d, ids in want if d == doc)
    one = sorted((r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in docs[25])
    assert [x for _, ids in one for x in ids] == next(ids for d, ids in want if d == 25)
    assert pack_documents(empty, path).count() == 0


def test_token_files_are_read_by_select(spark, tmp_path, monkeypatch):
    from histlake.llm import token_files as T
    from histlake.llm.packing import tokenizer_path

    docs = spark.createDataFrame([(3, "one two"), (9, ""), (None, "three"), (5, "four five six")], "doc_id long, text string")
    manifest = T.write_token_files(docs, tokenizer_path("word_bpe_49k.json"), f"file://{tmp_path}/t", id_bytes=2)
    read = {r["doc_id"]: (r["start"], r["n_tokens"]) for r in T.read_token_files(manifest).collect()}
    store, name = T._filesystem(manifest.first()["file"])
    shard = T.TokenShard(store.open_input_stream(name).read())
    monkeypatch.setattr(T.EliasFano, "values", None)
    names, places = shard.entries()
    assert names == [3, 5, 9, None]
    assert read == {d: (a, b - a) for d, a, b in zip(names, places[:-1], places[1:], strict=True)}
