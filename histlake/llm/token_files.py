"""Token files: one concatenated id array per shard, with Elias-Fano document boundaries.

A shard is one file, in ascending document order:

    "HLEF" | uint32 version | uint32 bytes per id (2 or 4) | uint32 JSON length | JSON | ids
    | boundaries | document ids

The JSON header holds counts and section lengths. The ids are little-endian. Boundaries (the
running count of ids after each document) and document ids (less the smallest) are both
non-decreasing, and both are stored by Elias-Fano: with n values below u, each value's
low floor(log2(u / n)) bits are packed, the rest are unary in a bit vector of at most 3n bits.
``select`` finds the i-th value by a sampled directory (one 32-bit place per 256 set bits)
and a scan of the words after it, so an offset takes a few cache lines and no 64-bit table.

Scale: the documents are range-partitioned by id (and, for ids that many rows repeat, by text
and place of the row); each task streams its documents into files of ``file_tokens`` ids at
most (or one document) under the shared folder, each written under a temporary name of its
attempt and renamed when whole, so that a lost executor leaves no half file. The manifest has
one row per file; each file's first position is a running sum over it. Python workers write
the files, so the folder must be one that they can reach: file, hdfs, s3 (s3a is taken as
s3), gs, or abfs; anything else is refused before any work.

Defined cases: a null text is empty (its document is the end id alone); null ids come last
and stay null; repeated ids keep all their rows, ordered by a hash of the text; an empty table
gives an empty manifest and no files; clashing names don't matter, as only id and text are read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histlake.llm.packing import tokenizer_path
from histlake.llm.tokens import worker_encoder
from histlake.sources import read_table, work_path

MAGIC, VERSION, SAMPLE = b"HLEF", 1, 256
MANIFEST = "file string, part long, block long, n_docs long, n_tokens long"
#: Names that Hadoop and Arrow give the same store.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


class EliasFano:
    """A non-decreasing sequence of non-negative integers in about 2 + log2(u / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if n == 0:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        low_bits = max(0, int(int(v[-1]) // n).bit_length() - 1)
        high = (v >> np.uint64(low_bits)).astype(np.int64)
        ones = high + np.arange(n)
        bits = np.zeros(-(-(int(ones[-1]) + 1) // 64) * 64, np.uint8)
        bits[ones] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        return cls(n, low_bits, low, words, ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        word = place // 64
        bits = int(self.high[word]) >> (place % 64) << (place % 64)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        high = word * 64 + (bits & -bits).bit_length() - 1 - i
        return high << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        part = self.low[first // 8 : -(-(first + self.low_bits) // 8)].tobytes()
        return int.from_bytes(part, "little") >> (first % 8) & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        """All values at once."""
        if self.n == 0:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<QIIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.samples.astype("<u4").tobytes() + self.high.astype("<u8").tobytes() + self.low.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, n_low, n_high, n_samples = struct.unpack_from("<QIIII", data)
        at = struct.calcsize("<QIIII")
        samples = np.frombuffer(data, "<u4", n_samples, at)
        high = np.frombuffer(data, "<u8", n_high, at + 4 * n_samples)
        low = np.frombuffer(data, np.uint8, n_low, at + 4 * n_samples + 8 * n_high)
        return cls(n, low_bits, low, high, samples)


def encode_shard(ids: list[np.ndarray], names: list[int | None], id_bytes: int) -> bytes:
    """A whole file. ``names``: ascending, nulls last."""
    known = np.array([x for x in names if x is not None], dtype=np.int64)
    least = int(known[0]) if len(known) else 0
    bounds = EliasFano.of(np.cumsum([len(x) for x in ids])).to_bytes()
    doc_ids = EliasFano.of((known.astype(np.uint64) - np.uint64(least % 2**64))).to_bytes()
    body = b"".join(x.astype(f"<u{id_bytes}").tobytes() for x in ids)
    head = json.dumps({"docs": len(ids), "null_ids": len(names) - len(known), "least_id": least, "ids": len(body), "bounds": len(bounds), "doc_ids": len(doc_ids)}).encode()
    return MAGIC + struct.pack("<III", VERSION, id_bytes, len(head)) + head + body + bounds + doc_ids


class TokenShard:
    """A read shard: document i has ids ``start(i)`` to ``start(i + 1)``."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        version, self.id_bytes, n_head = struct.unpack_from("<III", data, 4)
        if version != VERSION:
            raise ValueError(f"version {version}")
        self.head = json.loads(data[16 : 16 + n_head])
        at = 16 + n_head
        self.ids = np.frombuffer(data, f"<u{self.id_bytes}", self.head["ids"] // self.id_bytes, at)
        at += self.head["ids"]
        self.bounds = EliasFano.from_bytes(data[at : at + self.head["bounds"]])
        at += self.head["bounds"]
        self.doc_ids = EliasFano.from_bytes(data[at : at + self.head["doc_ids"]])

    def __len__(self) -> int:
        return self.head["docs"]

    def start(self, i: int) -> int:
        return self.bounds.select(i - 1) if i else 0

    def name(self, i: int) -> int | None:
        return self.doc_ids.select(i) + self.head["least_id"] if i < self.doc_ids.n else None

    def entries(self) -> tuple[list[int | None], np.ndarray]:
        """Names of the documents, and their starts with the last one's end, each by select."""
        return [self.name(i) for i in range(len(self))], np.array([self.start(i) for i in range(len(self) + 1)], dtype=np.int64)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.start(i) : self.start(i + 1)]


def _filesystem(uri: str):
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    try:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{colon}{rest}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as error:
        raise ValueError(f"token files need a folder that Python workers can reach (file, hdfs, s3, gs, abfs), not {uri}") from error


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    path: str,
    *,
    end_id: int = 2,
    id_bytes: int = 4,
    file_bytes: int = 32 << 20,
    file_tokens: int = 1 << 23,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write all documents under ``path``; the manifest: file, part, block, n_docs, n_tokens, first_token.

    ``file_bytes``: text a task gets on average.
    """
    _filesystem(path)
    schema = pa.schema([("file", pa.string()), ("part", pa.int64()), ("block", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        encoder = worker_encoder(tokenizer)
        end = np.array([end_id], dtype=f"<u{id_bytes}")
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        block = tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, names, block, tokens
            store, base = _filesystem(path)
            store.create_dir(base, recursive=True)
            name = f"part-{task.partitionId():06d}-{block:06d}.hlef"
            temporary = f"{base}/.{name}.{task.taskAttemptId()}"
            with store.open_output_stream(temporary) as out:
                out.write(encode_shard(ids, names, id_bytes))
            store.move(temporary, f"{base}/{name}")
            row = {"file": [f"{path}/{name}"], "part": [task.partitionId()], "block": [block], "n_docs": [len(ids)], "n_tokens": [tokens]}
            ids, names, block, tokens = [], [], block + 1, 0
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for name, found in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    if ids and tokens + len(found) >= file_tokens:
                        yield flush()
                    ids.append(np.concatenate([found.astype(end.dtype), end]))
                    names.append(name)
                    tokens += len(found) + 1
        if ids:
            yield flush()

    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    total = narrow.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_files = max(1, -(-total // file_bytes))
    # rows that repeat an id and a text are alike, so their place only spreads them
    order = [F.col("i").asc_nulls_last(), F.col("x"), F.col("spread")]
    spread = narrow.withColumns({"x": F.xxhash64("t"), "spread": F.pmod(F.monotonically_increasing_id(), F.lit(1024))})
    ordered = spread.repartitionByRange(n_files, *order).sortWithinPartitions(*order).select("i", "t")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    before = Window.partitionBy(F.lit(0)).orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start (over all files), n_tokens, ids_crc32 (of the ids as uint32)."""

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = _filesystem(file)
                with store.open_input_stream(name) as source:
                    shard = TokenShard(source.read())
                names, places = shard.entries()
                starts, ends = places[:-1], places[1:]
                sums = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts + first), pa.array(ends - starts), pa.array(sums, pa.int64())], schema=schema)

    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first_token", "part", "block")) - 1
    parts = manifest.select("file", "first_token", place.alias("place"))
    n = max(1, int(manifest.count()))
    return parts.repartitionById(n, "place").select("file", "first_token").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = write_token_files(docs, tokenizer_path("word_bpe_49k.json"), work_path(spark, "tokens"), id_bytes=2)
    return read_token_files(manifest)
