"""Packing documents into training sequences, balanced by attention cost.

A piece of n tokens costs ``linear * n + quadratic * n**2`` (attention stays inside a piece).
A document longer than a sequence is first cut into full sequences; what is left of it, and
every shorter document, is assigned in descending length to the sequence of lowest cost so
far that has room for it. Where none has room for the whole, the piece is cut to fill the
roomiest ones, so a block of documents leaves less than one sequence of padding.

Scale: documents are packed in blocks within the task that reads them; there is no exchange
and nothing grows with the table. A block ends at ``block_tokens`` (some thousand sequences)
or with its partition; a worker holds a block of ids, a few texts and a cache of bounded bytes. Sequence ids are (partition, block, number) in one long, so they are
unique without any count over the table; a task that runs again gives the same ids.

Defined cases: a null text is an empty one: its document is the end id alone; a null id is
carried along; repeated rows are packed each; an empty table gives no rows; of clashing
names, only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histlake.llm.tokens import worker_encoder
from histlake.sources import read_table

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double"
BLOCK_BITS, SEQUENCE_BITS = 16, 22


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of these lengths, gapless in each sequence."""
    pieces: list[tuple[int, int, int, int, int]] = []
    n_full = 0
    rest: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths):
        for k in range(n // capacity):
            pieces.append((doc, k * capacity, capacity, n_full, 0))
            n_full += 1
        if n % capacity:
            rest.append((n % capacity, doc, n - n % capacity))
    n_open = -(-sum(n for n, _, _ in rest) // capacity)
    used = [0] * n_open
    cost = [0.0] * n_open
    price = lambda n: linear * n + quadratic * n * n
    # Sequences by cost. Those without room for a piece wait aside: pieces come in descending
    # length, so they are asked again when shorter pieces come.
    heap = [(0.0, s) for s in range(n_open)]
    aside: list[tuple[int, int]] = []  # (-room, sequence), roomiest first
    spill: list[tuple[int, int, int]] = []

    def put(s: int, doc: int, start: int, n: int) -> None:
        pieces.append((doc, start, n, n_full + s, used[s]))
        used[s] += n
        cost[s] += price(n)

    for n, doc, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        while aside and -aside[0][0] >= n:
            _, s = heapq.heappop(aside)
            heapq.heappush(heap, (cost[s], s))
        while heap:
            _, s = heapq.heappop(heap)
            if capacity - used[s] >= n:
                put(s, doc, start, n)
                if used[s] < capacity:
                    heapq.heappush(heap, (cost[s], s))
                break
            heapq.heappush(aside, (-(capacity - used[s]), s))
        else:
            spill.append((n, doc, start))
    room = sorted((s for s in range(n_open) if used[s] < capacity), key=lambda s: (used[s], s))
    for n, doc, start in spill:
        while n:
            s = room[0]
            part = min(n, capacity - used[s])
            put(s, doc, start, part)
            n, start = n - part, start + part
            if used[s] == capacity:
                room.pop(0)
    return pieces


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = 1024,
    end_id: int = 0,
    linear: float = 1.0,
    quadratic: float | None = None,
    block_tokens: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset, cost.

    ``quadratic`` defaults to 4 / capacity: at full length attention then costs four times the rest.
    """
    quad = 4.0 / capacity if quadratic is None else quadratic

    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("cost", pa.float64())]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_encoder(tokenizer)
        task = TaskContext.get().partitionId() << (BLOCK_BITS + SEQUENCE_BITS)
        block = 0
        ids: list[np.ndarray] = []
        names: list = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, ids, names, tokens
            base = task + (block << SEQUENCE_BITS)
            placed = assign([len(x) for x in ids], capacity, linear, quad)
            for at in range(0, len(placed), 1024):
                rows = placed[at : at + 1024]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": [names[d] for d, *_ in rows],
                        "start": [x[1] for x in rows],
                        "length": [x[2] for x in rows],
                        "ids": [ids[x[0]][x[1] : x[1] + x[2]].tobytes() for x in rows],
                        "doc_tokens": [len(ids[x[0]]) for x in rows],
                        "sequence_id": [base + x[3] for x in rows],
                        "offset": [x[4] for x in rows],
                        "cost": [linear * x[2] + quad * x[2] ** 2 for x in rows],
                    },
                    schema=schema,
                )
            block, ids, names, tokens = block + 1, [], [], 0

        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for name, found in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    ids.append(np.concatenate([found, end]))
                    names.append(name)
                    tokens += len(found) + 1
                    if tokens >= block_tokens:
                        yield from flush()
        if ids:
            yield from flush()

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t"))
    return narrow.mapInArrow(pack, PIECES)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_packing(spark, sf_dir):
    pieces = pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return with_crc(pieces)


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.selectExpr(
        "doc_id", "start", "length", "crc32(ids) as ids_crc32", "doc_tokens", "sequence_id", "`offset`", "cost"
    )


def crc32_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
