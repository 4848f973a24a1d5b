"""Search by an index: postings of character trigrams, so that a query reads what may match.

The index is three tables. ``docs`` are the records in blocks of some thousand, numbered within
each as a task writes them. ``postings`` have rows of a trigram and a block: the numbers of
records of the block that hold it, ascending, which Parquet keeps as differences (several rows
if the block was read in parts); rows are sorted by trigram, so a file's statistics tell Spark
which pages a query's trigrams can be in. ``facts`` are the row count and mean lengths that BM25
takes of the whole table.

A query's terms are cut into trigrams, of which the rarest are looked up: their lists are
intersected block by block (a term's trigrams), united (alternatives, other terms), and only
blocks with a candidate are opened (Spark prunes them by a broadcast of their numbers). They hold
all records with a term; the search that follows is the one without an index, on
them, and gives the same rows: a record without any term is found by neither, and how many
records hold a term is counted within. Terms of less than three characters have
no trigrams: then, as for a query without terms, all is read.

Scale: texts are cut in the tasks that read them, a slice of a million characters at a time, and
lists, not single trigrams, are exchanged, once; no list is longer than a block. A frequent
trigram is as many rows as there are slices. A query exchanges a row per block and trigram,
broadcasts a number per block, exchanges no text and opens texts in proportion to what it finds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from histlake.functions.queries import alias_groups, parse_terms
from histlake.operators.lexical import trigram_length
from histlake.operators.search import ENGINES, SearchSpec, body_text, search, title_text
from histlake.sources import remove, write, write_and_read

#: Parquet keeps ascending numbers as bit-packed differences.
DELTAS = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#places.list.element": "false"}
POSTINGS = "gram string, block long, places array<smallint>, n int"
_ROWS = pa.schema([("gram", pa.string()), ("block", pa.int64()), ("places", pa.list_(pa.int16())), ("n", pa.int32())])
#: So many of a term's trigrams, the rarest, are looked up.
LOOKED_UP = 4
#: Characters that are cut into trigrams at once.
SLICE_CHARS = 1 << 20


def grams_of(term: str) -> list[str]:
    low = term.lower()
    return list(dict.fromkeys(low[i : i + 3] for i in range(len(low) - 2)))


def slice_lists(texts: list[str], blocks: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Rows of ``POSTINGS`` for the distinct runs of three characters of texts, each of a block's place."""
    sizes = np.array([len(t) for t in texts])
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[:-2] == owner[2:]  # no run across texts
    keys = ((chars[:-2] << 42) | (chars[1:-1] << 21) | chars[2:])[inside]
    coded = pc.dictionary_encode(pa.array(keys))
    grams = coded.dictionary.to_numpy()
    pairs = np.unique(coded.indices.to_numpy().astype(np.int64) * len(texts) + owner[:-2][inside])
    code, text = np.divmod(pairs, len(texts))
    block, place = blocks[text], places[text]
    # a text in several parts, or a body and its title, are next to each other
    new_list = np.ones(len(pairs), bool)
    new_list[1:] = (code[1:] != code[:-1]) | (block[1:] != block[:-1])
    kept = new_list.copy()
    kept[1:] |= place[1:] != place[:-1]
    starts = np.flatnonzero(new_list[kept])
    place = place[kept].astype(np.int16)
    offsets = np.append(starts, len(place)).astype(np.int32)
    of_list = grams[code[new_list]]
    three = np.stack([of_list >> 42, of_list >> 21 & 0x1FFFFF, of_list & 0x1FFFFF], axis=1).astype("<u4")
    letters = three.tobytes().decode("utf-32-le")
    names = pa.array([letters[i : i + 3] for i in range(0, len(letters), 3)], pa.string())
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place))
    return pa.RecordBatch.from_arrays([names, pa.array(block[new_list]), lists, pa.array(np.diff(offsets))], schema=_ROWS)


def posting_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``: block, place, body, title."""
    texts, blocks, places, held = [], [], [], 0

    def flush() -> pa.RecordBatch:
        out = slice_lists(texts, np.array(blocks, np.int64), np.array(places, np.int64))
        texts.clear(), blocks.clear(), places.clear()
        return out

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            columns = [part.column(i).cast(pa.binary()).to_pylist() for i in (2, 3)]
            for block, place, *both in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), *columns, strict=True):
                for text in both:
                    text = text.decode("utf-8", "replace")
                    for start in range(0, max(len(text) - 2, 0), SLICE_CHARS):  # parts share two characters
                        piece = text[start : start + SLICE_CHARS + 2]
                        texts.append(piece), blocks.append(block), places.append(place)
                        held += len(piece)
                        if held >= SLICE_CHARS:
                            yield flush()
                            held = 0
    if texts:
        yield flush()


def build_index(knowledge: DataFrame, path: str, *, block_rows: int = 4096) -> None:
    """Write the index of a knowledge table, records included, under ``path``."""
    if not 1 < block_rows < 1 << 15:
        raise ValueError(f"block_rows must be from 2 to 32767, not {block_rows}")
    spark = knowledge.sparkSession
    # numbered by the task that writes them, so that texts are not exchanged for it
    number = F.monotonically_increasing_id()
    dealt = knowledge.withColumn("__number", number).withColumns({"__task": F.shiftright("__number", 33), "__row": F.col("__number").bitwiseAND(F.lit((1 << 33) - 1))})
    block = F.shiftleft("__task", 32) + F.floor(F.col("__row") / block_rows)
    docs = dealt.select(*knowledge.columns, block.cast("long").alias("block"), (F.col("__row") % block_rows + 1).cast("smallint").alias("place"))
    schema = StructType([f for f in docs.schema if f.name != "block"] + [f for f in docs.schema if f.name == "block"])
    spark.createDataFrame([(schema.json(),)], "json string").coalesce(1).write.parquet(f"{path}/schema")
    write(docs, f"{path}/docs", by=["block"])
    docs = spark.read.schema(schema).parquet(f"{path}/docs")
    cut = docs.select("block", "place", body_text().alias("body"), title_text().alias("title")).mapInArrow(posting_lists, POSTINGS)
    # written, as Spark samples what it deals by range
    lists = write_and_read(cut, "posting-lists")
    write(lists.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block"), f"{path}/postings", options=DELTAS)
    remove(lists)
    sizes = spark.read.schema(POSTINGS).parquet(f"{path}/postings").groupBy("gram").agg(F.sum("n").alias("n"))
    write(sizes.repartitionByRange("gram").sortWithinPartitions("gram"), f"{path}/grams")
    means = [F.avg(trigram_length(columns)).alias(f"__mean{e}") for e, columns in enumerate(ENGINES.values())]
    write(docs.agg(F.count("*").cast("double").alias("__n"), *means), f"{path}/facts")


class Index:
    """A written index, for searches."""

    def __init__(self, spark: SparkSession, path: str):
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
        self.docs = read("docs", StructType.fromJson(json.loads(read("schema", "json string").first()["json"])))
        self.postings, self.grams = read("postings", POSTINGS), read("grams", "gram string, n long")
        self.facts = read("facts", ", ".join(["__n double", *[f"__mean{e} double" for e in range(len(ENGINES))]]))

    def candidates(self, groups: list[list[str]]) -> DataFrame | None:
        """block, place of a superset of the records that hold any term; None if a term has no trigrams."""
        terms = list(dict.fromkeys(t for g in groups for t in g))
        by_term = {t: grams_of(t) for t in terms}
        if not terms or any(not g for g in by_term.values()):
            return None
        every = sorted({g for grams in by_term.values() for g in grams})
        sizes = {r["gram"]: r["n"] for r in self.grams.where(F.col("gram").isin(every)).collect()}  # a query's trigrams
        chosen = {t: sorted(grams, key=lambda g: (sizes.get(g, 0), g))[:LOOKED_UP] for t, grams in by_term.items()}
        chosen = {t: grams for t, grams in chosen.items() if all(g in sizes for g in grams)}
        looked_up = sorted({g for grams in chosen.values() for g in grams})
        lists = {g: F.flatten(F.collect_list(F.when(F.col("gram") == g, F.col("places")))).alias(f"g{i}") for i, g in enumerate(looked_up)}
        rows = self.postings.where(F.col("gram").isin(looked_up)).groupBy("block").agg(F.count("*").alias("__some"), *lists.values())
        none = F.array().cast("array<smallint>")
        places = {g: F.col(f"g{i}") for i, g in enumerate(looked_up)}
        found = [F.coalesce(reduce(F.array_intersect, [places[g] for g in grams]), none) for grams in chosen.values()]
        return rows.select("block", F.explode(reduce(F.array_union, found, none)).alias("place"))

    def search(self, spec: SearchSpec, semantic: DataFrame | None = None) -> DataFrame:
        """As ``search`` of the indexed knowledge."""
        wanted, _ = parse_terms(spec.query, spec.exclude)
        found = self.candidates(alias_groups(wanted, spec.aliases))
        if found is None:
            return search(self.docs.drop("block", "place"), spec, semantic)
        if semantic is not None:
            found = found.union(self.docs.join(semantic.select("record_id"), "record_id", "left_semi").select("block", "place"))
        # written once for both reads of the table; a number per block
        found = write_and_read(found.select("block").distinct(), "candidates").where("block >= 0")
        rows = self.docs.join(F.broadcast(found), "block", "left_semi").drop("block", "place")
        return search(rows, spec, semantic, facts=self.facts)
