"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass 1 scatters the records uniformly, by a seeded hash, into as many buckets as it takes
for each to fit in memory. Pass 2 permutes every bucket by Fisher-Yates (Spark's seeded
``shuffle`` of an array is one) and writes it. The written buckets, one after the other, are
one random order; the shards are its equal parts. The law is therefore ``rows``: the shards'
counts are at most one apart.

Bucket i is partition i of the exchange, and ``shuffle`` draws from seed + partition, so a
task that runs again, or another run over the same files, gives the same order.

Scale: one exchange of the records; a bucket holds ``bucket_bytes`` on average whatever the
table's size. Copies of one text have different ids and scatter; rows that repeat id and text
more than ``ALIKE`` times are spread by their place in the table. The written buckets are
counted, and numbered by a window over one row per bucket.

Defined cases: a null text counts 16 bytes like an empty one, and its crc32 is that of no
bytes; a null id is a record like any other; repeated rows all get a slot (they are
interchangeable); an empty table gives no rows. Columns named like an output are replaced.
All columns must be orderable (no maps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histlake.llm.common import OWN, text_or_empty, without
from histlake.sources import read_table, write_and_read

OUTPUTS = ("law", "shard", "slot", "grown_shard")
RECORD_BYTES = 16
#: So many rows alike in id and text may meet in a bucket; more are dealt out in as many parts as it takes.
ALIKE = 1000


def record_size(text_col: str = "text") -> Column:
    """UTF-8 bytes of the text plus what a record costs besides."""
    return (F.octet_length(text_or_empty(text_col)) + RECORD_BYTES).cast("long")


def shard_documents(
    docs: DataFrame,
    n_shards: int = 40,
    *,
    seed: int = 20_240_101,
    bucket_bytes: int = 16 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` with law ('rows'), shard, slot (gapless in each shard from 0) and grown_shard (null)."""
    docs = without(docs, *OUTPUTS)
    columns = docs.columns
    key = [F.col(id_col).alias(f"{OWN}id"), F.xxhash64(F.col(text_col)).alias(f"{OWN}x")]
    sums = write_and_read(docs.groupBy(*key).agg(F.count("*").alias("n"), F.sum(record_size(text_col)).alias("bytes")), "shard-keys")
    total = sums.agg(F.sum("bytes")).first()[0] or 0
    # a table of its own: as a rule it is empty, and Spark sees that no records need be exchanged to join it
    many = sums.where(F.col("n") > ALIKE).select(f"{OWN}id", f"{OWN}x", F.ceil(F.col("n") / ALIKE).alias(f"{OWN}parts"))
    many = write_and_read(many, "shard-many", replaces=[sums])
    n_buckets = max(1, -(-total // bucket_bytes))
    same = F.col(id_col).eqNullSafe(F.col(f"{OWN}id")) & (F.xxhash64(F.col(text_col)) == F.col(f"{OWN}x"))
    dealt = docs.withColumn(f"{OWN}row", F.monotonically_increasing_id()).join(many, same, "left")
    part = F.coalesce(F.pmod(F.col(f"{OWN}row"), F.col(f"{OWN}parts")), F.lit(0))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), text_or_empty(text_col), part), F.lit(n_buckets)).cast("int")
    record = F.struct(F.col(id_col).alias(f"{OWN}id"), F.crc32(text_or_empty(text_col).cast("binary")).alias(f"{OWN}crc"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    shuffled = (
        dealt.withColumn(f"{OWN}bucket", bucket)
        .repartitionById(n_buckets, F.col(f"{OWN}bucket"))
        .groupBy(f"{OWN}bucket")
        .agg(F.array_sort(F.collect_list(record)).alias("rows"))
        .select(f"{OWN}bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias(f"{OWN}at", "record"))
    )
    buckets = write_and_read(shuffled.select(f"{OWN}bucket", f"{OWN}at", "record.row"), "shard-buckets")
    counts = write_and_read(buckets.groupBy(f"{OWN}bucket").agg(F.count("*").alias("n")), "shard-counts")
    before = Window.partitionBy(F.lit(0)).orderBy(f"{OWN}bucket").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("n").over(Window.partitionBy(F.lit(0)))
    bases = counts.select(f"{OWN}bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{OWN}base"), n.alias(f"{OWN}n"))
    # shard s begins at floor(s * n / shards); whole-number division keeps that exact
    place, total_rows = F.col(f"{OWN}base") + F.col(f"{OWN}at"), F.col(f"{OWN}n")
    shard = _quotient((place + 1) * n_shards - 1, total_rows)
    placed = buckets.join(bases, f"{OWN}bucket").withColumns({f"{OWN}place": place, f"{OWN}shard": shard})
    return placed.select(
        *[F.col(f"row.`{c}`").alias(c) for c in columns],
        F.lit("rows").alias("law"),
        F.col(f"{OWN}shard").cast("int").alias("shard"),
        (F.col(f"{OWN}place") - _quotient(F.col(f"{OWN}shard") * total_rows, F.lit(n_shards))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _quotient(a: Column, b: Column) -> Column:
    """Whole-number division of longs that aren't negative."""
    return ((a - a % b) / b).cast("long")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; ``slot`` tells the order in it. A bucket lies in one shard or few, so nothing is exchanged."""
    sharded.write.partitionBy("shard").parquet(path)


def op7_sharding(spark, sf_dir):
    sharded = shard_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sharded.select(
        "doc_id",
        record_size("text").alias("size"),
        F.crc32(text_or_empty("text").cast("binary")).alias("text_crc32"),
        "law",
        "shard",
        "slot",
        "grown_shard",
    )
