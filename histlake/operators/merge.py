"""Merging variants of one thread's log from two libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _digest(rows: DataFrame, name: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "content_sha"))), lambda x: x["content_sha"])
    return rows.groupBy("thread_id").agg(lines.alias(name))


def variant_methods(left: DataFrame, right: DataFrame) -> DataFrame:
    """thread_id, method: only_left, only_right, exact, prefix (one continues the other) or union.

    Both: thread_id, line_no, content_sha. A thread's lines meet in one row, as its log is one file.
    """
    both = _digest(left, "a").join(_digest(right, "b"), "thread_id", "full_outer")
    short = F.least(F.size("a"), F.size("b"))
    same = F.slice("a", F.lit(1), short) == F.slice("b", F.lit(1), short)
    method = (
        F.when(F.col("b").isNull(), F.lit("only_left"))
        .when(F.col("a").isNull(), F.lit("only_right"))
        .when(F.col("a") == F.col("b"), F.lit("exact"))
        .when(same, F.lit("prefix"))
        .otherwise(F.lit("union"))
    )
    return both.select("thread_id", method.alias("method"))


def merge_variants(left: DataFrame, right: DataFrame) -> DataFrame:
    """thread_id, line_no (anew), content_sha, method: each distinct line once, ordered by time (unknown last), side, line.

    Both: thread_id, line_no, content_sha, at. For exact and prefix variants this is the longer log.
    """
    rows = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    same = Window.partitionBy("thread_id", "content_sha").orderBy("side", "line_no")
    first = rows.withColumn("__n", F.row_number().over(same)).where("__n = 1")
    by = Window.partitionBy("thread_id").orderBy(F.asc_nulls_last("at"), "side", "line_no")
    merged = first.select("thread_id", (F.row_number().over(by)).cast("long").alias("line_no"), "content_sha")
    return merged.join(variant_methods(left, right), "thread_id")
