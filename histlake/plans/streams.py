"""Queries that run a stream to its present end."""

from __future__ import annotations

from pyspark.sql import functions as F

from histlake.plans.events import TURNS_SQL
from histlake.plans.registry import query
from histlake.sources import read_table, work_path
from histlake.streaming import read_stream, stream_turns, write_once


@query("streaming_turns", f"WITH {TURNS_SQL} SELECT thread_id, line_no, role, turn_seq FROM turns")
def streaming_turns(spark, sf):
    path = f"{sf.rstrip('/')}/conversations.parque[t]"  # a pattern, so that one file will do as well as a folder
    rows = read_stream(spark, path, read_table(spark, sf, "conversations").schema)
    messages = rows.select(F.col("conv_id").cast("long").alias("thread_id"), F.col("turn").cast("long").alias("line_no"), "role")
    out = work_path(spark, "stream")
    write_once(stream_turns(messages), f"{out}/turns", f"{out}/checkpoint")
    return spark.read.schema("thread_id long, line_no long, role string, turn_seq long").parquet(f"{out}/turns")
