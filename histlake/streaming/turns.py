"""Turn segmentation of append-only logs as a stream.

State per thread is two numbers, whether a turn is open and how many were opened, so a stream
resumes where its checkpoint ends and never reads a log's beginning again. Within a batch a
thread's rows are put in line order; a line at or below the last one seen is a repeat and is
dropped, so replayed files change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

OUTPUT = "thread_id long, line_no long, role string, turn_seq long"
STATE = "opened long, is_open boolean, last_line long"


def read_stream(spark: SparkSession, path: str, schema: StructType | str, *, files_per_batch: int = 16) -> DataFrame:
    """New files of a folder or pattern, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_turns(messages: DataFrame, *, starts: tuple[str, ...] = ("user",), speaks: tuple[str, ...] = ("user", "assistant"), ends: tuple[str, ...] = ()) -> DataFrame:
    """thread_id, line_no, role, turn_seq of a stream of messages (thread_id, line_no, role)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, is_open, last = state.get if state.exists else (0, False, -(2**62))
        rows = pd.concat(list(batches), ignore_index=True).sort_values("line_no", kind="stable")
        out = []
        for line, role in zip(rows["line_no"], rows["role"], strict=True):
            if line <= last:
                continue
            last = line
            if role in starts or (role in speaks and not is_open):
                opened, is_open = opened + 1, True
            out.append((key[0], line, role, opened - 1 if is_open else None))
            if role in ends:
                is_open = False
        state.update((int(opened), bool(is_open), int(last)))
        frame = pd.DataFrame(out, columns=["thread_id", "line_no", "role", "turn_seq"])
        yield frame.astype({"turn_seq": "Int64"})

    grouped = messages.select("thread_id", "line_no", "role").groupBy("thread_id")
    return grouped.applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def write_once(stream: DataFrame, path: str, checkpoint: str, *, transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Everything there is now, appended to ``path`` exactly once (the file sink's log sees to that)."""
    rows = transform(stream) if transform else stream
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()


def windowed_counts(events: DataFrame, *, at: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and key of a stream, final once the watermark has passed. An extra, beyond what logs need."""
    ts = F.col(at).cast("timestamp")
    timed = events.withColumn(at, ts).withWatermark(at, late)
    return timed.groupBy(F.window(at, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")
