"""A bounded, documented sample of labelled documents for fitting a model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histlake.llm.common import fold


@dataclass(frozen=True)
class Sample:
    """At most ``per_class`` labelled documents of each class, and the classes' counts over all labels.

    ``docs``: doc_id, label, text. A class's examples stand for ``counts[label] / taken[label]`` each.
    """

    docs: DataFrame
    counts: dict[int, int]
    taken: dict[int, int]

    def weight(self, label: int) -> float:
        return self.counts.get(label, 0) / max(1, self.taken.get(label, 0))


def sample_labelled(
    docs: DataFrame, labels: DataFrame, label: str, *, folds: int | None = None, held_out: int | None = None, per_class: int = 3000
) -> Sample:
    """Labels of the training folds, at most ``per_class`` ids of each class (the least seeded hashes).

    Counts cover all labels; only the ids are bounded, so that the driver's fit is. Rows that
    repeat an id count once (label: the larger); null ids and labels other than 0 and 1 are none.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if folds is not None:
        known = known.where(fold("doc_id", folds) != held_out)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {int(r["label"]): int(r["n"]) for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    spark = docs.sparkSession
    ids = []
    for value in (0, 1):
        one = known.where(F.col("label") == value).orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(per_class)
        ids += [(r["doc_id"], value) for r in one.collect()]
    # 2 * per_class pairs of numbers: small at any size of the tables
    chosen = F.broadcast(spark.createDataFrame(ids, "doc_id long, label int"))
    taken = {v: sum(1 for _, x in ids if x == v) for v in (0, 1)}
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return Sample(narrow.join(chosen, "doc_id"), counts, taken)
