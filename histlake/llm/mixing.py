"""Mixing sources to target weights by weighted fair queueing.

Every source queues its shuffled documents, long ones in packets of ``packet_words`` words. A
packet's virtual finish time is the words its source has sent up to its end, divided by the
source's target; the source with the larger target thus advances more slowly in virtual time
and sends more. All packets are sorted by finish time, over all sources, and that one order
is cut where the running sum of words reaches the total budget, inside a packet if need be.
What a source has sent by then is within about a packet of its target. A source whose target
exceeds its size starts over, with the same order, at most ``max_epochs`` times.

Scale: no running sum is taken in one task. A digest of id and text gives each document its
place; the digest's first digits make buckets of about ``bucket_rows`` rows of a source, whose
sums give each bucket's start, and only within a bucket is there a window. The global order
is a range partitioning of packets (numbers only, no text); the partitions' sums tell which
one holds the cut, and only there is there a running sum. Within a source, finish times
ascend, so the cut comes down to one position for each source, and a document's share is what
of it lies before that.

Defined cases: a null text has size 0, a null source is a source of its own (the last), a
null id is a document like any other. Rows that repeat an id are separate documents; those
that repeat id and text are interchangeable and have neighbouring places. An empty table
gives an empty result; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histlake.llm.common import BLANKS, OWN, n_words, text_or_empty, without
from histlake.sources import read_table, write_and_read

OUTPUTS = ("size", "source_size", "target", "taken", "finish")


def water_fill(sources: DataFrame, weights: tuple[int, ...], budget_ratio: float, max_epochs: int) -> DataFrame:
    """Numbers and targets of the sources: budget shared by weight, none above max_epochs times its size.

    ``sources``: __hl_src, __hl_null, source_size. One row per source, so the windows
    below see as many rows as there are sources.
    """
    total = Window.partitionBy(F.lit(0))
    place = Window.partitionBy(F.lit(0)).orderBy(F.col(f"{OWN}null"), F.col(f"{OWN}src"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("ratio", "place")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = (
        sources.withColumn("place", F.row_number().over(place) - 1)
        .withColumn("weight", w)
        .withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("budget", F.lit(float(budget_ratio)) * F.sum("source_size").over(total))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("rest"))
    )
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))
    s = s.withColumn("level", F.min(fits).over(total)["level"])
    target = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("weight") * F.col("level"))
    return s.select(f"{OWN}src", "source_size", F.col("place").alias("number"), target.alias("target"))


def _served(sizes: DataFrame, targets: DataFrame, starts: DataFrame, budget_ratio: float, max_epochs: int, packet_words: int) -> DataFrame:
    """__hl_src, served: words that each source has sent when the order of all packets reaches the budget."""
    position = F.col("epoch") * F.col("source_size") + F.col(f"{OWN}start") + F.col("k") * packet_words
    packets = (
        _started(sizes.where(F.col(f"{OWN}size") > 0), starts)
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
        .select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col(f"{OWN}size") - 1) / packet_words).cast("int"))).alias("k"))
        .select("number", "target", position.alias("begin"), F.least(F.lit(packet_words), F.col(f"{OWN}size") - F.col("k") * packet_words).alias("words"))
        .select("number", "begin", "words", ((F.col("begin") + F.col("words")) / F.col("target")).alias("finish"))
    )
    queue = ["finish", "number", "begin"]
    order = write_and_read(packets.repartitionByRange(*queue).withColumn("part", F.spark_partition_id()), "mix-order")
    # one row per partition; of them, the one in which the budget ends, and what is left for it
    every = Window.partitionBy(F.lit(0))
    earlier = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = (F.sum("sent").over(every) / max_epochs).cast("long")
    parts = order.groupBy("part").agg(F.sum("words").alias("sent")).withColumns(
        {"before": F.coalesce(F.sum("sent").over(earlier), F.lit(0)), "budget": F.least(F.floor(F.lit(float(budget_ratio)) * total + 0.5), max_epochs * total)}
    )
    last = parts.where("before < budget and before + sent >= budget").select("part", (F.col("budget") - F.col("before")).alias("left")).first()
    part, left = last if last else (-1, 0)
    upto = Window.partitionBy("part").orderBy(*queue).rowsBetween(Window.unboundedPreceding, -1)
    inside = (
        order.where(F.col("part") == part)
        .withColumn("room", left - F.coalesce(F.sum("words").over(upto), F.lit(0)))
        .where("room > 0")
        .select("number", (F.col("begin") + F.least("words", "room")).alias("end"))
    )
    whole = order.where(F.col("part") < part).select("number", (F.col("begin") + F.col("words")).alias("end"))
    served = whole.union(inside).groupBy("number").agg(F.max("end").alias("served"))
    out = targets.join(served, "number", "left").select(f"{OWN}src", F.coalesce("served", F.lit(0)).alias(f"{OWN}served"))
    return write_and_read(out, "mix-served", replaces=[order])


def _started(sized: DataFrame, starts: DataFrame) -> DataFrame:
    """With __hl_start: words of the source before the row."""
    inside = Window.partitionBy(f"{OWN}src", f"{OWN}bucket").orderBy(f"{OWN}place").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(starts, [f"{OWN}src", f"{OWN}bucket"])
    return placed.withColumn(f"{OWN}start", F.col(f"{OWN}base") + F.coalesce(F.sum(f"{OWN}size").over(inside), F.lit(0)))


def _plan(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (5, 2, 1),
    budget_ratio: float = 1.5,
    max_epochs: int = 2,
    packet_words: int = 256,
    seed: str = "mix",
    bucket_rows: int = 2000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """``docs`` (or of them ``keep``) with __hl_ size, source_size, target, start, served and place."""
    digest = F.md5(text_or_empty(text_col).cast("binary"))
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), digest).cast("binary"))
    sized = docs.withColumns(
        {
            f"{OWN}size": n_words(text_col),
            f"{OWN}null": F.col(source_col).isNull(),
            f"{OWN}src": F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col))),
            f"{OWN}place": place,
        }
    )
    sizes = write_and_read(sized.select(f"{OWN}size", f"{OWN}null", f"{OWN}src", f"{OWN}place"), "mix-sizes")
    digits = 1
    while 16**digits * bucket_rows < sizes.count():
        digits += 1
    bucket = F.substring(f"{OWN}place", 1, digits)
    sizes_ = sizes.withColumn(f"{OWN}bucket", bucket)
    sums = write_and_read(sizes_.groupBy(f"{OWN}src", f"{OWN}null", f"{OWN}bucket").agg(F.sum(f"{OWN}size").alias("words")), "mix-sums")
    totals = sums.groupBy(f"{OWN}src", f"{OWN}null").agg(F.sum("words").alias("source_size"))
    targets = write_and_read(water_fill(totals, weights, budget_ratio, max_epochs), "mix-targets")
    earlier = Window.partitionBy(f"{OWN}src").orderBy(f"{OWN}bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(f"{OWN}src", f"{OWN}bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias(f"{OWN}base")).join(targets, f"{OWN}src")
    starts = write_and_read(starts, "mix-starts", replaces=[sums])
    served = _served(sizes_, targets, starts, budget_ratio, max_epochs, packet_words)
    ends = starts.select(f"{OWN}src", f"{OWN}bucket", f"{OWN}base", F.col("source_size").alias(f"{OWN}source_size"), F.col("target").alias(f"{OWN}target")).join(served, f"{OWN}src")
    ends = write_and_read(ends, "mix-ends", replaces=[sizes, targets, starts, served])
    if keep is not None:  # what isn't asked for isn't exchanged
        sized = sized.select(*keep, *[c for c in sized.columns if c.startswith(OWN)])
    return _started(sized.withColumn(f"{OWN}bucket", bucket), ends).drop(f"{OWN}src", f"{OWN}null", f"{OWN}bucket", f"{OWN}base")


def words_of_copy(epoch: int) -> Column:
    """Words that the mix takes of a document in one round through its source."""
    left = F.col(f"{OWN}served") - F.lit(epoch) * F.col(f"{OWN}source_size") - F.col(f"{OWN}start")
    return F.greatest(F.lit(0).cast("long"), F.least(F.col(f"{OWN}size"), left))


def mix_plan(docs: DataFrame, *, max_epochs: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] | None = None, **options) -> DataFrame:
    """All rows and columns of ``docs`` (or of them ``keep``) plus size, source_size, target, taken and finish.

    ``taken``: words the mix takes of the row, repeats counted. ``finish``: virtual finish
    time of its first copy (null where the target is 0). Columns of ``docs`` with an output's
    name are replaced.
    """
    docs = without(docs, *(c for c in OUTPUTS if c not in (id_col, text_col, source_col)))
    plan = _plan(docs, max_epochs=max_epochs, id_col=id_col, text_col=text_col, source_col=source_col, keep=keep, **options)
    finish = F.when(F.col(f"{OWN}target") > 0, (F.col(f"{OWN}start") + F.col(f"{OWN}size")) / F.col(f"{OWN}target"))
    return plan.select(
        *[F.col(f"`{c}`") for c in plan.columns if not c.startswith(OWN)],
        *[F.col(f"{OWN}{c}").alias(c) for c in ("size", "source_size", "target")],
        sum((words_of_copy(e) for e in range(1, max_epochs)), words_of_copy(0)).alias("taken"),
        finish.alias("finish"),
    )


def mix_documents(docs: DataFrame, *, max_epochs: int = 2, text_col: str = "text", **options) -> DataFrame:
    """The mix itself: the taken documents in order of virtual finish time.

    A document taken twice gives two rows. The documents at which a source's part of the mix
    ends keep their first words, joined by blanks (and ``n_chars``, where there is one,
    follows). Columns are those of ``docs``, whatever their names.
    """
    columns = docs.columns
    plan = _plan(docs, max_epochs=max_epochs, text_col=text_col, **options)
    copies = plan.withColumn(f"{OWN}copy", F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), words_of_copy(e).alias("words")) for e in range(max_epochs)])))
    copies = copies.where(F.col(f"{OWN}copy.words") > 0)
    cut = F.col(f"{OWN}copy.words") < F.col(f"{OWN}size")
    words = F.filter(F.split(F.col(text_col), BLANKS), lambda w: w != "")
    head = F.array_join(F.slice(words, F.lit(1), F.col(f"{OWN}copy.words").cast("int")), " ")
    copies = copies.withColumns(
        {
            text_col: F.when(cut, head).otherwise(F.col(text_col)),
            f"{OWN}finish": (F.col(f"{OWN}copy.epoch") * F.col(f"{OWN}source_size") + F.col(f"{OWN}start") + F.col(f"{OWN}size")) / F.col(f"{OWN}target"),
            f"{OWN}cut": cut,
        }
    )
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        copies = copies.withColumn("n_chars", F.when(F.col(f"{OWN}cut"), F.length(text_col).cast(kind)).otherwise(F.col("n_chars")))
    return copies.orderBy(f"{OWN}finish", f"{OWN}place").select(*[F.col(f"`{c}`") for c in columns])


def op2_mixing(spark, sf_dir):
    plan = mix_plan(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=("doc_id",))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "finish").orderBy("finish", "doc_id")


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS place
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (SELECT sum(size) FROM sized)::DOUBLE AS budget
  FROM src),
ranked AS (
  SELECT *, cap / weight AS ratio,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighted),
lev AS (
  SELECT arg_min((budget - before) / rest, (ratio, place)) AS level FROM ranked WHERE (budget - before) / rest <= ratio),
targets AS (
  SELECT source, source_size, place, CASE WHEN level IS NULL OR ratio <= level THEN cap ELSE weight * level END AS target
  FROM ranked CROSS JOIN lev),
started AS (
  SELECT d.*, t.source_size, t.target, t.place AS number,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY d.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
packets AS (
  SELECT number, target, epoch * source_size + start + k * 256 AS begin, least(256, size - k * 256) AS words
  FROM (SELECT *, unnest(range((size + 255) // 256)) AS k FROM (SELECT *, unnest([0, 1]) AS epoch FROM started WHERE size > 0))),
queued AS (
  SELECT number, begin, words,
         coalesce(sum(words) OVER (ORDER BY (begin + words)::DOUBLE / target, number, begin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM packets),
served AS (
  SELECT number, max(begin + least(words, (SELECT least(floor(1.5::DOUBLE * sum(size) + 0.5), 2 * sum(size)) FROM sized) - before)) AS served
  FROM queued WHERE before < (SELECT least(floor(1.5::DOUBLE * sum(size) + 0.5), 2 * sum(size)) FROM sized) GROUP BY number)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, coalesce(served, 0) - start)) + greatest(0, least(size, coalesce(served, 0) - source_size - start)))::BIGINT AS taken,
       CASE WHEN target > 0 THEN (start + size)::DOUBLE / target END AS finish
FROM started LEFT JOIN served USING (number)
"""
