"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Lines are compared by their words, lower-cased. A line of at least ``min_words`` words that
equals an earlier line is dropped; so is a line within one word edit (one word put in, left
out or replaced) of an earlier one, dropped or not, if both have at least ``near_min_words``
words: an edit is then at most that share of the shorter line. "Earlier" is by id, then line
number. Other lines, and lines without a word, stay as they are.

The join: every line emits a hashed key for each variant with one word deleted, and one for
the whole line. Two lines of equal length that delete the same place to the same rest are one
replacement apart; a line that equals another's variant is one deletion apart. So the earliest
line of a key is the witness for all of its group: it takes an aggregate and a join back, no
pairs within a group. The edit distance to the witness is then verified on the words.

Emitting a variant per word for all lines would shuffle a multiple of the corpus. A lossless
filter goes before: one edit leaves the first or the last words of two lines alike, up to
just under half of the shorter one, so a line that shares neither emits nothing. (That number
of words is rounded down to 2, 3, .. 8, 10, 12, .. 16, 20, .., so that lines of n and n - 1
words mostly have it in common.) The variants' hashes are xors of (word, place) hashes, so a
line of n words costs n, not n squared: its words are exploded and a running xor gives every
variant. Lines that emit are numbered in their order, so that all that is exchanged then is
numbers, and the earliest line is the least one.

One path serves every size: nothing is broadcast by this code, and each step is written so
that its shuffle files, and the tables it replaces, go before the next one.

Defined cases: a null text stays null and has no lines; rows with one id and one text are
interchangeable and come out alike; a null id sorts last; an empty table gives no rows.
Columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histlake.llm.common import OWN, without
from histlake.sources import read_table, write_and_read

OUTPUTS = ("n_lines", "n_exact_dropped", "n_near_dropped")
LINE = ["h1", "h2"]
#: A null id counts as the largest one.
LAST_ID = 2**63 - 1


def _order(prefix: str = "") -> Column:
    """Where a line stands; structs compare field by field."""
    did, row, line_no = (F.col(f"{prefix}{c}") for c in ("did", "row", "line_no"))
    return F.struct(did.isNull().alias("none"), F.coalesce(did, F.lit(LAST_ID)).alias("did"), row.alias("row"), line_no.alias("line_no"))


def _normal_lines(text: Column) -> Column:
    """The lines of a text with one blank between words; their letters are as they were."""
    for blank in "\t\x0b\x0c\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.split(text, "\n")


def _normal(line: Column) -> Column:
    """Words in lower case with one blank between; much faster than an array of words."""
    low = F.lower(F.trim(line))
    return F.when(F.contains(low, F.lit("  ")), F.regexp_replace(low, " +", " ")).otherwise(low)


def _common_words(n: Column) -> Column:
    """How many first, or last, words are compared of a pair whose shorter line has n words."""
    half = F.floor((n - 1) / 2)
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.floor(F.log2(half.cast("double"))) - 2))
    return (F.floor(half / step) * step).cast("int")


def _ends(p: str) -> list[Column]:
    """Keys of a line's first and last ``p`` words."""
    return [
        F.xxhash64(F.lit("first"), p, F.expr(f"substring_index(line, ' ', {p})")),
        F.xxhash64(F.lit("last"), p, F.expr(f"substring_index(line, ' ', -{p})")),
    ]


def _lines(docs: DataFrame, near_min_words: int, id_col: str, text_col: str) -> DataFrame:
    """did, row, line_no, h1, h2, n, ends (null of lines without near copies): the lines that have a word."""
    lines = (
        docs.select(F.col(id_col).alias("did"), F.xxhash64(F.col(text_col)).alias("row"), F.posexplode(_normal_lines(F.col(text_col))).alias("line_no", "line"))
        .withColumn("line", _normal(F.col("line")))
        .where("line <> ''")
        .withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    )
    lines = lines.select("*", _common_words(F.col("n")).alias("p"), _common_words(F.col("n") - 1).alias("q"))
    # the shorter line of a pair may be this one, or have a word less
    ends = F.when(F.col("p") == F.col("q"), F.array(*_ends("p"))).when(F.col("n") == near_min_words, F.array(*_ends("p"))).otherwise(F.array(*_ends("p"), *_ends("q")))
    return lines.select(
        "did", "row", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), "n",
        F.when(F.col("n") >= near_min_words, ends).alias("ends"),
    )


def _candidates(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """h1, h2, first: lines that share their first or last words with another one."""
    ends = lines.where("ends is not null").select("h1", F.explode("ends").alias("end"))
    shared = ends.groupBy("end").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("end")
    chosen = write_and_read(ends.join(shared.hint("merge"), "end", "left_semi").select("h1").distinct(), "line-candidates")
    return write_and_read(distinct.join(chosen.hint("merge"), "h1", "left_semi").select(*LINE, "first"), "line-firsts", replaces=[chosen])


def _with_words(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """at, h1, h2, words: the candidates' words from where they first stand. ``at`` numbers them in their order."""
    places = found.groupBy(F.when(~F.col("first.none"), F.col("first.did")).alias("did"), F.col("first.row").alias("row")).agg(
        F.collect_list(F.struct("first", *LINE)).alias("lines")
    )
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("x"), F.col(text_col).alias("t"))
    words = (
        texts.join(places.hint("merge"), F.col("id").eqNullSafe(F.col("did")) & (F.col("x") == F.col("row")))
        .select(_normal_lines(F.col("t")).alias("parts"), F.explode("lines").alias("l"))
        .select("l.h1", "l.h2", "l.first", F.split(_normal(F.get("parts", F.col("l.first.line_no"))), " ").alias("words"))
    )
    words = write_and_read(words, "line-words", replaces=[found])
    # rows that repeat an id and a text come more than once, side by side in this order
    ordered = words.repartitionByRange("first").dropDuplicates(["first"]).sortWithinPartitions("first").withColumn("at", F.monotonically_increasing_id())
    return write_and_read(ordered.select("at", *LINE, "words"), "line-numbered", replaces=[words])


def _near_lines(docs: DataFrame, lines: DataFrame, distinct: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """h1, h2 of lines within one word edit of an earlier line."""
    found = _with_words(docs, _candidates(lines, distinct), id_col, text_col)
    whole = Window.partitionBy("at")
    upto = whole.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    words = found.select("at", F.posexplode("words").alias("p", "w")).select("at", "p", F.xxhash64("w", "p").alias("here"), F.xxhash64("w", F.col("p") - 1).alias("back"))
    sums = words.select(
        "at", "p", "here", F.count("*").over(whole).cast("int").alias("n"), F.bit_xor("here").over(upto).alias("here_upto"), F.bit_xor("here").over(whole).alias("here_all"),
        F.bit_xor("back").over(upto).alias("back_upto"), F.bit_xor("back").over(whole).alias("back_all"),
    )
    before = F.col("here_upto").bitwiseXOR(F.col("here"))
    masked = F.col("here_all").bitwiseXOR(F.col("here"))
    deleted = before.bitwiseXOR(F.col("back_all")).bitwiseXOR(F.col("back_upto"))
    # whole lines are told from variants by the sign, masks from deletions by the key's last bit
    masks, rests = F.xxhash64(F.lit("mask"), "n", "p", masked).bitwiseOR(1), F.xxhash64(F.col("n") - 1, deleted).bitwiseAND(-2)
    variants = F.array(
        F.struct((F.col("at") + 1).alias("me"), masks.alias("key")),
        F.struct((F.col("at") + 1).alias("me"), rests.alias("key")),
        F.when(F.col("p") == 0, F.struct((-1 - F.col("at")).alias("me"), F.xxhash64("n", "here_all").bitwiseAND(-2).alias("key"))),
    )
    emitted = write_and_read(sums.select(F.explode(variants).alias("v")).where("v is not null").select("v.me", "v.key"), "line-variants")
    groups = (
        emitted.groupBy("key")
        .agg(F.min(F.when(F.col("me") > 0, F.col("me"))).alias("variant"), F.max(F.when(F.col("me") < 0, F.col("me"))).alias("whole"), F.min("me").alias("a"), F.max("me").alias("b"))
        .where("a <> b")
    )
    # the first of equal masks; of a whole line, the first that leaves a word out to it, and the reverse
    witness = F.when((F.col("me") < 0) | (F.col("key").bitwiseAND(1) == 1), F.col("variant")).otherwise(-F.col("whole"))
    met = (
        emitted.join(groups.select("key", "variant", "whole").hint("merge"), "key")
        .select(F.abs("me").alias("me"), witness.alias("witness"))
        .where("witness < me")
        .groupBy("me")
        .agg(F.min("witness").alias("witness"))
        .select((F.col("me") - 1).alias("at"), (F.col("witness") - 1).alias("witness"))
    )
    met = write_and_read(met, "line-witnesses", replaces=[emitted])
    own = found.select("at", *LINE, F.col("words").alias("x"))
    other = found.select(F.col("at").alias("witness"), F.col("words").alias("y"))
    near = met.join(own, "at").join(other, "witness").where(within_one_word(F.col("x"), F.col("y"))).select(*LINE).distinct()
    return write_and_read(near.withColumn("near", F.lit(True)), "near-lines", replaces=[met, found])


def within_one_word(x: Column, y: Column) -> Column:
    """Whether two arrays of words are at most one word edit apart."""
    short = F.least(F.size(x), F.size(y))
    places = F.when(short > 0, F.sequence(F.lit(0), short - 1)).otherwise(F.array().cast("array<int>"))
    ahead = F.aggregate(places, F.lit(0), lambda a, i: F.when((a == i) & (F.get(x, i) == F.get(y, i)), a + 1).otherwise(a))
    behind = F.aggregate(
        places, F.lit(0), lambda a, i: F.when((a == i) & (F.get(x, F.size(x) - 1 - i) == F.get(y, F.size(y) - 1 - i)), a + 1).otherwise(a)
    )
    return F.when(F.size(x) == F.size(y), ahead + behind >= short - 1).when(F.abs(F.size(x) - F.size(y)) == 1, ahead + behind >= short).otherwise(F.lit(False))


def dedup_lines(
    docs: DataFrame, *, min_words: int = 1, near_min_words: int = 5, counts: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with later copies and near copies of lines cut from the text.

    Adds n_lines, n_exact_dropped and n_near_dropped (a line that is both counts as exact), but
    for ``counts`` false, when the columns are those of ``docs``.
    """
    if near_min_words < 5:
        raise ValueError("near_min_words must be 5 at least: a shorter line's ends are too short to compare")
    docs = without(docs, *OUTPUTS) if counts else docs
    columns = docs.columns
    lines = write_and_read(_lines(docs, near_min_words, id_col, text_col), "lines")
    distinct = write_and_read(lines.groupBy(*LINE).agg(F.min(_order()).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n")), "line-distinct")
    near = _near_lines(docs, lines, distinct, id_col, text_col)
    marked = (
        distinct.where((F.col("copies") > 1) & (F.col("n") >= min_words)).select(*LINE, "first")
        .join(near, LINE, "full_outer")
        .select(*LINE, "first", F.coalesce("near", F.lit(False)).alias("near"))
    )
    exact = F.coalesce(F.col("first") < _order(), F.lit(False))
    dropped = (
        lines.select("did", "row", "line_no", *LINE)
        .join(marked.hint("merge"), LINE)
        .select("did", "row", "line_no", exact.alias("exact"), "near")
        .where("exact or near")
        .groupBy("did", "row")
        .agg(F.collect_set(F.when(F.col("exact"), F.col("line_no"))).alias("same"), F.collect_set(F.when(~F.col("exact"), F.col("line_no"))).alias("like"))
        .select(F.col("did").alias(f"{OWN}did"), F.col("row").alias(f"{OWN}row"), F.col("same").alias(f"{OWN}same"), F.col("like").alias(f"{OWN}like"))
    )
    dropped = write_and_read(dropped, "line-drops", replaces=[lines, distinct, near])
    joined = docs.withColumn(f"{OWN}x", F.xxhash64(F.col(text_col))).join(
        dropped.hint("merge"), F.col(id_col).eqNullSafe(F.col(f"{OWN}did")) & (F.col(f"{OWN}x") == F.col(f"{OWN}row")), "left"
    )
    parts = F.split(F.col(text_col), "\n")
    gone = F.concat(f"{OWN}same", f"{OWN}like")
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(gone, i)), "\n")
    count = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")
    added = [
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        count(f"{OWN}same").alias("n_exact_dropped"),
        count(f"{OWN}like").alias("n_near_dropped"),
    ]
    return joined.select(
        *[F.when(F.col(f"{OWN}did").isNull() & F.col(f"{OWN}row").isNull(), F.col(text_col)).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`") for c in columns],
        *(added if counts else []),
    )


def op9_line_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_exact_dropped", "n_near_dropped")


OP9_SQL = r"""
WITH cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
raw AS (
  SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM cut),
norm AS (
  SELECT doc_id, line_no, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM raw),
lines AS (
  SELECT *, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS n FROM norm),
firsts AS (
  SELECT norm, any_value(n) AS n, min((doc_id, line_no)) AS first FROM lines WHERE n >= 1 GROUP BY norm),
long_lines AS (
  SELECT norm, n, first, string_split(norm, ' ') AS w FROM firsts WHERE n >= 5),
masks AS (
  SELECT norm, n, first, p, array_to_string(list_concat(list_slice(w, 1, p - 1), list_slice(w, p + 1, n)), ' ') AS rest
  FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM long_lines)),
same_length AS (
  SELECT norm, min(first) OVER (PARTITION BY n, p, rest) AS witness, first FROM masks),
other_length AS (
  SELECT m.norm, w.first AS witness, m.first FROM masks m JOIN long_lines w ON w.norm = m.rest
  UNION ALL
  SELECT w.norm, m.first AS witness, w.first FROM masks m JOIN long_lines w ON w.norm = m.rest),
near AS (
  SELECT DISTINCT norm FROM (SELECT * FROM same_length UNION ALL SELECT * FROM other_length) WHERE witness < first),
judged AS (
  SELECT l.doc_id, l.line_no, l.line,
         coalesce((l.doc_id, l.line_no) > f.first, false) AS exact, nr.norm IS NOT NULL AS near
  FROM lines l LEFT JOIN firsts f ON l.norm = f.norm LEFT JOIN near nr ON l.norm = nr.norm),
done AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT exact AND NOT near) AS text, count(*) AS n_lines,
         count(*) FILTER (WHERE exact) AS n_exact_dropped, count(*) FILTER (WHERE near AND NOT exact) AS n_near_dropped
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text,
       coalesce(o.n_lines, 0)::BIGINT AS n_lines, coalesce(o.n_exact_dropped, 0)::BIGINT AS n_exact_dropped,
       coalesce(o.n_near_dropped, 0)::BIGINT AS n_near_dropped
FROM documents d LEFT JOIN done o ON d.doc_id = o.doc_id
"""
