"""Fill-in-the-middle: documents cut at line ends, in prefix-suffix-middle or suffix-prefix-middle order.

The units of a text (its lines) are rows: ``posexplode`` numbers the matches of the unit
pattern, a window gives each the running sum of lengths, and the two cut requests of a document
are joined to its units by ordinal. What was found is added up to two offsets per document, by
which the text is cut. A text holding a sentinel stays plain, so an output can be taken apart
again without a doubt (``restored``).

Scale: units travel as numbers only, so a text is exchanged once, when its offsets come back
to it. Rows alike in id and text are one set of units, made so before the exchange; a document's
units lie in one task, as its text does. Offsets are written before they are joined, so the
shuffle files of the units are gone by then.

Defined cases: a null text is empty; an empty text, or one with a sentinel, is plain, and so is
one that its hash leaves out (``percent``); the hash of a null id is that of no digits; repeated
rows give repeated results (texts of one id are told apart by their 64-bit hash); a cut before the
first unit or after the last leaves an empty part; an empty table gives no rows. Columns named
like an output are replaced, others kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histlake.llm.common import OWN, text_or_empty, without
from histlake.sources import read_table, write_and_read

#: A line with its end, or a last one without.
LINES = r"[^\n]*\n|[^\n]+"
OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")
KEY = [f"{OWN}id", f"{OWN}null", f"{OWN}x"]


def _checked(sentinels: tuple[str, str, str]) -> None:
    """Sentinels that can't overlap each other or what stands beside them: none has the first character of one inside."""
    firsts = {s[:1] for s in sentinels}
    if len(set(sentinels)) < 3 or "" in firsts or any(c in firsts for s in sentinels for c in s[1:]):
        raise ValueError(f"sentinels must differ, and none may hold the first character of one further on: {sentinels}")


def _draw(id_col: str, seed: int, k: int) -> Column:
    """The k-th 32-bit number (from 0) of the id's sha256."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(named.cast("binary"), 256), 8 * k + 1, 8), 16, 10).cast("long")


def infill_documents(
    docs: DataFrame,
    *,
    units: str = LINES,
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
    percent: int = 100,
    spm_percent: int = 50,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows with n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    ``units``: a pattern whose matches, one after the other, are the whole text. ``sentinels``:
    before prefix, suffix and middle.
    """
    _checked(sentinels)
    text = text_or_empty(text_col)
    docs = without(docs, *OUTPUTS)
    columns = docs.columns
    n = F.regexp_count(text, F.lit(units)).cast("long")
    cuts = [F.pmod(_draw(id_col, seed, k), F.col("n") + 1) for k in (0, 1)]
    plain = (text == "") | (_draw(id_col, seed, 2) % 100 >= percent)
    for s in sentinels:
        plain = plain | F.contains(text, F.lit(s))
    form = F.when(plain, "plain").when(_draw(id_col, seed, 3) % 100 < spm_percent, "spm").otherwise("psm")
    key = {
        f"{OWN}id": F.coalesce(F.col(id_col), F.lit(0).cast(docs.schema[id_col].dataType)),
        f"{OWN}null": F.col(id_col).isNull(),
        f"{OWN}x": F.xxhash64(text),
    }
    planned = docs.withColumns({**key, "n": n, "form": form}).withColumns({f"{OWN}low": F.least(*cuts), f"{OWN}high": F.greatest(*cuts)})
    offsets = write_and_read(_offsets(planned, text, units), "infill-offsets")
    placed = planned.join(offsets, KEY, "left")
    a, b = [F.when(F.col("form") != "plain", F.coalesce(f"{OWN}{c}", F.lit(0))) for c in ("from", "to")]
    placed = placed.withColumns({"prefix_chars": a.cast("long"), "middle_chars": (b - a).cast("long")})
    return placed.select(*[F.col(f"`{c}`") for c in columns], "n", "form", "prefix_chars", "middle_chars", _assembled(text, sentinels).alias("output"))


def _offsets(planned: DataFrame, text: Column, units: str) -> DataFrame:
    """Code points before the middle and before the suffix of every document that is cut."""
    cut = planned.where("form != 'plain'")
    requests = cut.groupBy(*KEY).agg(F.max(f"{OWN}low").alias("low"), F.max(f"{OWN}high").alias("high"))
    lengths = F.transform(F.regexp_extract_all(text, F.lit(units), F.lit(0)), F.length)
    matches = cut.groupBy(*KEY).agg(F.any_value(lengths).alias("lengths")).select(*KEY, F.posexplode("lengths").alias("place", "length"))
    through = Window.partitionBy(*KEY).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = matches.select(*KEY, (F.col("place") + 1).cast("long").alias("units"), F.sum("length").over(through).alias("end"))
    # by ordinal: the unit after which the prefix, or the middle, ends (a cut before all units finds none)
    found = ends.join(requests, KEY).where("units in (low, high)")
    return found.groupBy(*KEY).agg(
        F.max(F.when(F.col("units") == F.col("low"), F.col("end"))).alias(f"{OWN}from"),
        F.max(F.when(F.col("units") == F.col("high"), F.col("end"))).alias(f"{OWN}to"),
    )


def _assembled(text: Column, sentinels: tuple[str, str, str]) -> Column:
    p, s, m = [F.lit(x) for x in sentinels]
    a, b = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b)
    suffix = F.substring(text, a + b + 1, F.length(text))
    psm, spm = F.concat(p, prefix, s, suffix, m, middle), F.concat(s, suffix, p, prefix, m, middle)
    return F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", psm).otherwise(spm)


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    p, s, m = sentinels
    out = F.col(output)

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands after ``first``, after ``second`` and after the middle's sentinel."""
        at, middle = F.locate(second, out), F.locate(m, out)
        one = F.substring(out, F.lit(len(first) + 1), at - len(first) - 1)
        two = F.substring(out, at + len(second), middle - at - len(second))
        return one, two, F.substring(out, middle + len(m), F.length(out))

    prefix, suffix, mid = between(p, s)
    psm = F.concat(prefix, mid, suffix)
    suffix, prefix, mid = between(s, p)
    spm = F.concat(prefix, mid, suffix)
    return F.when(F.col(form) == "plain", out).when(F.col(form) == "psm", psm).otherwise(spm)


def op11_infill(spark, sf_dir):
    made = infill_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored().cast("binary"), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(u)::BIGINT AS n, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT for k in [0, 1, 2, 3]] AS r FROM units),
cut AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS low, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS high,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
              WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m, array_to_string(u[high + 1:], '') AS s
  FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
