"""What the corpus operators share: word patterns, folds, text defaults, column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII blanks. Java and RE2 read it alike.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"

#: Internal columns start with this, so that they don't clash with a table's own.
OWN = "__hl_"


def text_or_empty(text: str | Column = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def n_words(text: str | Column = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo the number of folds (null for a null id)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(folds)).cast("int")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Without columns that carry the names of an operator's outputs (in any case)."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])
