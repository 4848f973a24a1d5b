"""Images inside of log lines: payloads to a table of their own, references in their place, and back.

A data URI that is a whole JSON string becomes an object with the reference, type and size; one
within a longer string is replaced by the reference alone. Payloads are kept once by the hash
of their bytes, observations say which line held which. Putting them back gives the line as it
was, byte for byte: only payloads whose base64 is in canonical form are taken out.

Scale: taking out is column expressions in the scan; payloads meet by hash, pre-aggregated, so
an image that a third of all lines hold is exchanged once per task. Putting back joins only
lines with references to the payloads that they name.

Defined cases: lines without a payload stay as they are, null lines null; what is no base64, or
not in canonical form, stays; an image may occur in a line more than once; a reference whose payload is missing
stays a reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFERENCE = "artifact://sha256/"
_URI = r"data:(image/[A-Za-z0-9.+-]+);base64,([A-Za-z0-9+/]+={0,2})"
_OBJECT = r'\{"\$artifact":"artifact://sha256/([0-9a-f]{64})","mime_type":"(image/[A-Za-z0-9.+-]+)","size_bytes":[0-9]+\}'
_INSIDE = r"artifact://sha256/([0-9a-f]{64});(image/[A-Za-z0-9.+-]+);"


def encoded(content: Column) -> Column:
    """Base64 without line ends, which Spark puts in by default."""
    return F.translate(F.base64(content), "\r\n", "")


def _found(raw: Column) -> Column:
    """Payloads of a line, once each: uri, mime_type, content, sha256."""
    uris = F.array_distinct(F.regexp_extract_all(raw, F.lit(_URI), F.lit(0)))

    def one(uri: Column) -> Column:
        text = F.substring_index(uri, ",", -1)
        content = F.when(F.length(text) % 4 == 0, F.try_to_binary(text, F.lit("base64")))
        return F.struct(uri.alias("uri"), F.regexp_extract(uri, _URI, 1).alias("mime_type"), content.alias("content"), F.sha2(content, 256).alias("sha256"))

    kept = F.filter(F.transform(uris, one), lambda x: x["content"].isNotNull() & (encoded(x["content"]) == F.substring_index(x["uri"], ",", -1)))
    # longer ones first: one may begin as another does
    return F.array_sort(kept, lambda a, b: F.when(F.length(a["uri"]) > F.length(b["uri"]), -1).when(F.length(a["uri"]) < F.length(b["uri"]), 1).when(a["uri"] < b["uri"], -1).when(a["uri"] > b["uri"], 1).otherwise(0))


def take_out(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """``lines`` with references in place of payloads, and these as ``artifacts`` (uri, mime_type, content, sha256)."""
    rows = lines.withColumn("artifacts", _found(F.col(raw)))

    def shown(line: Column, x: Column) -> Column:
        reference = F.concat(F.lit(REFERENCE), x["sha256"])
        whole = F.concat(F.lit('{"$artifact":"'), reference, F.lit('","mime_type":"'), x["mime_type"], F.lit('","size_bytes":'), F.octet_length(x["content"]).cast("string"), F.lit("}"))
        line = F.replace(line, F.concat(F.lit('"'), x["uri"], F.lit('"')), whole)
        return F.replace(line, x["uri"], F.concat(reference, F.lit(";"), x["mime_type"], F.lit(";")))

    # a line that looks as if it held references already keeps its payloads: they could not be told apart
    plain = F.contains(F.col(raw), F.lit(REFERENCE))
    rows = rows.withColumn("artifacts", F.when(plain, F.array().cast(rows.schema["artifacts"].dataType)).otherwise(F.col("artifacts")))
    return rows.withColumn(raw, F.aggregate("artifacts", F.col(raw), shown))


def payloads(taken: DataFrame) -> DataFrame:
    """sha256, size_bytes, content, once each."""
    rows = taken.select(F.explode("artifacts").alias("a")).select("a.sha256", "a.content")
    return rows.groupBy("sha256").agg(F.any_value("content").alias("content")).select("sha256", F.octet_length("content").cast("long").alias("size_bytes"), "content")


def observations(taken: DataFrame, key: list[str]) -> DataFrame:
    """key, sha256, mime_type: which line held what."""
    return taken.select(*key, F.explode("artifacts").alias("a")).select(*key, "a.sha256", "a.mime_type").distinct()


def put_back(lines: DataFrame, stored: DataFrame, key: list[str], raw: str = "raw") -> DataFrame:
    """``lines`` (key, raw) as they were. ``key``: columns that name a line."""
    whole = F.transform(F.regexp_extract_all(raw, F.lit(_OBJECT), F.lit(0)), lambda x: F.struct(x.alias("shown"), F.regexp_extract(x, _OBJECT, 1).alias("sha256"), F.regexp_extract(x, _OBJECT, 2).alias("mime_type"), F.lit('"').alias("quote")))
    inside = F.transform(F.regexp_extract_all(raw, F.lit(_INSIDE), F.lit(0)), lambda x: F.struct(x.alias("shown"), F.regexp_extract(x, _INSIDE, 1).alias("sha256"), F.regexp_extract(x, _INSIDE, 2).alias("mime_type"), F.lit("").alias("quote")))
    wanted = lines.select(*key, F.explode(F.array_distinct(F.concat(whole, inside))).alias("w")).select(*key, "w.*")
    uri = F.concat("quote", F.lit("data:"), "mime_type", F.lit(";base64,"), encoded(F.col("content")), "quote")
    found = wanted.join(stored.select("sha256", "content"), "sha256").groupBy(*key).agg(F.collect_list(F.struct("shown", uri.alias("uri"))).alias("__found"))
    # objects first: they hold what looks like the beginning of a reference within a string
    ordered = F.array_sort("__found", lambda a, b: F.when(F.length(a["shown"]) > F.length(b["shown"]), -1).when(F.length(a["shown"]) < F.length(b["shown"]), 1).otherwise(0))
    back = F.aggregate(F.coalesce(ordered, F.array().cast(found.schema["__found"].dataType)), F.col(raw), lambda line, x: F.replace(line, x["shown"], x["uri"]))
    return lines.join(found, key, "left").withColumn(raw, back).drop("__found")
