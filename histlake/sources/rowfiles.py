"""Row streams: a table as gzip JSON lines with a manifest, checked when it is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histlake.operators.digest import table_digest

FORMAT = "histlake-rows-1"
#: The digest of no rows.
NO_ROWS = ""


def write_row_stream(rows: DataFrame, path: str, name: str) -> None:
    """``path``/rows holds the rows, ``path``/manifest their schema, count and digest."""
    rows.write.json(f"{path}/rows", compression="gzip", ignoreNullFields=False)
    # one row, whether the digest has one or, of a table without rows, none
    facts = rows.sparkSession.range(1).select().join(table_digest(rows, rows.columns), how="left")
    facts = facts.select(F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("digest", F.lit(NO_ROWS)).alias("digest"))
    manifest = facts.select(F.lit(FORMAT).alias("format"), F.lit(name).alias("name"), F.lit(rows.schema.json()).alias("schema"), "n_rows", "digest")
    manifest.coalesce(1).write.json(f"{path}/manifest")


def read_row_stream(spark: SparkSession, path: str) -> DataFrame:
    """The rows, after their format, count and digest have been checked."""
    import json

    from pyspark.sql.types import StructType

    found = spark.read.json(f"{path}/manifest").collect()
    if not found:
        raise ValueError(f"{path}: no manifest")
    manifest = found[0]
    if manifest["format"] != FORMAT:
        raise ValueError(f"{path}: format {manifest['format']}")
    rows = spark.read.schema(StructType.fromJson(json.loads(manifest["schema"]))).json(f"{path}/rows")
    now = table_digest(rows, rows.columns).collect()
    facts = (now[0]["n_rows"] or 0, now[0]["digest"] or NO_ROWS) if now else (0, NO_ROWS)
    if facts != (manifest["n_rows"], manifest["digest"]):
        raise ValueError(f"{path}: rows differ from the manifest")
    return rows


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """task_id, evidence_id, policy, applies_to, content of a gzip queue of tasks with evidence lists."""
    item = "struct<evidence_id:string,policy:string,applies_to:string,content:string>"
    tasks = spark.read.schema(f"task_id string, evidence array<{item}>").json(path)
    return tasks.select("task_id", F.explode("evidence").alias("e")).select("task_id", "e.*")


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """thread_id, title of a session index (the last line of a thread counts)."""
    rows = spark.read.schema("id string, thread_name string, title string, updated_at string").json(path)
    named = rows.select(F.col("id").alias("thread_id"), F.coalesce("thread_name", "title").alias("title"), "updated_at").where("thread_id is not null")
    return named.groupBy("thread_id").agg(F.max_by("title", F.struct(F.coalesce("updated_at", F.lit("")), "title")).alias("title"))


def export_delta(base: dict[str, DataFrame], now: dict[str, DataFrame], keys: dict[str, list[str]], path: str) -> None:
    """Per table: rows that are new or differ, and keys that are gone."""
    for name, rows in now.items():
        old = base[name]
        changed = rows.join(old, [rows[c].eqNullSafe(old[c]) for c in rows.columns], "left_anti")
        changed.write.parquet(f"{path}/{name}/upserts")
        old.select(*keys[name]).join(rows.select(*keys[name]), keys[name], "left_anti").write.parquet(f"{path}/{name}/deletes")


def apply_delta(spark: SparkSession, base: dict[str, DataFrame], keys: dict[str, list[str]], path: str) -> dict[str, DataFrame]:
    out = {}
    for name, old in base.items():
        upserts = spark.read.schema(old.schema).parquet(f"{path}/{name}/upserts")
        deletes = spark.read.schema(old.select(*keys[name]).schema).parquet(f"{path}/{name}/deletes")
        kept = old.join(deletes, keys[name], "left_anti").join(upserts.select(*keys[name]), keys[name], "left_anti")
        out[name] = kept.unionByName(upserts)
    return out
