"""Paths named in event texts, and the policy of what to capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Absolute POSIX paths, drive paths and URLs to files: a character before, then the path.
POSIX = r"(?:^|[ \t\n\r\"'`(=:,])((?:/[A-Za-z0-9._@+-]+)+/?[A-Za-z0-9_@+-])"
DRIVE = r"(?:^|[ \t\n\r\"'`(=,])([A-Za-z]:(?:[/\\][A-Za-z0-9._@ +-]+)+)"


def candidate_paths(text: Column) -> Column:
    """Distinct paths of a text, sorted."""
    found = F.concat(F.regexp_extract_all(text, F.lit(POSIX), F.lit(1)), F.regexp_extract_all(text, F.lit(DRIVE), F.lit(1)))
    return F.array_sort(F.array_distinct(found))


def exclusion_reason(path: Column, size: Column, *, roots: tuple[str, ...] = (), extensions: tuple[str, ...] = (), max_bytes: int = 25 << 20) -> Column:
    """Why a path isn't captured, null if it is. Reasons are asked in this order."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    under = F.lit(False)
    for r in roots:
        under = under | path.startswith(r.rstrip("/") + "/")
    return (
        F.when(path.isNull() | (path == ""), "invalid")
        .when(under, "excluded_root")
        .when(size.isNull(), "missing")
        .when(F.lit(bool(extensions)) & ~ext.isin(*(extensions or ("",))), "extension")
        .when(size > max_bytes, "too_large")
    )


def capture_plan(paths: DataFrame, reason: Column) -> DataFrame:
    """reason (null: captured), n_paths."""
    return paths.withColumn("reason", reason).groupBy("reason").agg(F.count("*").alias("n_paths"))
