"""Sinks (ids K1, K5, K6, K7): JSON exports, answers and errors apart, contexts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines, UTF-8, nothing escaped that need not be."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def json_text(df: DataFrame) -> DataFrame:
    """(json) of every row, as one readable text."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def write_outcomes(df: DataFrame, ok: Column, ok_path: str, error_path: str) -> None:
    """Rows that succeeded and rows that failed, each to their own place."""
    held = df.cache()
    try:
        held.where(ok).write.mode("append").json(ok_path)
        held.where(~F.coalesce(ok, F.lit(False))).write.mode("append").json(error_path)
    finally:
        held.unpersist()


def write_contexts(contexts: DataFrame, path: str) -> None:
    """Distinct contexts, once: an output that is there stays as it is."""
    contexts.where("context is not null").select("context").distinct().write.mode("ignore").json(path)
