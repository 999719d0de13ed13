"""Upload history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import IMPORT_LOG, column_names


def log_entries(log: DataFrame, limit: int = 200) -> DataFrame:
    """The newest log rows."""
    rows = log.select(*column_names(IMPORT_LOG))
    return rows.orderBy(F.col("performed_at").desc(), F.col("id").desc()).limit(limit)


def upload_sessions(log: DataFrame, limit: int | None = 50) -> DataFrame:
    """One row per upload and kind, newest first.

    Rows without an upload id form one group per kind, named after their lowest
    log id. ``all_ok`` ignores rows without a status.
    """
    groups = log.groupBy("upload_id", "kind").agg(
        F.min("id").alias("_id"),
        F.min("performed_at").alias("started_at"),
        F.max("performed_at").alias("finished_at"),
        F.sum("rows_total").alias("total_rows"),
        F.sum("rows_inserted").alias("total_inserted"),
        F.sum("rows_skipped").alias("total_skipped"),
        F.count(F.lit(1)).alias("event_count"),
        F.max("total_chunks").alias("chunks_expected"),
        F.bool_and(F.col("status") == "ok").alias("all_ok"),
    )
    named = groups.withColumn(
        "upload_id", F.coalesce("upload_id", F.concat(F.lit("no-id-"), F.col("_id").cast("string")))
    ).drop("_id")
    if limit is None:
        return named
    return named.orderBy(F.col("finished_at").desc(), "upload_id", "kind").limit(limit)
