"""Versioned snapshots: write a new one, read the latest."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTERS = "kind string, snapshot string"


def latest_rows(uploads: DataFrame, kind: str) -> DataFrame:
    """Rows of the newest snapshot of a kind.

    The newest snapshot is one row, so joining it back is a broadcast of one
    row; on a table partitioned by upload time it prunes the other snapshots.
    Snapshots of the same instant are ordered by id.
    """
    own = uploads.filter(F.col("kind") == kind)
    newest = own.agg(F.max(F.struct("uploaded_at", "snapshot_id")).alias("m")).select("m.*")
    return own.join(F.broadcast(newest), ["uploaded_at", "snapshot_id"])


def publish(df: DataFrame, root: str, kind: str, uploaded_at: dt.datetime) -> None:
    """Write a snapshot next to the earlier ones, then a pointer row that names it.

    An empty snapshot counts like any other. Before the pointer is there readers
    see the previous snapshot; publishing the same one again replaces it.
    """
    spark = df.sparkSession
    name = snapshot_name(uploaded_at)
    df.write.mode("overwrite").parquet(f"{root}/data/{kind}/{name}")
    row = spark.createDataFrame([(kind, name)], POINTERS).coalesce(1)
    row.write.mode("overwrite").parquet(f"{root}/pointers/entry={kind}.{name}")


def snapshot_name(uploaded_at: dt.datetime) -> str:
    """A folder name that sorts by time."""
    return uploaded_at.strftime("t%Y%m%d%H%M%S%f")


def read_latest(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The newest snapshot under a root; only its own folder is read.

    Its name comes from the pointers, one small row per published snapshot.
    """
    pointers = spark.read.schema(POINTERS).parquet(f"{root}/pointers").filter(F.col("kind") == kind)
    newest = pointers.agg(F.max("snapshot").alias("snapshot")).first()["snapshot"]
    if newest is None:
        raise ValueError(f"no snapshot of {kind} under {root}")
    return spark.read.parquet(f"{root}/data/{kind}/{newest}")
