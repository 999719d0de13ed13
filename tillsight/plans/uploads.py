"""Upload jobs: message chunks and contact snapshots from CSV files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..functions.times import instant
from ..operators import contacts, messages
from ..operators.keep import known_keys
from ..schemas import IMPORT_LOG, KNOWN_CONTACTS, MESSAGES
from ..sources import chunked, csvfiles, snapshots
from ..streaming import tables

RETENTION = "cutoff timestamp"
LOG_COLUMNS = [part.split()[0] for part in IMPORT_LOG.split(", ")]


def _log_row(counts: DataFrame, run_id: int, as_of: dt.datetime, **values) -> DataFrame:
    """One log row from a one-row frame of counters."""
    fixed = {
        "id": F.lit(run_id).cast("bigint"),
        "status": F.lit("ok"),
        "performed_at": instant(as_of),
        **{name: value if hasattr(value, "cast") else F.lit(value) for name, value in values.items()},
    }
    types = dict(part.split() for part in IMPORT_LOG.split(", "))
    return counts.withColumns(fixed).select(
        *[F.col(name).cast(types[name]).alias(name) for name in LOG_COLUMNS]
    )


def ingest_messages(
    spark: SparkSession,
    path: str,
    root: str,
    run_id: int,
    as_of: dt.datetime,
    upload_id: str | None = None,
    chunk_index: int = 0,
    total_chunks: int = 1,
    months: int = 6,
    split: bool = False,
) -> None:
    """Store the new messages of a CSV chunk and log its counters; the last chunk prunes.

    Messages lie in one folder per day, so retention and message windows skip days. A day
    (or all messages without a time) is split over tasks by size, small ones share a task.
    ``split`` reads large files in pieces; their values must have no line breaks.
    """
    batch = run_batch(run_id)
    _create_messages(spark, root)
    arrived = messages.normalize_messages(csvfiles.read_messages(spark, path, quoted_line_breaks=not split))
    arrived = tables.landed(arrived, f"{root}/arrived", batch)
    history = stored_messages(spark, root, but=batch)
    stored = known_keys(history, arrived, ["message_id"])
    new = messages.new_messages(arrived, stored).withColumn("day", F.to_date("datetime"))
    new.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{root}/messages/batch={batch}")
    counters = messages.upload_counters(arrived, stored)
    row = _log_row(
        counters, run_id, as_of, kind="messages", source="csv-chunk", upload_id=upload_id,
        chunk_index=chunk_index, total_chunks=total_chunks, details=None,
    )
    tables.write(row, f"{root}/import_log", batch)
    if chunk_index == total_chunks - 1:
        prune_messages(spark, root, run_id, as_of, months)


def run_batch(run_id: int) -> str:
    return tables.batch_name("run", run_id)


def _create_messages(spark: SparkSession, root: str) -> None:
    empty = spark.createDataFrame([], f"{MESSAGES}, day date")
    empty.write.mode("ignore").partitionBy("day").parquet(f"{root}/messages/batch={tables.BEFORE_FIRST}")
    tables.create(spark, f"{root}/retention", RETENTION)
    tables.create(spark, f"{root}/import_log", IMPORT_LOG)


def prune_messages(spark: SparkSession, root: str, run_id: int, as_of: dt.datetime, months: int = 6) -> None:
    """Forget messages older than some calendar months: one cutoff row, no rewrite.

    Readers apply the newest cutoff, which skips the folders of older days;
    ``compact_messages`` frees their space.
    """
    row = spark.range(1).select(times.months_before(as_of, months).alias("cutoff"))
    tables.write(row.coalesce(1), f"{root}/retention", run_batch(run_id))


def stored_messages(spark: SparkSession, root: str, but: str | None = None) -> DataFrame:
    """The messages that retention keeps (but those of one batch)."""
    cutoffs = tables.read(spark, f"{root}/retention", RETENTION)
    cutoff = cutoffs.agg(F.max("cutoff").alias("cutoff")).first()["cutoff"]
    stored = spark.read.schema(f"{MESSAGES}, batch string, day date").parquet(f"{root}/messages")
    if but is not None:
        stored = stored.filter(F.col("batch") != but)
    if cutoff is not None:
        in_days = F.col("day").isNull() | (F.col("day") >= F.lit(cutoff.date()))
        stored = messages.prune(stored.filter(in_days), F.lit(cutoff).cast("timestamp"))
    return stored.drop("batch", "day")


def compact_messages(spark: SparkSession, root: str, target: str) -> None:
    """Write the kept messages as the first batch of a new table, a folder per day."""
    _create_messages(spark, target)
    kept = stored_messages(spark, root).withColumn("day", F.to_date("datetime"))
    kept = kept.hint("rebalance", "day").sortWithinPartitions("datetime")
    kept.write.mode("overwrite").partitionBy("day").parquet(f"{target}/messages/batch={tables.BEFORE_FIRST}")


def ingest_contacts(
    spark: SparkSession,
    path: str,
    root: str,
    run_id: int,
    as_of: dt.datetime,
    upload_id: str,
    total_chunks: int,
) -> None:
    """Assemble the chunks of a contact upload, register new ids, publish the snapshot.

    ``path`` holds the chunk files as ``<upload_id>/<chunk_index>.csv``; a quoted value may
    go on in the next chunk. A chunk that is missing stops the job before anything is written.
    """
    batch = run_batch(run_id)
    tables.create(spark, f"{root}/known_contacts", KNOWN_CONTACTS)
    tables.create(spark, f"{root}/import_log", IMPORT_LOG)
    files = spark.read.format("binaryFile").load(f"{path}/{upload_id}/*.csv").select(
        F.lit(upload_id).alias("upload_id"),
        F.regexp_extract("path", r"([0-9]+)\.csv$", 1).cast("int").alias("chunk_index"),
        F.lit(total_chunks).alias("total_chunks"),
        F.col("modificationTime").alias("received_at"),
    )
    state = contacts.chunk_manifest(files).first()
    if state is None or not state["complete"]:
        got = 0 if state is None else state["chunks_received"]
        raise ValueError(f"missing chunks: got {got} of {total_chunks}")

    pieces = chunked.piece_files(spark, f"{path}/{upload_id}")
    rows = tables.landed(chunked.read_contact_pieces(pieces), f"{root}/rows", batch)
    known = tables.others(spark, f"{root}/known_contacts", KNOWN_CONTACTS, batch)
    tables.write(contacts.new_contacts(rows, known, as_of), f"{root}/known_contacts", batch)
    snapshots.publish(rows, f"{root}/snapshots", "contacts", as_of)
    counts = contacts.new_contact_counts(rows, known).withColumn("rows_inserted", F.col("rows_total"))
    details = F.to_json(F.struct(F.col("new_contacts").alias("newContacts")))
    row = _log_row(
        counts, run_id, as_of, kind="contacts", source="csv", upload_id=upload_id,
        chunk_index=None, total_chunks=None, details=details,
    )
    chunks = contacts.staged_chunks(files).select(
        "chunk_index", *[F.lit(0).cast("bigint").alias(c) for c in ("rows_total", "rows_inserted", "rows_skipped")]
    )
    each = _log_row(
        chunks, run_id, as_of, kind="contacts-chunk", source="csv-chunk", upload_id=upload_id,
        chunk_index=F.col("chunk_index"), total_chunks=total_chunks, details=None,
    )
    tables.write(each.unionByName(row), f"{root}/import_log", batch)


def contact_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The latest contact rows; ``row_no`` follows the reading order of the upload."""
    stored = snapshots.read_latest(spark, f"{root}/snapshots", "contacts")
    return stored.withColumn("row_no", F.struct("chunk_place", "line_no"))


def import_log(spark: SparkSession, root: str) -> DataFrame:
    return tables.read(spark, f"{root}/import_log", IMPORT_LOG).drop("batch")
