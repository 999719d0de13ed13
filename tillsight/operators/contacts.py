"""Contact snapshots: chunk completeness, first-seen registry."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.times import instant
from .keep import keep_last


def staged_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk of an upload; a chunk sent again replaces the earlier one."""
    rest = [name for name in chunks.columns if name not in ("upload_id", "chunk_index")]
    ordered = ["received_at", *[name for name in rest if name != "received_at"]]
    return keep_last(chunks, ["upload_id", "chunk_index"], ordered)


def chunk_manifest(chunks: DataFrame) -> DataFrame:
    """Per upload: chunks received, chunks expected, and whether all are there."""
    staged = staged_chunks(chunks)
    received = F.count(F.lit(1))
    return staged.groupBy("upload_id").agg(
        received.alias("chunks_received"),
        F.max("total_chunks").alias("chunks_expected"),
        (received == F.max("total_chunks")).alias("complete"),
        F.max("received_at").alias("last_received_at"),
    )


def assemble_rows(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of complete uploads in reading order.

    ``rows`` carry upload_id, chunk_index and line_no (the position in the
    chunk); the order of an upload is (chunk_index, line_no).
    """
    complete = chunk_manifest(chunks).filter("complete").select("upload_id")
    return rows.join(complete, "upload_id", "left_semi")


def _ids(contacts: DataFrame) -> DataFrame:
    trimmed = contacts.select(text.strip(F.col("contact_id")).alias("contact_id"))
    return trimmed.filter(F.col("contact_id") != "")


def new_contacts(contacts: DataFrame, known: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Registry rows for the contact ids seen for the first time."""
    unseen = _ids(contacts).distinct().join(known.select("contact_id"), "contact_id", "left_anti")
    return unseen.withColumn("first_seen", instant(as_of))


def new_contact_counts(contacts: DataFrame, known: DataFrame) -> DataFrame:
    """Counters of a snapshot: rows, new ids with and without repeats, skipped rows."""
    total = F.count(F.lit(1))
    per_id = (
        contacts.select(text.strip(text.or_empty(F.col("contact_id"))).alias("contact_id"))
        .groupBy("contact_id")
        .agg(total.alias("rows"))
    )
    stored = known.select("contact_id", F.lit(True).alias("_known"))
    flagged = per_id.join(stored, "contact_id", "left")
    is_new = (F.col("contact_id") != "") & F.col("_known").isNull()
    rows = F.coalesce(F.sum("rows"), F.lit(0))
    new = F.coalesce(F.sum(F.when(is_new, F.col("rows"))), F.lit(0))
    return flagged.agg(
        rows.alias("rows_total"),
        new.alias("new_contacts"),
        F.count_if(is_new).alias("new_contacts_distinct"),
        (rows - new).alias("rows_skipped"),
    )


def profile_messages(
    contacts: DataFrame, messages: DataFrame, lookback: int = 20
) -> DataFrame:
    """The newest messages of each phone, through its contacts.

    Messages are limited per contact before the join, so a contact that holds a
    large share of all messages sends at most ``lookback`` rows per task.
    """
    newest = [F.col("datetime").desc_nulls_last(), F.col("message_id").desc()]
    per_contact = Window.partitionBy("contact_id").orderBy(*newest)
    per_phone = Window.partitionBy("phone").orderBy(*newest)
    recent = (
        messages.filter(F.col("contact_id") != "")
        .withColumn("_rank", F.row_number().over(per_contact))
        .filter(F.col("_rank") <= lookback)
        .drop("_rank")
    )
    owners = contacts.select(
        text.normalize_phone(F.col("phone")).alias("phone"),
        text.strip(F.col("contact_id")).alias("contact_id"),
    ).filter(F.col("phone").isNotNull())
    return (
        recent.join(owners.distinct(), "contact_id")
        .withColumn("position", F.row_number().over(per_phone))
        .filter(F.col("position") <= lookback)
        .select("phone", "position", "message_id", "contact_id", "datetime",
                "message_type", "content_type", "content_raw")
    )
