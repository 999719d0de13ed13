"""Chat messages: normalise, de-duplicate, prune, window and page."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, times
from ..schemas import MESSAGES, column_names
from ..session import scratch_path
from .enrich import one_row
from .keep import keep_first, not_in


def normalize_messages(raw: DataFrame) -> DataFrame:
    """Trim ids, lower-case the types, parse the time, replace missing by ''.

    Rows without a message id are kept here (with id '') so that they can be
    counted; ``dedup_messages`` drops them.
    """

    def lowered(name: str) -> Column:
        return F.lower(text.or_empty(F.col(name))).alias(name)

    moment = F.col("datetime")
    if isinstance(raw.schema["datetime"].dataType, T.StringType):
        moment = times.parse_time(moment)
    else:
        moment = moment.cast("timestamp")
    extra = [name for name in ("arrival",) if name in raw.columns]
    return raw.select(
        *extra,
        text.strip(text.or_empty(F.col("message_id"))).alias("message_id"),
        text.strip(text.or_empty(F.col("contact_id"))).alias("contact_id"),
        moment.alias("datetime"),
        lowered("message_type"),
        lowered("content_type"),
        text.or_empty(F.col("content_raw")).alias("content_raw"),
        lowered("sender_type"),
        text.or_empty(F.col("channel_id")).alias("channel_id"),
        text.or_empty(F.col("type_field")).alias("type_field"),
        text.or_empty(F.col("sub_type")).alias("sub_type"),
    )


def dedup_messages(messages: DataFrame) -> DataFrame:
    """First arrival per message id; rows without an id are dropped."""
    columns = column_names(MESSAGES)
    with_id = messages.filter(F.col("message_id") != "")
    rest = [name for name in columns if name != "message_id"]
    return keep_first(with_id, ["message_id"], ["arrival", *rest]).select(*columns)


def new_messages(batch: DataFrame, table: DataFrame) -> DataFrame:
    """First arrivals of a batch that the message table does not have."""
    return not_in(dedup_messages(batch), table, ["message_id"])


def upload_counters(batch: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of a batch: total, inserted and skipped (no id, repeated, already stored)."""
    per_id = batch.groupBy("message_id").agg(F.count(F.lit(1)).alias("rows"))
    stored = table.select("message_id", F.lit(True).alias("_stored"))
    flagged = per_id.join(stored, "message_id", "left")
    has_id = F.col("message_id") != ""
    inserted = F.count_if(has_id & F.col("_stored").isNull())
    rows = F.coalesce(F.sum("rows"), F.lit(0))

    def total(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))

    is_stored = F.col("_stored").isNotNull()
    return flagged.agg(
        rows.alias("rows_total"),
        inserted.alias("rows_inserted"),
        (rows - inserted).alias("rows_skipped"),
        total(~has_id, F.col("rows")).alias("skipped_no_id"),
        total(has_id & is_stored, F.col("rows")).alias("skipped_stored"),
        total(has_id & ~is_stored, F.col("rows") - 1).alias("skipped_repeated"),
    )


def prune(messages: DataFrame, cutoff: Column) -> DataFrame:
    """Messages to retain: not older than the cutoff, or without a time."""
    return messages.filter(F.col("datetime").isNull() | (F.col("datetime") >= cutoff))


def prune_months(messages: DataFrame, as_of: dt.datetime, months: int = 6) -> DataFrame:
    return prune(messages, times.months_before(as_of, months))


def in_window(messages: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """Messages of the last ``days`` times 24 hours; a missing time is never inside."""
    return messages.filter(F.col("datetime") >= times.days_before(as_of, days))


def slim(messages: DataFrame, *extra: str) -> DataFrame:
    """Compact rows: time, contact, message type, content type, content."""
    return messages.select(
        *extra,
        times.format_time(F.col("datetime")).alias("dt"),
        text.or_empty(F.col("contact_id")).alias("ci"),
        text.or_empty(F.col("message_type")).alias("mt"),
        text.or_empty(F.col("content_type")).alias("ct"),
        text.slim_content(F.col("content_raw"), F.col("content_type")).alias("cn"),
    )


def message_page(
    messages: DataFrame,
    as_of: dt.datetime,
    days: int,
    limit: int,
    cursor: tuple[dt.datetime, str] | None = None,
) -> DataFrame:
    """One page, newest first, after the (time, id) cursor.

    The cursor is compared at microseconds, so no row repeats or is skipped.
    """
    rows = in_window(messages, as_of, days)
    if cursor is not None:
        moment, last_id = times.instant(cursor[0]), F.lit(cursor[1])
        rows = rows.filter(
            (F.col("datetime") < moment)
            | ((F.col("datetime") == moment) & (F.col("message_id") < last_id))
        )
    newest = rows.orderBy(F.col("datetime").desc(), F.col("message_id").desc()).limit(limit)
    return slim(newest, "datetime", "message_id")


def page_cursor(page: DataFrame, limit: int) -> DataFrame:
    """Size of a page and, if it is full, the cursor of the next one."""
    last = F.min(F.struct("datetime", "message_id"))
    full = F.count(F.lit(1)) == limit
    return page.agg(
        F.count(F.lit(1)).alias("page_count"),
        full.alias("has_more"),
        F.when(full, last["datetime"]).alias("next_dt"),
        F.when(full, last["message_id"]).alias("next_id"),
    )


def message_pages(
    messages: DataFrame, as_of: dt.datetime, days: int, page_size: int
) -> DataFrame:
    """Every page of a window at once: each message with its page number.

    Rows are range-partitioned on the unique (time, id) order, so one busy
    second splits over tasks, and sorted within partitions. The sorted rows are
    written once, as Parquet in the shared folder, which the caller empties; their
    positions follow from the sizes of the partitions before them, one number per
    partition, for which one column is read. No task ever holds the whole order.
    """
    order = [F.col("datetime").desc(), F.col("message_id").desc()]
    local = (
        slim(in_window(messages, as_of, days), "datetime", "message_id")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    path = scratch_path(messages.sparkSession, "message-pages")
    local.write.parquet(path)
    stored = messages.sparkSession.read.schema(local.schema).parquet(path).withColumns(
        {
            "_part": F.shiftright("_id", 33),
            "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    # One row per shuffle partition, so the broadcast side is bounded.
    position = F.col("_offset") + F.col("_row")
    return stored.join(F.broadcast(offsets), "_part").select(
        (F.floor(position / F.lit(page_size)) + 1).cast("bigint").alias("page_no"),
        (position + 1).alias("position"),
        "datetime", "message_id", "dt", "ci", "mt", "ct", "cn",
    )


def active_contact_ids(messages: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """Contacts with a message in the window, each once."""
    return (
        in_window(messages, as_of, days)
        .filter(F.col("contact_id").isNotNull() & (F.col("contact_id") != ""))
        .select("contact_id")
        .distinct()
    )


def active_contacts(
    contacts: DataFrame, messages: DataFrame, as_of: dt.datetime, days: int
) -> DataFrame:
    """Contact rows, in their seven export columns, that are active in the window."""
    active = active_contact_ids(messages, as_of, days)
    keyed = contacts.withColumn("contact_id", text.strip(text.or_empty(F.col("contact_id"))))
    kept = keyed.join(active, "contact_id", "left_semi")

    def cell(name: str, output: str) -> Column:
        return text.strip(text.or_empty(F.col(name))).alias(output)

    return kept.select(
        F.col("contact_id").alias("ContactID"),
        cell("first_name", "FirstName"),
        cell("last_name", "LastName"),
        cell("phone", "PhoneNumber"),
        cell("lifecycle", "Lifecycle"),
        cell("assignee", "Assignee"),
        cell("ciudad", "ciudad"),
    )


def active_by_day(messages: DataFrame, days: int) -> DataFrame:
    """For every day: its messages, and the different contacts of the ``days`` days that end with it.

    Contacts get dense numbers once. A day's contacts are bitmaps of 32,768 of them each,
    exact and mergeable: a day's bitmaps are combined with those of the days before it, so
    contacts are neither counted nor shuffled again for every window they fall into.
    """
    timed = messages.where("datetime IS NOT NULL").withColumn("day", F.to_date("datetime"))
    per_day = timed.groupBy("day").agg(F.count(F.lit(1)).alias("messages"))
    active = timed.where("contact_id <> ''").groupBy("day", "contact_id").agg(F.lit(1).alias("_one"))
    numbers = dense_numbers(active.select("contact_id").distinct(), "contact_id")
    numbered = active.join(numbers, "contact_id")
    maps = numbered.groupBy("day", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    )
    reach = F.sequence(F.col("day"), F.date_add("day", days - 1), F.expr("INTERVAL 1 DAY"))
    windows = maps.select(F.explode(reach).alias("day"), "bucket", "bits")
    counted = windows.groupBy("day", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("contacts"))
    totals = counted.groupBy("day").agg(F.sum("contacts").alias("active_contacts"))
    return per_day.join(totals, "day", "left").withColumn("active_contacts", F.coalesce("active_contacts", F.lit(0)))


def dense_numbers(values: DataFrame, column: str) -> DataFrame:
    """Different values with numbers from 0 without gaps, in no particular order.

    A value's number is its place in its task plus the sizes of the tasks before it, one
    number per task; the values are written once, so both readings agree.
    """
    spark = values.sparkSession
    path = scratch_path(spark, "numbers")
    local = values.repartition(column).withColumn("_id", F.monotonically_increasing_id())
    local.write.parquet(path)
    stored = spark.read.schema(local.schema).parquet(path).withColumn("_part", F.shiftright("_id", 33))
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_offset")
    return stored.join(offsets, "_part").select(column, place.alias("number"))


def window_summary(
    messages: DataFrame,
    contacts: DataFrame,
    known: DataFrame,
    uploads: DataFrame,
    as_of: dt.datetime,
    days: int,
) -> DataFrame:
    """One row: messages and active contacts in the window, contact totals, last upload."""
    in_time = F.col("datetime") >= times.days_before(as_of, days)
    return one_row(
        messages.agg(F.count_if(in_time).alias("message_count")),
        active_contacts(contacts, messages, as_of, days).agg(
            F.count(F.lit(1)).alias("contact_count")
        ),
        contacts.agg(F.count(F.lit(1)).alias("total_contacts")),
        known.agg(
            F.count_if(F.col("first_seen") >= times.hours_before(as_of, 24)).alias("new_contact_count")
        ),
        uploads.agg(F.max("uploaded_at").alias("last_upload")),
    ).withColumn("window_days", F.lit(days))
