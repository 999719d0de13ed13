"""Ticket-line feed as a stream: purchases, rejects, sync state, touched customers."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import instant
from ..operators import customers, merge, purchases
from ..operators.keep import keep_last, known_keys
from ..params import Lookups, Thresholds
from ..schemas import PURCHASES, SUMMARY, SYNC_STATE, column_names
from ..session import dealt_by_first_key
from . import tables

REJECTS = "store_code string, ticket_id string, line_no bigint, product_code_raw string, reject_reason string"
SYNC_KEY = "sales_sync_"


@dataclass(frozen=True)
class SalesFeed:
    """Where a sales stream writes, and the rules it applies.

    The facts about customers lie in ``buckets`` folders by a hash of the phone, so a
    batch reads the folders of its own phones.
    """

    root: str
    lookups: Lookups
    limits: Thresholds
    as_of: dt.date
    buckets: int = 32

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stores(self) -> list[str]:
        return [store for store, _ in self.lookups.store_rules]


def sync_runs(feed: SalesFeed, scanned: DataFrame, new: DataFrame, log: DataFrame) -> DataFrame:
    """One finished run for every tracked store, whether or not it had lines.

    The cursor is the last scanned ticket, accepted or not; without one it stays.
    """
    spark = scanned.sparkSession
    keys = spark.createDataFrame([(store,) for store in feed.stores()], "store_code string")
    ends = purchases.high_water_marks(scanned).select("store_code", F.col("last_ticket").alias("seen"))
    counts = new.groupBy("store_code").agg(F.count(F.lit(1)).alias("rows"))
    before = log.groupBy(F.substring("sync_key", len(SYNC_KEY) + 1, 1 << 20).alias("store_code")).agg(
        F.max(F.col("last_cursor").try_cast("bigint")).alias("mark")
    )
    joined = keys.join(ends, "store_code", "left").join(counts, "store_code", "left").join(before, "store_code", "left")
    return joined.select(
        F.concat(F.lit(SYNC_KEY), "store_code").alias("sync_key"),
        instant(dt.datetime.combine(feed.as_of, dt.time())).alias("last_run_at"),
        F.greatest("seen", "mark").cast("string").alias("last_cursor"),
        F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows_synced"),
        F.lit("complete").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
    )


def store_batch(scanned: DataFrame, feed: SalesFeed, batch: str, by_ticket: bool = False) -> DataFrame:
    """Store what scanned lines add: purchases, rejects and sync state; returns the purchases.

    The lines are landed once; every branch reads the landed copy. If they come ``by_ticket``,
    so does the copy, and only the keys of the history are dealt anew to be compared.
    """
    spark = scanned.sparkSession
    lines = purchases.clean_lines(scanned, feed.lookups, feed.limits)
    if by_ticket:
        lines = tables.landed_by(lines, "ticket_id", feed.path("lines"), batch)
    else:
        lines = tables.landed(lines, feed.path("lines"), batch)
    history = tables.others(spark, feed.path("purchases"), PURCHASES, batch)
    fit = purchases.accepted(lines)
    with dealt_by_first_key(spark):
        stored = known_keys(history, fit, purchases.PURCHASE_KEY)
        tables.write(purchases.new_purchases(fit, stored), feed.path("purchases"), batch)
    return book_batch(lines, feed, batch)


def book_batch(lines: DataFrame, feed: SalesFeed, batch: str) -> DataFrame:
    """The rejects and the sync state of a batch whose lines and purchases are stored."""
    spark = lines.sparkSession
    rejects = tables.others(spark, feed.path("rejects"), REJECTS, batch)
    tables.write(purchases.new_rejects(lines, rejects), feed.path("rejects"), batch)
    new = tables.of_batch(spark, feed.path("purchases"), PURCHASES, batch)
    log = tables.others(spark, feed.path("sync_log"), SYNC_STATE, batch)
    tables.write(sync_runs(feed, lines, new, log), feed.path("sync_log"), batch)
    return new


def finish_lost(spark: SparkSession, feed: SalesFeed, but: str) -> None:
    """Do what a batch left undone that stored its purchases and then died with its checkpoint."""
    for batch in tables.unfinished(spark, feed.path("purchases"), PURCHASES):
        if batch != but:
            lines = spark.read.parquet(f"{feed.path('lines')}/batch={batch}")
            refresh_touched(book_batch(lines, feed, batch), feed, batch)


def refresh_touched(new: DataFrame, feed: SalesFeed, batch: str) -> None:
    """Add the facts of new purchases and write the summaries of their phones anew.

    Purchase lines are not read again: the facts of the touched phones add up to
    their summaries, and only the folders of their buckets are read.
    """
    spark = new.sparkSession
    bucket = F.pmod(F.xxhash64("phone"), F.lit(feed.buckets)).cast("int")
    own = customers.facts_of(new).withColumn("bucket", bucket)
    path = feed.path("facts")
    own.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch}")
    # At most one number per bucket.
    used = sorted(row["bucket"] for row in new.select(bucket.alias("bucket")).distinct().collect())
    facts = spark.read.schema(f"{customers.FACTS}, batch string, bucket int").parquet(path)
    phones = new.select("phone").distinct()
    facts = facts.filter(F.col("bucket").isin(used)).join(phones, "phone", "left_semi")
    summary = customers.customers_from_facts(facts, feed.as_of, feed.limits)
    number = tables.next_version(spark, feed.path("customers"))
    rows = summary.select(*column_names(SUMMARY), F.lit(number).cast("bigint").alias("seq"))
    tables.write_version(rows, feed.path("customers"), batch)
    tables.finished(spark, feed.path("purchases"), batch)


def create(spark: SparkSession, feed: SalesFeed) -> None:
    tables.create(spark, feed.path("purchases"), PURCHASES)
    tables.create(spark, feed.path("rejects"), REJECTS)
    tables.create(spark, feed.path("sync_log"), SYNC_STATE)
    tables.create(spark, feed.path("customers"), f"{SUMMARY}, seq bigint")


def start_ingest(stream: DataFrame, feed: SalesFeed, checkpoint: str) -> StreamingQuery:
    """Append the new purchases of each batch, then refresh the customers it touched."""
    create(stream.sparkSession, feed)
    told: set[str] = set()

    def process(batch: DataFrame, batch_id: int) -> None:
        name = tables.batch_name(tables.run_name(batch.sparkSession, checkpoint), batch_id)
        if not told:
            # Once per start: an earlier stream may have died half-way.
            finish_lost(batch.sparkSession, feed, name)
            told.add(name)
        new = store_batch(purchases.scan_pos(batch, feed.lookups.store_rules), feed, name)
        refresh_touched(new, feed, name)

    return (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stored_purchases(spark: SparkSession, feed: SalesFeed) -> DataFrame:
    return tables.read(spark, feed.path("purchases"), PURCHASES).drop("batch")


def current_customers(spark: SparkSession, feed: SalesFeed) -> DataFrame:
    """The latest summary of each phone; date-dependent columns follow ``as_of``."""
    stored = tables.read(spark, feed.path("customers"), f"{SUMMARY}, seq bigint")
    latest = keep_last(stored, ["phone"], ["seq"]).drop("batch", "seq")
    return customers.with_derived(latest, feed.as_of, feed.limits)


def compact_customers(spark: SparkSession, feed: SalesFeed, target: str) -> None:
    """The latest summaries and the folded facts as the first batch of new tables."""
    rows = current_customers(spark, feed).withColumn("seq", F.lit(0).cast("bigint"))
    tables.write(rows.select(*column_names(SUMMARY), "seq"), f"{target}/customers", tables.BEFORE_FIRST)
    facts = spark.read.schema(f"{customers.FACTS}, batch string, bucket int").parquet(feed.path("facts"))
    bucket = F.pmod(F.xxhash64("phone"), F.lit(feed.buckets)).cast("int")
    once = customers.folded(facts).withColumn("bucket", bucket).repartition("bucket")
    once.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/facts/batch={tables.BEFORE_FIRST}")


def sync_state(spark: SparkSession, feed: SalesFeed) -> DataFrame:
    """One row per feed, accumulated over all batches."""
    log = tables.read(spark, feed.path("sync_log"), SYNC_STATE).drop("batch")
    return merge.sync_state(log)
