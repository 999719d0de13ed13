"""Sales sync: pull new ticket lines, store purchases, refresh all customers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import customers, enrich, merge, purchases
from ..schemas import CUSTOMERS, PURCHASES, SYNC_STATE, column_names
from ..streaming import tables
from ..streaming.sales import REJECTS, SYNC_KEY, SalesFeed, store_batch


def run_batch(run_id: int) -> str:
    return tables.batch_name("run", run_id)


def marks(spark: SparkSession, feed: SalesFeed, run_id: int) -> dict[str, int | None]:
    """High-water mark of each tracked store before a run, one number per store rule; None before the first."""
    log = tables.others(spark, feed.path("sync_log"), SYNC_STATE, run_batch(run_id))
    keys = [f"{SYNC_KEY}{store}" for store in feed.stores()]
    latest = (
        log.filter(F.col("sync_key").isin(keys))
        .groupBy("sync_key")
        .agg(F.max(F.col("last_cursor").try_cast("bigint")).alias("mark"))
    )
    found = {row["sync_key"]: row["mark"] for row in latest.collect()}
    return {store: found.get(f"{SYNC_KEY}{store}") for store in feed.stores()}


def create_tables(spark: SparkSession, feed: SalesFeed) -> None:
    for name, schema in (("purchases", PURCHASES), ("rejects", REJECTS), ("sync_log", SYNC_STATE)):
        tables.create(spark, feed.path(name), schema)


def sync(lines: DataFrame, feed: SalesFeed, run_id: int, reset: bool = False, by_ticket: bool = False) -> None:
    """One run; repeating it with the same number gives the same tables.

    ``reset`` pulls everything again; known purchases are still stored once. ``by_ticket``
    tells that the lines of a ticket lie together, so that they are not dealt by it again.
    """
    spark = lines.sparkSession
    create_tables(spark, feed)
    start: Mapping[str, int | None] = marks(spark, feed, run_id)
    if reset:
        start = dict.fromkeys(start)
    tables.forget(spark, feed.path("bought"), run_batch(run_id))
    scanned = purchases.after_marks(purchases.scan_pos(lines, feed.lookups.store_rules), start)
    store_batch(scanned, feed, run_batch(run_id), by_ticket)
    refresh_customers(spark, feed, run_id)


def refresh_customers(spark: SparkSession, feed: SalesFeed, run_id: int) -> None:
    """Recompute all summaries, merge them into the last customer table, flag cities."""
    batch = run_batch(run_id)
    deal_by_phone(spark, feed, batch)
    known, plain = bought_by_phone(spark, feed)
    often = F.col("phone").isin(customers.frequent_phones(plain))
    summary = customers.customer_360(known.filter(~often), feed.as_of, feed.limits, apart=plain.filter(often))
    old = tables.newest_version(spark, feed.path("customers"), CUSTOMERS, but=batch)
    merged = enrich.flag_cities(merge.upsert_customers(old, summary), feed.lookups.cities)
    tables.write_version(merged.select(*column_names(CUSTOMERS)), feed.path("customers"), batch)


def deal_by_phone(spark: SparkSession, feed: SalesFeed, batch: str) -> None:
    """Write what a run bought once more, dealt by phone, so that no later roll-up has to shuffle it."""
    bought = tables.of_batch(spark, feed.path("purchases"), PURCHASES, batch).select(*customers.FACT_COLUMNS)
    tables.write_by(customers.by_phone(bought, customers.frequent_phones(bought)), "phone", feed.path("bought"), batch)


def bought_by_phone(spark: SparkSession, feed: SalesFeed) -> tuple[DataFrame, DataFrame]:
    """All purchases, dealt by phone as far as runs did so, and the same rows as plain files."""
    types = dict(part.split(" ", 1) for part in PURCHASES.split(", "))
    schema = ", ".join(f"{name} {types[name]}" for name in customers.FACT_COLUMNS)
    stored = tables.stored_batches(spark, feed.path("purchases"), PURCHASES)
    dealt = [name for name in tables.dealt_batches(spark, "phone", feed.path("bought")) if name in stored]
    known = tables.read_by(spark, "phone", feed.path("bought"), schema, dealt)
    plain = tables.read(spark, feed.path("bought"), schema).filter(F.col("batch").isin(dealt))
    if len(dealt) < len(stored):
        # Batches of a stream, and of a run that died before it dealt its own.
        rest = tables.read(spark, feed.path("purchases"), PURCHASES).filter(~F.col("batch").isin(dealt)).select(*known.columns)
        known, plain = known.unionByName(rest), plain.unionByName(rest)
    return known.drop("batch"), plain.drop("batch")


def stored_customers(spark: SparkSession, feed: SalesFeed) -> DataFrame:
    """The customer table of the last run."""
    return tables.newest_version(spark, feed.path("customers"), CUSTOMERS)


def status(spark: SparkSession, feed: SalesFeed) -> tuple[DataFrame, DataFrame]:
    """Sync states by key, and the eight totals."""
    log = tables.read(spark, feed.path("sync_log"), SYNC_STATE).drop("batch")
    states = merge.sync_state(log).orderBy("sync_key")
    bought = tables.read(spark, feed.path("purchases"), PURCHASES)
    return states, enrich.sync_totals(bought, stored_customers(spark, feed))


def customer_list(
    stored: DataFrame, contacts: DataFrame, feed: SalesFeed, limit: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Top customers enriched, statistics of the whole table, agent counts of the list."""
    top = enrich.top_customers(stored, limit)
    listed = enrich.enrich_customers(top, enrich.listed_contacts(contacts, top), feed.lookups)
    return listed, enrich.customer_stats(stored), enrich.agent_counts(listed, feed.lookups)
