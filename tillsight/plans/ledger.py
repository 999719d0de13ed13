"""Sales ledger: full scans of the source, of which only changed tickets are worked on.

The sync by high-water mark never sees a ticket again. Here a run compares the digests
of what it scans with those it stored, keeps the lines of added and changed tickets as
their new version, and books the difference on the customers: old lines off, new lines
on. Nothing is recomputed that did not change.

A run owns one folder per table, named by its number, and replaces it if it is repeated;
its folders are not read by itself. ``scope`` bounds a run to a part of the tickets
(say, those of the last month): what lies outside is neither compared nor gone.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, customers, purchases
from ..operators.keep import keep_last
from ..params import Lookups, Thresholds
from ..schemas import POS_LINES, SUMMARY, column_names
from ..session import dealt_by_first_key
from ..streaming import tables

TICKETS = f"{changes.DIGESTS}, change string, version bigint"
LINES = f"{POS_LINES}, version bigint"
CUSTOMERS = f"{SUMMARY}, here boolean, version bigint"


@dataclass(frozen=True)
class Ledger:
    root: str
    lookups: Lookups
    limits: Thresholds
    as_of: dt.date

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"


def create(spark: SparkSession, ledger: Ledger) -> None:
    for name, schema in (("tickets", TICKETS), ("lines", LINES), ("facts", changes.FACTS), ("customers", CUSTOMERS)):
        tables.create(spark, ledger.path(name), schema)


def run_batch(run_id: int) -> str:
    return tables.batch_name("run", run_id)


def _before(spark: SparkSession, root: str, key: str, schema: str, batch: str, own: bool = False) -> DataFrame:
    """What runs before this one (and its own) wrote, as they dealt it."""
    earlier = [name for name in tables.stored_batches(spark, root, schema) if name < batch or own and name == batch]
    return tables.read_by(spark, key, root, schema, earlier)


def tickets_before(spark: SparkSession, ledger: Ledger, run_id: int) -> DataFrame:
    """The newest digest of every ticket that runs before this one left in place, with its version."""
    stored = _before(spark, ledger.path("tickets"), "ticket_id", TICKETS, run_batch(run_id))
    return keep_last(stored, changes.TICKET_KEY, ["version"]).filter("n > 0").drop("batch", "change")


def sync(lines: DataFrame, ledger: Ledger, run_id: int, scope: Column | None = None, by_ticket: bool = False) -> None:
    """Compare a scan with the ledger and book what differs; runs are numbered from 1 upwards.

    The lines lie dealt by ticket; ``by_ticket`` tells that they come so and need no shuffle for it.
    """
    create(lines.sparkSession, ledger)
    with dealt_by_first_key(lines.sparkSession):
        _sync(lines if by_ticket else lines.repartition("ticket_id"), ledger, run_id, scope)


def _sync(lines: DataFrame, ledger: Ledger, run_id: int, scope: Column | None) -> None:
    spark = lines.sparkSession
    batch, version = run_batch(run_id), F.lit(run_id).cast("bigint")
    inside = F.lit(True) if scope is None else scope
    scanned = purchases.scan_pos(lines, ledger.lookups.store_rules).filter(inside).select(*column_names(POS_LINES))
    # The source is read once; every branch sees the same rows.
    scanned = tables.landed_by(scanned, "ticket_id", ledger.path("scans"), batch)
    before = tickets_before(spark, ledger, run_id).filter(inside)
    found = changes.ticket_changes(before, changes.ticket_digests(scanned)).withColumn("version", version)
    found = tables.landed_by(found, "ticket_id", ledger.path("tickets"), batch)

    come = changes.of_tickets(scanned, found.filter(F.col("change") != changes.GONE))
    come = tables.landed_by(come.withColumn("version", version), "ticket_id", ledger.path("lines"), batch)
    # Only the version of a changed ticket that was current is taken off.
    old = before.join(found.filter(F.col("change") != changes.ADDED).select(*changes.TICKET_KEY), list(changes.TICKET_KEY), "left_semi")
    stored = _before(spark, ledger.path("lines"), "ticket_id", LINES, batch).drop("batch")
    gone = stored.join(old.select(*changes.TICKET_KEY, "version"), [*changes.TICKET_KEY, "version"], "left_semi")

    signed = changes.signed_purchases(gone, come, ledger.lookups, ledger.limits)
    often = customers.frequent_phones(changes.phones_of(come).unionByName(changes.phones_of(gone)))
    booked = tables.landed_by(changes.signed_facts(signed, often), "phone", ledger.path("facts"), batch)
    touched = booked.select("phone").distinct()
    facts = _before(spark, ledger.path("facts"), "phone", changes.FACTS, batch, own=True)
    plain = tables.read(spark, ledger.path("facts"), changes.FACTS).filter(F.col("batch") <= batch)
    # A phone with too many facts for one task is added up by many, from files as they come.
    often = F.col("phone").isin(customers.frequent_phones(plain))
    told = changes.summaries(facts.filter(~often).join(touched, "phone", "left_semi"), ledger.as_of, ledger.limits)
    told = told.unionByName(changes.summaries(plain.filter(often).join(touched, "phone", "left_semi"), ledger.as_of, ledger.limits))
    rows = touched.join(told.withColumn("here", F.lit(True)), "phone", "left").withColumns(
        {"here": F.coalesce("here", F.lit(False)), "version": version}
    )
    tables.write(rows.select(*column_names(CUSTOMERS)), ledger.path("customers"), batch)


def current_lines(spark: SparkSession, ledger: Ledger) -> DataFrame:
    """The lines of the newest version of every ticket."""
    stored = tables.read(spark, ledger.path("tickets"), TICKETS)
    newest = keep_last(stored, changes.TICKET_KEY, ["version"]).filter("n > 0").select(*changes.TICKET_KEY, "version")
    lines = tables.read(spark, ledger.path("lines"), LINES).drop("batch")
    return lines.join(newest, [*changes.TICKET_KEY, "version"], "left_semi").drop("version")


def ticket_log(spark: SparkSession, ledger: Ledger) -> DataFrame:
    """What every run found: store, ticket, what happened, lines left, run."""
    log = tables.read(spark, ledger.path("tickets"), TICKETS)
    return log.select(*changes.TICKET_KEY, "change", "n", F.col("version").alias("run_id"))


def current_customers(spark: SparkSession, ledger: Ledger) -> DataFrame:
    """The newest summary of every phone that still has a purchase; dates follow ``as_of``."""
    stored = tables.read(spark, ledger.path("customers"), CUSTOMERS)
    latest = keep_last(stored, ["phone"], ["version"]).filter("here").drop("batch", "version", "here")
    return customers.with_derived(latest, ledger.as_of, ledger.limits)
