"""Which tickets differ between two scans, and what that means for their customers.

A ticket has a digest that does not depend on the order of its lines: their number and
two sums of 64-bit hashes. Digests of two scans meet in one join by ticket, 40 bytes
each, and tell added, changed and gone tickets; lines are read for those only.

Facts about customers are signed: the lines of a ticket's old version are taken off and
those of its new one added. Everything a summary needs is a count or a sum by value
(days too, so that the first and the last one can go back), so facts of any number of
batches add up to what the current tickets give, and a value whose lines are all gone is
gone.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..params import ONLINE, WALKIN, Lookups, Thresholds
from . import customers, purchases

TICKET_KEY = ("store_code", "ticket_id")
DIGESTS = "store_code string, ticket_id string, n bigint, d1 decimal(38,0), d2 decimal(38,0)"
ADDED, CHANGED, GONE = "added", "changed", "gone"
#: One more kind of fact beside those of ``customers``: a day on which something was bought.
DAY = 8
#: Tasks that share the lines of a phone that has too many for one.
SLICES = 64
FACTS = (
    "phone string, kind tinyint, value string, extra string, lines bigint, online_lines bigint, walkin_lines bigint, "
    "amount decimal(38,2), online_amount decimal(38,2), walkin_amount decimal(38,2)"
)


def ticket_digests(lines: DataFrame) -> DataFrame:
    """One row per ticket with a number; any difference in any column of a line shows.

    Tasks add up before the shuffle, so a ticket with many lines is no hot key.
    """
    columns = sorted(c for c in lines.columns)
    # A missing value is not an empty one: the hash skips nulls, so their places are hashed too.
    nulls = F.concat(*[F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.lit("1")) for c in columns])

    def total(*salt: Column) -> Column:
        return F.sum(F.xxhash64(*salt, nulls, *[F.col(c) for c in columns]).cast("decimal(38,0)"))

    numbered = lines.filter(purchases.ticket_number(F.col("ticket_id")).isNotNull())
    return numbered.groupBy(*TICKET_KEY).agg(
        F.count(F.lit(1)).alias("n"), total().cast("decimal(38,0)").alias("d1"), total(F.lit("second")).cast("decimal(38,0)").alias("d2")
    )


def ticket_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The tickets of two tables of digests that differ: what happened, and the new digest (0 lines if gone)."""
    before = old.select(*TICKET_KEY, *[F.col(c).alias(f"old_{c}") for c in ("n", "d1", "d2")])
    both = before.join(new.select(*TICKET_KEY, "n", "d1", "d2"), list(TICKET_KEY), "full_outer")
    same = (F.col("n") == F.col("old_n")) & (F.col("d1") == F.col("old_d1")) & (F.col("d2") == F.col("old_d2"))
    change = F.when(F.col("old_n").isNull(), ADDED).when(F.col("n").isNull(), GONE).when(~same, CHANGED)
    told = both.withColumn("change", change).filter(F.col("change").isNotNull())
    return told.select(*TICKET_KEY, "change", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "d1", "d2")


def of_tickets(lines: DataFrame, tickets: DataFrame) -> DataFrame:
    """The lines of some tickets."""
    return lines.join(tickets.select(*TICKET_KEY), list(TICKET_KEY), "left_semi")


def signed_purchases(gone: DataFrame, come: DataFrame, lookups: Lookups, limits: Thresholds) -> DataFrame:
    """Purchases of whole tickets with ``sign``: -1 for old lines, 1 for new ones.

    The purchase key holds the ticket, so a ticket's purchases follow from its own lines.
    """

    def bought(lines: DataFrame, sign: int) -> DataFrame:
        fit = purchases.accepted(purchases.clean_lines(lines, lookups, limits, numbered=True))
        return purchases.dedup_purchases(fit).withColumn("sign", F.lit(sign))

    return bought(gone, -1).unionByName(bought(come, 1))


def phones_of(lines: DataFrame) -> DataFrame:
    """The phones of ticket lines, as their purchases have them."""
    return lines.select(text.normalize_phone(F.col("phone_raw")).alias("phone"))


def signed_facts(signed: DataFrame, frequent: Sequence[str] | None = None) -> DataFrame:
    """Counts and sums per phone, kind and value, those of old lines taken off; what cancels out is left away.

    If the ``frequent`` phones are known, the lines are dealt by phone before they are counted,
    which is less than their facts. Those of a frequent phone go to many tasks by ticket, and
    its facts come in parts, which add up like those of several batches.
    """
    parts: list[str] = []
    if frequent is not None:
        slices = F.concat_ws("#", "phone", F.pmod(F.xxhash64("ticket_id"), F.lit(SLICES)))
        dealt = F.when(F.col("phone").isin(list(frequent)), slices).otherwise(F.col("phone"))
        signed, parts = signed.select(*customers.FACT_COLUMNS, "sign").withColumn("dealt", dealt).repartition("dealt"), ["dealt"]
    facts = [
        f"{customers.TICKET}Y, ticket_id, CAST(NULL AS STRING), line_total, sales_channel",
        f"{customers.LABEL}Y, raw_customer_name, raw_city, NULL, NULL",
        f"{DAY}Y, CAST(purchase_date AS STRING), NULL, NULL, NULL",
        *[
            f"{kind}Y, {value}, {'agent_name' if kind == customers.SELLER else 'NULL'}, NULL, NULL"
            for kind, (value, _) in customers.FAVORITES.items()
        ],
    ]
    unfolded = (
        signed.filter("phone <> ''")
        .selectExpr(*parts, "phone", "sign", f"stack({len(facts)}, {', '.join(facts)}) AS (kind, value, extra, amount, channel)")
        .filter(f"kind IN ({customers.TICKET}, {customers.LABEL}) OR value IS NOT NULL")
    )

    def when(channel: str, what: str) -> str:
        return f"sum(CASE WHEN channel = '{channel}' THEN {what} ELSE 0 END)"

    measures = {
        "lines": "sum(sign)",
        "online_lines": when(ONLINE, "sign"),
        "walkin_lines": when(WALKIN, "sign"),
        "amount": "sum(sign * amount)",
        "online_amount": when(ONLINE, "sign * amount"),
        "walkin_amount": when(WALKIN, "sign * amount"),
    }
    types = dict(part.split(" ", 1) for part in FACTS.split(", "))
    summed = unfolded.groupBy(*parts, "phone", "kind", "value", "extra").agg(*[F.expr(sql).alias(c) for c, sql in measures.items()])
    typed = summed.select(*[F.col(name).cast(kind).alias(name) for name, kind in types.items()])
    return typed.filter(" OR ".join(f"coalesce({c}, 0) <> 0" for c in measures))


def folded(facts: DataFrame) -> DataFrame:
    """Facts of several batches as one; a value without lines is gone."""
    sums = ["lines", "online_lines", "walkin_lines", "amount", "online_amount", "walkin_amount"]
    types = dict(part.split(" ", 1) for part in FACTS.split(", "))
    once = facts.groupBy("phone", "kind", "value", "extra").agg(*[F.sum(c).cast(types[c]).alias(c) for c in sums])
    return once.filter("lines > 0")


def summaries(facts: DataFrame, as_of: dt.date, limits: Thresholds) -> DataFrame:
    """The customers that current facts describe; a phone without any is not there."""
    day = F.when(F.col("kind") == DAY, F.col("value").cast("date"))
    told = folded(facts).withColumns(
        {"has_online": F.col("online_lines") > 0, "has_walkin": F.col("walkin_lines") > 0, "first_day": day, "last_day": day}
    )
    return customers.with_derived(told.groupBy("phone").agg(*customers.summary_columns()), as_of, limits)
