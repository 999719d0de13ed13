"""Business rules as column expressions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import (
    ALWAYS_ONLINE,
    NAME_REQUIRED,
    ONLINE,
    ONLINE_BEFORE_CUTOFF,
    TICKET_ONLY,
    WALKIN,
    PriorityCity,
    Thresholds,
)


def store_filter(store_rules: Sequence[tuple[str, str]]) -> Column:
    """Lines to take from each store; stores without a rule give nothing.

    The store list is implied by the rules, but stated on its own it reaches the
    scan (row groups, partitions or the WHERE clause of a database).
    """
    tests = {
        NAME_REQUIRED: F.trim(F.col("customer_name")) != "",
        TICKET_ONLY: F.upper(F.trim(F.col("movement"))) == "TK",
    }
    per_store = [(F.col("store_code") == store) & tests[rule] for store, rule in store_rules]
    tracked = F.col("store_code").isin([store for store, _ in store_rules])
    return tracked & reduce(lambda a, b: a | b, per_store, F.lit(False))


def phone_present(phone: Column) -> Column:
    return phone.isNotNull() & (F.trim(phone) != "")


def sales_channel(channel_rule: Column, purchase_date: Column, cutoff: dt.date) -> Column:
    """Online for always-online sellers, and for the cutoff seller before the cutoff.

    An unknown date of the cutoff seller counts as walk-in.
    """
    return (
        F.when(channel_rule == ALWAYS_ONLINE, F.lit(ONLINE))
        .when((channel_rule == ONLINE_BEFORE_CUTOFF) & (purchase_date < F.lit(cutoff)), F.lit(ONLINE))
        .otherwise(F.lit(WALKIN))
    )


def buyer_tier(lifetime: Column, orders: Column, limits: Thresholds) -> Column:
    return (
        F.when((lifetime >= limits.vip_lifetime) | (orders >= limits.vip_orders), F.lit("VIP"))
        .when(lifetime >= limits.regular_lifetime, F.lit("Regular"))
        .otherwise(F.lit("Casual"))
    )


def days_since(as_of: dt.date, last: Column) -> Column:
    return F.datediff(F.lit(as_of), last)


def priority_city(city: Column, cities: Sequence[PriorityCity]) -> Column:
    """State and priority of a normalised city name, NULL when it is not listed.

    An exact name wins; otherwise the first entry contained in the name. The
    list is a parameter, so this is a chain of tests inside one projection and
    needs neither a join nor a shuffle.
    """
    found = F.lit(None).cast("struct<state:string,priority:int>")

    def entry(item: PriorityCity) -> Column:
        return F.struct(
            F.lit(item.state).alias("state"), F.lit(item.priority).cast("int").alias("priority")
        )

    exact = [F.when(city == item.key, entry(item)) for item in cities]
    partial = [F.when(F.contains(city, F.lit(item.key)), entry(item)) for item in cities]
    return F.coalesce(*exact, *partial, found)
