"""Roll purchases up into one row per phone."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.times import instant
from ..params import ONLINE, WALKIN, Thresholds

# Money sums are wider than a line amount: one placeholder phone can own a
# large share of all lines, and its sum must not overflow.
MONEY = "decimal(28,2)"

# Line amounts are added up per ticket in hundredths: whole numbers, which take far less
# time and room than wide decimals. The sums per phone are MONEY.
HUNDREDTHS = "CAST(line_total * 100 AS BIGINT)"

# Kinds of facts a purchase line gives about its phone.
TICKET, LABEL, CATEGORY, PRODUCT, STORE, SELLER, PAYMENT, LEAD = range(8)

# Value of each favourite, and its output column. Only online lines name a seller.
FAVORITES = {
    CATEGORY: ("category", "favorite_category"),
    PRODUCT: ("nullif(product_code, '')", "favorite_product"),
    STORE: ("store_code", "favorite_store"),
    SELLER: (f"CASE WHEN sales_channel = '{ONLINE}' THEN nullif(seller, '') END", "favorite_seller"),
    PAYMENT: ("nullif(payment_method, '')", "favorite_payment"),
    LEAD: ("nullif(lead_source, '')", "top_lead_source"),
}


def _favorite_facts() -> list[str]:
    """(kind, value, extra, amount, channel, day) rows of a line, as expressions."""
    agents = {SELLER: "agent_name"}
    return [
        f"{kind}Y, {value}, {agents.get(kind, 'NULL')}, NULL, NULL, NULL"
        for kind, (value, _) in FAVORITES.items()
    ]


def _base_facts(ticket_per_store: bool) -> list[str]:
    """The ticket carries the measures of the line; the label is name and city."""
    store = "store_code" if ticket_per_store else "NULL"
    return [
        f"{TICKET}Y, ticket_id, {store}, {HUNDREDTHS}, sales_channel, purchase_date",
        f"{LABEL}Y, raw_customer_name, raw_city, NULL, NULL, NULL",
    ]


#: What of a purchase its facts are made of; what is equal for a whole ticket comes first, so rows compress well.
FACT_COLUMNS = (
    "phone", "ticket_id", "purchase_date", "raw_customer_name", "raw_city", "seller", "agent_name", "sales_channel", "lead_source",
    "store_code", "payment_method", "category", "product_code", "line_total",
)


def _count_facts(purchases: DataFrame, facts: list[str]) -> DataFrame:
    """Number of lines and amounts per phone, kind and value, from one pass.

    Each line is unfolded into narrow (kind, value) rows which are combined
    before the shuffle. The grouping is by value, not by phone, so the lines of
    a phone that owns a large share of the table spread over all tasks, and all
    buffers are fixed width (hash aggregation). A ticket keeps flags for both
    channels because a mixed ticket counts in both.
    """
    unfolded = (
        purchases.filter("phone <> ''")
        .selectExpr(
            "phone",
            f"stack({len(facts)}, {', '.join(facts)}) AS (kind, value, extra, amount, channel, day)",
        )
        .filter(f"kind IN ({TICKET}, {LABEL}) OR value IS NOT NULL")
    )
    measures = f"""
        count(1) AS lines,
        sum(amount) AS amount,
        sum(CASE WHEN channel = '{ONLINE}' THEN amount END) AS online_amount,
        sum(CASE WHEN channel = '{WALKIN}' THEN amount END) AS walkin_amount,
        max(channel = '{ONLINE}') AS has_online,
        max(channel = '{WALKIN}') AS has_walkin,
        min(day) AS first_day,
        max(day) AS last_day"""
    counted = unfolded.groupBy("phone", "kind", "value", "extra").agg(*_expressions(measures))
    amounts = ("amount", "online_amount", "walkin_amount")
    return counted.withColumns({name: F.expr(f"CAST({name} AS DECIMAL(20,0)) * 0.01BD") for name in amounts})


def _expressions(columns: str) -> list[Column]:
    """Columns from SQL text, one per line."""
    return [F.expr(line.strip().rstrip(",")) for line in columns.strip().splitlines()]


def _favorite_columns() -> list[Column]:
    """Most frequent value of each kind per phone; the lowest value wins a tie."""

    def top(kind: int) -> str:
        return f"min(CASE WHEN kind = {kind} THEN struct(-lines AS rank, value, extra) END)"

    columns = [f"{top(kind)}.value AS {name}" for kind, (_, name) in FAVORITES.items()]
    return _expressions("\n".join([*columns, f"{top(SELLER)}.extra AS favorite_agent"]))


def _base_columns() -> list[Column]:
    counted = f"kind = {TICKET} AND value IS NOT NULL"
    return _expressions(f"""
        max(CASE WHEN kind = {LABEL} THEN value END) AS name
        max(CASE WHEN kind = {LABEL} THEN extra END) AS city
        count_if({counted}) AS total_orders
        CAST(sum(amount) AS {MONEY}) AS total_lifetime
        count_if({counted} AND has_online) AS total_online_orders
        CAST(coalesce(sum(online_amount), 0) AS {MONEY}) AS total_online
        count_if({counted} AND has_walkin) AS total_walkin_orders
        CAST(coalesce(sum(walkin_amount), 0) AS {MONEY}) AS total_walkin
        min(first_day) AS first_purchase_date
        max(last_day) AS last_purchase_date""")


def summary_columns() -> list[Column]:
    """What a summary takes from facts, before the columns that depend on a date."""
    return [*_base_columns(), *_favorite_columns()]


def with_derived(base: DataFrame, as_of: dt.date, limits: Thresholds) -> DataFrame:
    days = rules.days_since(as_of, F.col("last_purchase_date"))
    return base.withColumns(
        {
            "days_since_last_purchase": days,
            "buyer_tier": rules.buyer_tier(F.col("total_lifetime"), F.col("total_orders"), limits),
            "is_lapsed": days > limits.lapsed_days,
            "last_synced_at": instant(dt.datetime.combine(as_of, dt.time())),
        }
    )


def customer_base(
    purchases: DataFrame, as_of: dt.date, limits: Thresholds, ticket_per_store: bool = False
) -> DataFrame:
    """Totals, dates, tier and lapsed flag per phone, without favourites."""
    facts = _count_facts(purchases, _base_facts(ticket_per_store))
    return with_derived(facts.groupBy("phone").agg(*_base_columns()), as_of, limits)


def favorites(purchases: DataFrame) -> DataFrame:
    """The most frequent value of each attribute per phone that has one."""
    return _count_facts(purchases, _favorite_facts()).groupBy("phone").agg(*_favorite_columns())


#: Share of all rows from which a phone's rows are too many for one task.
FREQUENT = 0.01


def frequent_phones(rows: DataFrame) -> list[str]:
    """Every phone with at least a hundredth of the rows, and maybe some others: about a hundred at most.

    One pass without a shuffle; for rows of a written table.
    """
    row = rows.filter("phone <> ''").select("phone").stat.freqItems(["phone"], FREQUENT).first()
    return sorted(row["phone_freqItems"])


def by_phone(rows: DataFrame, frequent: Sequence[str]) -> DataFrame:
    """Rows dealt by phone, but those of frequent phones, which stay where they are."""
    often = F.col("phone").isin(list(frequent))
    return rows.filter(~often).repartition("phone").unionByName(rows.filter(often))


def customer_360(
    purchases: DataFrame,
    as_of: dt.date,
    limits: Thresholds,
    ticket_per_store: bool = False,
    apart: DataFrame | None = None,
) -> DataFrame:
    """Totals, favourites, tier and lapsed flag from one scan of the purchases.

    Orders are distinct ticket numbers; ``ticket_per_store`` tells apart equal
    numbers of different stores. If the purchases are dealt by phone, those of the
    ``frequent_phones`` come ``apart`` and not dealt, so that many tasks count them.
    """
    facts = _base_facts(ticket_per_store) + _favorite_facts()

    def rolled(lines: DataFrame) -> DataFrame:
        return _count_facts(lines, facts).groupBy("phone").agg(*summary_columns())

    summary = rolled(purchases) if apart is None else rolled(purchases).unionByName(rolled(apart))
    return with_derived(summary, as_of, limits)


def customer_names(purchases: DataFrame) -> DataFrame:
    """Display name per phone."""
    return purchases.groupBy("phone").agg(F.max("raw_customer_name").alias("name"))


FACTS = (
    "phone string, kind tinyint, value string, extra string, lines bigint, amount decimal(38,2), "
    "online_amount decimal(38,2), walkin_amount decimal(38,2), has_online boolean, has_walkin boolean, "
    "first_day date, last_day date"
)


def facts_of(purchases: DataFrame) -> DataFrame:
    """What purchases add to their customers, in a form that adds up exactly.

    One row per phone, kind and value: counts, sums, flags, first and last day.
    """
    facts = _count_facts(purchases, _base_facts(False) + _favorite_facts())
    types = dict(part.split(" ", 1) for part in FACTS.split(", "))
    return facts.select(*[F.col(name).cast(kind).alias(name) for name, kind in types.items()])


def folded(facts: DataFrame) -> DataFrame:
    """Facts of several batches as one."""
    sums = [F.sum(c).cast("decimal(38,2)").alias(c) for c in ("amount", "online_amount", "walkin_amount")]
    return facts.groupBy("phone", "kind", "value", "extra").agg(
        F.sum("lines").alias("lines"), *sums, F.max("has_online").alias("has_online"),
        F.max("has_walkin").alias("has_walkin"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"),
    )


def customers_from_facts(facts: DataFrame, as_of: dt.date, limits: Thresholds) -> DataFrame:
    """The summary of all phones that have facts."""
    return with_derived(folded(facts).groupBy("phone").agg(*summary_columns()), as_of, limits)
