"""Who bought a style, how many pieces, how much money."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .customers import MONEY


def _buyers(lines: DataFrame, customers: DataFrame, group: Sequence[str]) -> DataFrame:
    """Buyer rows per group and phone.

    Lines are first combined per ticket, which makes the distinct ticket count
    a plain count, and names are joined after the aggregation.
    """
    per_ticket = lines.groupBy(*group, "phone", "ticket_id").agg(
        F.sum("qty").alias("qty"),
        F.sum("line_total").alias("line_total"),
        F.min("purchase_date").alias("first_buy"),
        F.max("purchase_date").alias("last_buy"),
        F.max("raw_customer_name").alias("raw_name"),
        F.max("agent_name").alias("agent_name"),
    )
    buyers = per_ticket.groupBy(*group, "phone").agg(
        F.max("raw_name").alias("raw_name"),
        F.max("agent_name").alias("agent_name"),
        F.sum("qty").alias("pieces"),
        F.count("ticket_id").alias("tickets"),
        F.sum("line_total").cast(MONEY).alias("amount"),
        F.min("first_buy").alias("first_buy"),
        F.max("last_buy").alias("last_buy"),
    )
    named = buyers.join(customers.select("phone", "name"), "phone", "left")
    return named.select(
        *group,
        "phone",
        text.first_non_empty(F.col("name"), F.col("raw_name")).alias("name"),
        text.first_non_empty(F.col("agent_name")).alias("agent"),
        "pieces", "tickets", "amount", "first_buy", "last_buy",
    )


def style_buyers(purchases: DataFrame, customers: DataFrame, style: str) -> DataFrame:
    """Buyers of one style and its variants, most pieces first."""
    wanted = text.clean_style(F.lit(style))
    lines = purchases.filter(text.matches_style(F.col("product_code"), wanted))
    return _buyers(lines, customers, ()).orderBy(
        F.col("pieces").desc(), F.col("amount").desc(), "phone"
    )


def buyers_by_style(purchases: DataFrame, customers: DataFrame) -> DataFrame:
    """Buyers of every base style (the code before the first '-') in one pass."""
    lines = purchases.withColumn("style", F.substring_index("product_code", "-", 1))
    return _buyers(lines.filter(F.col("style") != ""), customers, ("style",))


def style_totals(buyers: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Sums over buyer rows; a ticket shared by two phones counts for both."""

    def total(name: str, kind: str):
        return F.coalesce(F.sum(name), F.lit(0)).cast(kind).alias(name)

    return buyers.groupBy(*group).agg(
        F.count(F.lit(1)).alias("customers"),
        total("pieces", "bigint"),
        total("tickets", "bigint"),
        total("amount", MONEY),
    )
