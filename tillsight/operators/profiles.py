"""Customer profiles for all phones: recent purchases, ticket totals, order metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .customers import MONEY

RECENT_COLUMNS = (
    "purchase_date", "store_code", "seller", "agent_name", "ticket_id", "product_code",
    "product_name", "category", "qty", "unit_price", "line_total", "payment_method",
)


def recent_purchases(purchases: DataFrame, count: int = 5) -> DataFrame:
    """The last lines of each phone, newest first; an unknown date sorts first.

    Lines of one ticket are ordered by store and product code.
    """
    order = Window.partitionBy("phone").orderBy(
        F.col("purchase_date").desc_nulls_first(), F.col("ticket_id").desc(), "store_code", "product_code"
    )
    return (
        purchases.select("phone", *RECENT_COLUMNS)
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= count)
    )


def ticket_totals(purchases: DataFrame) -> DataFrame:
    """Amount and dates of each ticket of each phone."""
    return purchases.groupBy("phone", "ticket_id").agg(
        F.sum("line_total").cast(MONEY).alias("ticket_total"),
        F.min("purchase_date").alias("first_date"),
        F.max("purchase_date").alias("last_date"),
    )


def with_order_metrics(customers: DataFrame) -> DataFrame:
    """Add the average order amount and the average days between orders.

    Both are NULL without orders; the gap also needs two orders and both dates.
    """
    orders = F.col("total_orders")
    span = F.datediff("last_purchase_date", "first_purchase_date")
    return customers.withColumns(
        {
            "avg_order": F.when(orders > 0, F.col("total_lifetime").cast("double") / orders),
            "avg_days_between_orders": F.when(
                orders > 1, F.floor(span / (orders - 1) + F.lit(0.5))
            ),
        }
    )


def order_metrics(customers: DataFrame) -> DataFrame:
    return with_order_metrics(customers).select("phone", "avg_order", "avg_days_between_orders")


def customer_profile(
    customers: DataFrame, purchases: DataFrame, phone: str | None = None, count: int = 5
) -> DataFrame:
    """Customer row, metrics and the last purchases as an array, per phone.

    With ``phone`` only that customer is read; the filter reaches both scans.
    """
    if phone is not None:
        wanted = F.col("phone") == text.normalize_phone(F.lit(phone))
        customers, purchases = customers.filter(wanted), purchases.filter(wanted)
    recent = (
        recent_purchases(purchases, count)
        .groupBy("phone")
        .agg(F.array_sort(F.collect_list(F.struct("position", *RECENT_COLUMNS))).alias("recent_purchases"))
    )
    return with_order_metrics(customers).join(recent, "phone", "left")
