"""Upserts as joins: a new version of a table from the old one and a batch."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(
    old: DataFrame,
    new: DataFrame,
    key: str,
    *,
    overwrite: Sequence[str],
    fill: Sequence[str] = (),
    keep: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Merge ``new`` into ``old`` on a key that is unique on both sides.

    overwrite  takes the new value when the key is in the batch
    fill       takes the new value unless it is NULL
    keep       stays as it is; the mapped expression is the value of a first insert

    Rows are never deleted.
    """
    left = old.withColumn("_in_old", F.lit(True)).alias("old")
    right = new.withColumn("_in_new", F.lit(True)).alias("new")
    joined = left.join(right, key, "full_outer")
    in_old, in_new = F.col("_in_old").isNotNull(), F.col("_in_new").isNotNull()
    columns = [F.col(key)]
    columns += [F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c) for c in fill]
    columns += [F.when(in_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in overwrite]
    columns += [
        F.when(in_old, F.col(f"old.{c}")).otherwise(first).alias(c) for c, first in (keep or {}).items()
    ]
    return joined.select(*columns)


# Columns of the customer table that a recomputed summary fills or overwrites.
CUSTOMER_FILL = ("name", "city")
CUSTOMER_OVERWRITE = (
    "total_orders", "total_lifetime",
    "total_online_orders", "total_online", "total_walkin_orders", "total_walkin",
    "first_purchase_date", "last_purchase_date", "days_since_last_purchase",
    "favorite_category", "favorite_product", "favorite_store",
    "favorite_seller", "favorite_agent", "favorite_payment", "top_lead_source",
    "buyer_tier", "is_lapsed", "last_synced_at",
)


def upsert_customers(old: DataFrame, summary: DataFrame) -> DataFrame:
    """Refresh the customer table from a recomputed summary.

    State, city flags and creation time belong to the table, not the summary.
    """
    return upsert(
        old, summary, "phone",
        overwrite=CUSTOMER_OVERWRITE,
        fill=CUSTOMER_FILL,
        keep={
            "state": F.lit(None).cast("string"),
            "is_priority_city": F.lit(False),
            "city_priority_score": F.lit(None).cast("int"),
            "created_at": F.col("new.last_synced_at"),
        },
    )


def sync_state(runs: DataFrame) -> DataFrame:
    """One row per feed from its runs: row counts add up, the latest run gives the rest.

    Runs at the same instant are ordered by cursor. A stored state is a run like
    any other, so ``sync_state(state.unionByName(runs))`` merges new runs into it.
    """
    latest = F.struct(
        "last_run_at", F.col("last_cursor").try_cast("decimal(38,0)").alias("ticket"), "last_cursor",
        "status", "error_message",
    )
    merged = runs.groupBy("sync_key").agg(
        F.max(latest).alias("last"), F.sum("rows_synced").alias("rows_synced")
    )
    return merged.select(
        "sync_key", "last.last_run_at", "last.last_cursor", "rows_synced", "last.status", "last.error_message"
    )
