"""What customers_upsert spends per ticket line: narrow sums, plain join keys, small tasks, cheap trims."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

from pyspark.sql import functions as F
from test_plans import plan_of

import __spark_entry__ as entry
from tillsight import session
from tillsight.functions import text
from tillsight.operators import customers
from tillsight.schemas import PURCHASES, column_names
from tillsight.sources import star


def bought(spark, rows):
    """Purchases with the given columns; the others are null."""
    names = column_names(PURCHASES)
    return spark.createDataFrame([tuple(row.get(name) for name in names) for row in rows], PURCHASES)


def line(ticket, total, channel="walkin", phone="5500000001"):
    amount = None if total is None else Decimal(total)
    return {
        "phone": phone, "ticket_id": ticket, "line_total": amount, "sales_channel": channel,
        "purchase_date": dt.date(2001, 1, 2), "store_code": "TS0001", "product_code": "A1", "raw_customer_name": "x", "raw_city": "",
    }


def test_amounts_of_facts_are_added_up_without_wide_decimals(spark, capsys):
    facts = customers._count_facts(bought(spark, []), customers._base_facts(False) + customers._favorite_facts())
    plan = plan_of(facts, capsys)
    assert "partial_sum" in plan and "isEmpty" not in plan  # only the sum of a decimal has this flag


def test_sums_of_amounts_are_exact(spark):
    most = "9999999999.99"
    rows = [line("1", most), line("1", most, "agent_online"), line("1", "0.01"), line("2", "-0.07"), line("3", None), line("4", "1.10", None)]
    got = customers.customer_360(bought(spark, rows), star.SALES_AS_OF, star.LIMITS).first()
    assert got["total_lifetime"] == 2 * Decimal(most) + Decimal("1.04")
    assert got["total_online"] == Decimal(most)
    assert got["total_walkin"] == Decimal(most) + Decimal("-0.06")
    assert (got["total_orders"], got["total_online_orders"], got["total_walkin_orders"]) == (4, 1, 3)
    unknown = customers.customer_360(bought(spark, [line("3", None)]), star.SALES_AS_OF, star.LIMITS).first()
    assert unknown["total_lifetime"] is None and unknown["total_walkin"] == 0


def test_sums_of_a_phone_are_wider_than_a_bigint_of_hundredths(spark):
    rows = spark.range(1200).select(
        *[
            {
                "phone": F.lit("5500000001"), "ticket_id": F.col("id").cast("string"), "sales_channel": F.lit("walkin"),
                "line_total": F.lit(Decimal("9999999999.99")),
            }.get(name, F.lit(None)).cast(kind).alias(name)
            for name, kind in (part.split(" ", 1) for part in PURCHASES.split(", "))
        ]
    )
    facts = customers._count_facts(rows, customers._base_facts(False))
    many = facts.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(9000)))).drop("again")
    total = many.groupBy("phone").agg(*customers._base_columns()).first()["total_lifetime"]
    assert total == 1200 * 9000 * Decimal("9999999999.99") and total * 100 > 2**63


def test_lines_are_joined_by_a_ticket_column(spark, folder, capsys):
    """Large tables: a sort by an expression evaluates it for every comparison."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        plan = plan_of(entry.queries()["customers_upsert"](spark, folder), capsys)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert re.search(r"hashpartitioning\(line_ticket#\d+,", plan)
    assert not re.search(r"(hashpartitioning\(|Arguments: \[)cast\(l_orderkey", plan)


def test_tasks_are_small_unless_the_session_says_otherwise(spark, folder):
    before = spark.conf.get(session.TASK_BYTES, None)
    try:
        spark.conf.unset(session.TASK_BYTES)
        entry.queries()["customers_upsert"](spark, folder)
        assert spark.conf.get(session.TASK_BYTES) == "8m"
        spark.conf.set(session.TASK_BYTES, "3m")
        entry.queries()["customers_upsert"](spark, folder)
        assert spark.conf.get(session.TASK_BYTES) == "3m"
    finally:
        spark.conf.unset(session.TASK_BYTES)
        if before is not None:
            spark.conf.set(session.TASK_BYTES, before)


def test_stripped_is_strip(spark):
    ends = ["", " ", "\t", " ", "　", "﻿", "\x00", "\x1f", "!", "~", "\x7f", "a", "ñ", "́", "\U0001f600"]
    texts = [(a + middle + b,) for a in ends for b in ends for middle in ("", "x", " x ", "ñ y")] + [(None,)]
    df = spark.createDataFrame(texts, "t string")
    differs = df.where(~text.stripped("t").eqNullSafe(text.strip(text.or_empty(F.col("t")))))
    assert df.count() == len(texts) and differs.collect() == []
