"""Shapes of the physical plans, and results when one key owns a third of all rows."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tillsight.operators import customers, enrich, keep, messages, purchases, styles
from tillsight.schemas import PURCHASES
from tillsight.session import lookup_frame, shared_folder, shuffle_partitions
from tillsight.sources import star

STREAMS = {name for name in entry.queries() if name.startswith("stream_")}


def plan_of(df, capsys) -> str:
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - STREAMS))
def test_no_pair_joins_and_no_python(spark, folder, capsys, name):
    plan = plan_of(entry.queries()[name](spark, folder), capsys)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "EvalPython" not in plan and "InPandas" not in plan


@pytest.mark.parametrize(
    "name", ["purchases_dedup", "messages_dedup", "contact_index", "staged_chunks", "recent_purchases"]
)
def test_rows_per_key_are_limited_before_the_shuffle(spark, folder, capsys, name):
    plan = plan_of(entry.queries()[name](spark, folder), capsys)
    assert "Partial" in plan and "WindowGroupLimit" in plan


@pytest.mark.parametrize("name", ["customer_360", "customer_360_enriched", "customers_upsert"])
def test_lines_joined_by_ticket_are_not_shuffled_again(spark, folder, capsys, name):
    """Large tables: the last join deals the lines by ticket, which every purchase key holds."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        plan = plan_of(entry.queries()[name](spark, folder), capsys)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in plan and "WindowGroupLimit" in plan
    assert not re.search(r"hashpartitioning\(ticket_id#\d+, product_code", plan)


@pytest.mark.parametrize(
    "name", ["message_page", "recent_sessions", "log_entries", "upload_sessions"]
)
def test_top_k_does_not_sort_everything(spark, folder, capsys, name):
    assert "TakeOrderedAndProject" in plan_of(entry.queries()[name](spark, folder), capsys)


def test_customer_list_does_not_sort_everything(spark, folder, capsys):
    listed = enrich.top_customers(entry.queries()["customer_360"](spark, folder), 200)
    assert "TakeOrderedAndProject" in plan_of(listed, capsys)


def test_only_listed_contacts_are_indexed(spark, folder, capsys):
    """The contacts meet the written list before they are windowed by phone."""
    plan = plan_of(entry.queries()["customers_enriched"](spark, folder), capsys)
    assert "LeftSemi" in plan and "stack" not in plan


def test_roll_up_reads_purchases_once(spark, tmp_path, capsys):
    path = str(tmp_path / "p")
    spark.createDataFrame([], PURCHASES).write.parquet(path)
    bought = spark.read.schema(PURCHASES).parquet(path)
    plan = plan_of(customers.customer_360(bought, star.SALES_AS_OF, star.LIMITS), capsys)
    assert len(re.findall(r"^\(\d+\) Scan parquet", plan, re.M)) == 1
    assert len(re.findall(r"^\(\d+\) Exchange", plan, re.M)) == 2
    assert "Expand" not in plan
    schema = re.search(r"ReadSchema: struct<(.*)>", plan).group(1)
    assert "unit_price" not in schema and "product_name" not in schema


def test_filters_reach_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "m")
    star.raw_messages(spark, "/root/testdata/sf0.001").write.parquet(path)
    stored = spark.read.parquet(path)
    plan = plan_of(messages.message_page(stored, star.CHAT_AS_OF, 7, 100), capsys)
    assert "GreaterThanOrEqual(datetime" in plan
    assert "sender_type" not in plan
    plan = plan_of(stored.transform(lambda d: messages.prune_months(d, star.CHAT_AS_OF)), capsys)
    assert re.search(r"PushedFilters: \[Or\(IsNull\(datetime\),GreaterThanOrEqual\(datetime", plan)


def test_store_rules_reach_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "l")
    star.pos_lines(spark, "/root/testdata/sf0.001").write.parquet(path)
    lines = spark.read.parquet(path)
    plan = plan_of(purchases.scan_pos(lines, star.LOOKUPS.store_rules), capsys)
    assert "In(store_code, [TS0001,TS0002])" in plan and "IsNotNull(phone_raw)" in plan


def test_big_lookup_tables_are_not_broadcast(spark, capsys):
    schema = pa.schema([("key", pa.string()), ("v", pa.string())])
    rows = [(str(i), "c") for i in range(300_000)]
    big = lookup_frame(spark, schema, rows)
    left = spark.range(10).select(F.col("id").cast("string").alias("key"))
    assert "SortMergeJoin" in plan_of(left.join(big, "key", "left"), capsys)
    small = lookup_frame(spark, schema, rows[:10])
    assert "BroadcastHashJoin" in plan_of(left.join(small, "key", "left"), capsys)


def test_shuffle_partitions_follow_the_input():
    assert shuffle_partitions(1 << 20, 8) == 8
    assert shuffle_partitions(1 << 40, 8) == 8192
    maps = (100 << 40) // (128 << 20)
    assert 8000 <= shuffle_partitions(100 << 40, 2000) or maps * shuffle_partitions(100 << 40, 2000) <= 2_000_000_000


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


# One phone, key or contact owns a third of all rows.


@pytest.fixture(scope="module")
def hot(spark):
    n = 6000
    key = F.col("id")
    hot = key % 3 == 0
    return spark.range(n).select(
        F.when(hot, F.lit("5500000000")).otherwise(F.lpad((key % 97).cast("string"), 10, "5")).alias("phone"),
        F.expr("date_add(DATE'2024-01-01', CAST(id % 30 AS INT))").alias("purchase_date"),
        F.lit("TS0001").alias("store_code"),
        F.concat(F.lit("s"), (key % 4).cast("string")).alias("seller"),
        F.lit(None).cast("string").alias("agent_name"),
        F.when(key % 2 == 0, F.lit("agent_online")).otherwise(F.lit("walkin")).alias("sales_channel"),
        F.floor(key / 5).cast("string").alias("ticket_id"),
        F.concat((key % 700).cast("string"), F.lit("EC")).alias("product_code"),
        F.lit("").alias("product_name"),
        F.lit(None).cast("string").alias("category"),
        F.lit(1).alias("qty"),
        F.lit(9_999_999_999).cast("decimal(12,2)").alias("unit_price"),
        F.lit(9_999_999_999).cast("decimal(12,2)").alias("line_total"),
        F.lit("CA").alias("payment_method"),
        F.lit("web").alias("lead_source"),
        F.lit("n").alias("raw_customer_name"),
        F.lit("").alias("raw_city"),
    )


def test_hot_phone_roll_up(hot):
    rows = hot.collect()
    summary = {r.phone: r for r in customers.customer_360(hot, star.SALES_AS_OF, star.LIMITS).collect()}
    lines = Counter(r.phone for r in rows)
    assert set(summary) == set(lines)
    assert lines["5500000000"] >= len(rows) // 3
    for phone, total in lines.items():
        own = [r for r in rows if r.phone == phone]
        got = summary[phone]
        assert got.total_lifetime == total * 9_999_999_999
        assert got.total_orders == len({r.ticket_id for r in own})
        assert got.total_online_orders == len({r.ticket_id for r in own if r.sales_channel == "agent_online"})
        products = Counter(r.product_code for r in own)
        assert got.favorite_product == min(products, key=lambda v: (-products[v], v))


def test_hot_phone_spreads_over_the_tasks(spark, hot):
    """After the first shuffle no task holds more than its share of the rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        facts = customers._count_facts(hot, customers._base_facts(False) + customers._favorite_facts())
        own = facts.filter("phone = '5500000000'")
        sizes = [r["count"] for r in own.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 1.5 * sum(sizes) / len(sizes)


def test_hot_style_and_phone(hot):
    buyers = styles.buyers_by_style(hot.withColumn("product_code", F.lit("1EC-M")), customers.customer_names(hot))
    own = hot.filter("phone = '5500000000'")
    row = buyers.filter("phone = '5500000000'").first()
    assert (row.style, row.pieces) == ("1EC", own.count())
    assert row.tickets == own.select("ticket_id").distinct().count()


def test_hot_key_sends_one_row_per_task(spark):
    """A key with a third of all rows leaves each task as one row."""
    df = spark.range(0, 9000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), (-F.col("id")).alias("n")
    )
    first = {r.k: r.n for r in keep.keep_first(df, ["k"], ["n"]).collect()}
    assert len(first) == 6001 and first[-1] == -8997


def test_hot_contact_phone_last_wins(spark):
    df = spark.range(3000).select(
        F.col("id").alias("row_no"),
        F.col("id").cast("string").alias("contact_id"),
        F.when(F.col("id") % 3 == 0, F.lit("5500000000")).otherwise(F.lpad(F.col("id").cast("string"), 10, "0")).alias("phone"),
        F.lit("building@example.com").alias("assignee"),
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("ciudad"),
    )
    index = {r.phone: r for r in enrich.contact_index(df, star.LOOKUPS).collect()}
    assert len(index) == 2001
    assert (index["5500000000"].contact_city, index["5500000000"].respond_agent) == ("c2997", "A1")
