"""Properties that hold whatever the data."""

from __future__ import annotations

import datetime as dt
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillsight import registry
from tillsight.operators import customers, enrich, keep, merge, messages, profiles, purchases, styles
from tillsight.schemas import PURCHASES
from tillsight.sources import star


@pytest.fixture(scope="module")
def bought(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "purchases")
    registry._purchases(spark, folder).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def chat(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "messages")
    registry._messages(spark, folder).write.parquet(path)
    return spark.read.parquet(path)


def purchase(phone="5500000000", ticket="1", code="1EC", **values):
    row = {
        "phone": phone, "purchase_date": dt.date(2024, 1, 1), "store_code": "TS0001", "seller": "", "agent_name": None,
        "sales_channel": "walkin", "ticket_id": ticket, "product_code": code, "product_name": "", "category": None,
        "qty": 1, "unit_price": Decimal("10.00"), "line_total": Decimal("10.00"), "payment_method": "",
        "lead_source": "", "raw_customer_name": "", "raw_city": "",
    }
    return tuple({**row, **values}.values())


def test_channel_money_adds_up(bought):
    base = customers.customer_base(bought, star.SALES_AS_OF, star.LIMITS)
    wrong = base.filter(F.col("total_online") + F.col("total_walkin") != F.col("total_lifetime"))
    assert base.count() > 0 and wrong.count() == 0


def test_mixed_ticket_counts_in_both_channels(spark):
    lines = [
        purchase(code="1EC", sales_channel="agent_online", seller="S", agent_name="A"),
        purchase(code="2EC"),
        purchase(ticket="2", code="2EC"),
    ]
    row = customers.customer_360(spark.createDataFrame(lines, PURCHASES), dt.date(2024, 5, 1), star.LIMITS).first()
    assert (row.total_orders, row.total_online_orders, row.total_walkin_orders) == (2, 1, 2)
    assert (row.favorite_seller, row.favorite_agent, row.favorite_product) == ("S", "A", "2EC")


def test_walkin_seller_is_no_favorite(spark):
    lines = [purchase(seller="S", agent_name="A")]
    row = customers.customer_360(spark.createDataFrame(lines, PURCHASES), dt.date(2024, 5, 1), star.LIMITS).first()
    assert row.favorite_seller is None and row.favorite_agent is None and row.favorite_category is None


def test_unknown_dates_leave_lapsed_unknown(spark):
    lines = [purchase(purchase_date=None)]
    df = customers.customer_360(spark.createDataFrame(lines, PURCHASES), dt.date(2024, 5, 1), star.LIMITS)
    assert df.first().is_lapsed is None
    flagged = enrich.flag_cities(df, ())
    assert enrich.customer_stats(flagged).first().lapsed == 0


def test_favorites_against_brute_force(bought):
    counts = defaultdict(Counter)
    for row in bought.select("phone", "payment_method").collect():
        counts[row.phone][row.payment_method] += 1
    expected = {p: min(c, key=lambda v: (-c[v], v)) for p, c in counts.items()}
    got = {r.phone: r.favorite_payment for r in customers.favorites(bought).collect()}
    assert got == expected


def test_ticket_per_store_tells_equal_numbers_apart(spark):
    df = spark.createDataFrame([purchase(), purchase(store_code="TS0002")], PURCHASES)
    as_of = dt.date(2024, 5, 1)
    assert customers.customer_base(df, as_of, star.LIMITS).first().total_orders == 1
    assert customers.customer_base(df, as_of, star.LIMITS, ticket_per_store=True).first().total_orders == 2


def test_dedup_is_idempotent(spark, folder, bought):
    cleaned = purchases.accepted(registry._cleaned(spark, folder))
    twice = cleaned.unionAll(cleaned)
    assert purchases.dedup_purchases(twice).exceptAll(bought).count() == 0
    assert purchases.dedup_purchases(twice).count() == bought.count()
    assert purchases.new_purchases(twice, bought).count() == 0


def test_upload_counters_add_up(spark, folder, chat):
    arrived = registry._arrived(spark, folder)
    stored = chat.filter(F.col("datetime") < "2024-01-15")
    c = messages.upload_counters(arrived, stored).first()
    assert c.rows_total == c.rows_inserted + c.rows_skipped
    assert c.rows_skipped == c.skipped_no_id + c.skipped_stored + c.skipped_repeated
    assert c.rows_inserted == messages.new_messages(arrived, stored).count()


def test_counters_of_an_empty_batch(spark, chat):
    arrived = chat.withColumn("arrival", F.lit(0)).filter(F.lit(False))
    assert tuple(messages.upload_counters(arrived, chat).first()) == (0, 0, 0, 0, 0, 0)


def test_walking_the_cursor_gives_all_pages(chat):
    days, size = 7, 50
    cursor, walked = None, []
    for _ in range(100):
        page = messages.message_page(chat, star.CHAT_AS_OF, days, size, cursor).collect()
        walked += [r.message_id for r in page]
        if len(page) < size:
            break
        cursor = (page[-1].datetime, page[-1].message_id)
    pages = messages.message_pages(chat, star.CHAT_AS_OF, days, size).orderBy("position").collect()
    assert walked == [r.message_id for r in pages]
    assert [r.page_no for r in pages] == [i // size + 1 for i in range(len(pages))]
    assert len(walked) == messages.in_window(chat, star.CHAT_AS_OF, days).count()


def test_pages_split_one_busy_second(spark):
    busy = spark.range(2000).select(
        F.concat(F.lit("m"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("message_id"),
        F.lit("c").alias("contact_id"),
        F.lit("2024-01-30 10:00:00").cast("timestamp").alias("datetime"),
        *[F.lit("text").alias(n) for n in ("message_type", "content_type", "content_raw")],
    )
    pages = messages.message_pages(busy, star.CHAT_AS_OF, 7, 100).orderBy("position").collect()
    assert [r.message_id for r in pages] == [f"m{i:05d}" for i in reversed(range(2000))]
    assert [r.position for r in pages] == list(range(1, 2001))


def test_full_last_page_says_there_is_more(chat):
    total = messages.in_window(chat, star.CHAT_AS_OF, 7).count()
    page = messages.message_page(chat, star.CHAT_AS_OF, 7, total)
    cursor = messages.page_cursor(page, total).first()
    assert cursor.has_more and cursor.next_id is not None
    after = messages.message_page(chat, star.CHAT_AS_OF, 7, total, (cursor.next_dt, cursor.next_id))
    empty = messages.page_cursor(after, total).first()
    assert (empty.page_count, empty.has_more, empty.next_id) == (0, False, None)


def test_retention_keeps_unknown_times(chat):
    kept = messages.prune_months(chat, dt.datetime(2030, 1, 1))
    assert kept.count() == chat.filter("datetime IS NULL").count() > 0


def test_customers_without_contact_keep_their_columns(spark, bought):
    summary = customers.customer_360(bought, star.SALES_AS_OF, star.LIMITS)
    nobody = spark.createDataFrame([], "row_no bigint, contact_id string, phone string, assignee string, ciudad string")
    enriched = enrich.enrich_customers(summary, nobody, star.LOOKUPS)
    assert enriched.select(*summary.columns).exceptAll(summary).count() == 0
    assert enriched.filter("respond_agent IS NOT NULL").count() == 0


def test_stored_city_blocks_the_area_code(spark):
    rows = [("2201234567", "Here", None, None), ("2201234568", "", None, None), ("2401234567", None, None, "A9")]
    listed = spark.createDataFrame(rows, "phone string, city string, x string, favorite_agent string")
    nobody = spark.createDataFrame([], "row_no bigint, contact_id string, phone string, assignee string, ciudad string")
    got = enrich.enrich_customers(listed, nobody, star.LOOKUPS).orderBy("phone").collect()
    assert [(r.respond_city, r.effective_agent) for r in got] == [
        (None, "Unassigned"), ("city_220", "Unassigned"), ("city_24", "A9"),
    ]


def test_upsert_policies(spark):
    old = spark.createDataFrame([("1", "old", 1, "kept"), ("2", "old", 1, "kept")], "k string, f string, o int, s string")
    new = spark.createDataFrame([("2", None, None), ("3", "new", 3)], "k string, f string, o int")
    got = merge.upsert(old, new, "k", overwrite=["o"], fill=["f"], keep={"s": F.lit("first")}).orderBy("k").collect()
    assert [tuple(r[c] for c in ("k", "f", "o", "s")) for r in got] == [
        ("1", "old", 1, "kept"), ("2", "old", None, "kept"), ("3", "new", 3, "first"),
    ]


def test_upsert_twice_changes_nothing(spark, folder, bought):
    summary = customers.customer_360(bought, star.SALES_AS_OF, star.LIMITS)
    once = merge.upsert_customers(star.stored_customers(spark, folder), summary)
    twice = merge.upsert_customers(once, summary)
    assert once.select(*sorted(once.columns)).exceptAll(twice.select(*sorted(twice.columns))).count() == 0


def test_city_flags_stay_without_a_city(spark):
    rows = [("1", "", True, 2, "S"), ("2", "NATION_12", False, None, "S"), ("3", "Other", True, 1, "S")]
    df = spark.createDataFrame(rows, "phone string, city string, is_priority_city boolean, city_priority_score int, state string")
    got = enrich.flag_cities(df, star.LOOKUPS.cities).orderBy("phone").collect()
    assert [(r.is_priority_city, r.city_priority_score, r.state) for r in got] == [
        (True, 2, "S"), (True, 2, "S"), (False, None, "S"),
    ]


def test_order_metrics(spark):
    rows = [
        ("1", 3, Decimal("100.00"), dt.date(2024, 1, 1), dt.date(2024, 1, 6)),
        ("2", 1, Decimal("10.00"), dt.date(2024, 1, 1), dt.date(2024, 1, 1)),
        ("3", 0, Decimal("0.00"), None, None),
        ("4", 2, Decimal("5.00"), None, None),
    ]
    df = spark.createDataFrame(
        rows, "phone string, total_orders bigint, total_lifetime decimal(28,2), first_purchase_date date, last_purchase_date date"
    )
    got = {r.phone: (r.avg_order, r.avg_days_between_orders) for r in profiles.order_metrics(df).collect()}
    assert got == {"1": (100 / 3, 3), "2": (10.0, None), "3": (None, None), "4": (2.5, None)}


def test_profile_of_one_phone(spark, bought):
    base = customers.customer_base(bought, star.SALES_AS_OF, star.LIMITS)
    phone = bought.first().phone
    profile = profiles.customer_profile(base, bought, f"+52 1 {phone}").collect()
    assert [r.phone for r in profile] == [phone]
    assert 1 <= len(profile[0].recent_purchases) <= 5
    assert [p.position for p in profile[0].recent_purchases] == list(range(1, len(profile[0].recent_purchases) + 1))


def test_recent_purchases_put_unknown_dates_first(spark):
    lines = [purchase(ticket=str(i), purchase_date=dt.date(2024, 1, i)) for i in range(1, 7)]
    lines.append(purchase(ticket="x", purchase_date=None))
    got = profiles.recent_purchases(spark.createDataFrame(lines, PURCHASES)).orderBy("position").collect()
    assert [r.ticket_id for r in got] == ["x", "6", "5", "4", "3"]


def test_style_search_finds_variants_of_raw_codes(spark):
    lines = [purchase(code=c, ticket=c) for c in ("31EC", "31EC-M", "31ECX", "31ec")]
    df = spark.createDataFrame(lines, PURCHASES)
    buyers = styles.style_buyers(df, customers.customer_names(df), "31ec")
    assert buyers.first().tickets == 2
    assert styles.style_totals(buyers).first().customers == 1


def test_keep_last_and_not_in(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, n int")
    assert sorted(tuple(r) for r in keep.keep_last(df, ["k"], ["n"]).collect()) == [("a", 2), ("b", 1)]
    assert keep.not_in(df, df.filter("n = 2"), ["k"]).count() == 1
