"""Streams: restarts, repeated batches, late rows; batch = stream is in test_queries."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from tillsight import registry
from tillsight.operators import activity as batch_activity
from tillsight.operators import customers, keep
from tillsight.operators import messages as batch_messages
from tillsight.schemas import MESSAGES, POS_LINES
from tillsight.sources import star
from tillsight.streaming import activity, sales, tables
from tillsight.streaming import messages as message_stream


def land(df, path):
    df.write.mode("append").parquet(path)


def test_restart_stores_nothing_twice(spark, folder, tmp_path):
    feed = star.raw_messages(spark, folder)
    root = str(tmp_path)

    def run():
        source = spark.readStream.schema(feed.schema).parquet(f"{root}/landing")
        message_stream.start_ingest(source, root, f"{root}/checkpoint").awaitTermination()

    land(feed.filter("arrival < 500"), f"{root}/landing")
    run()
    run()  # nothing new
    land(feed, f"{root}/landing")  # the whole feed again, including known rows
    run()
    stored = message_stream.stored_messages(spark, root)
    expected = registry._messages(spark, folder)
    assert stored.count() == expected.count()
    assert stored.exceptAll(expected).count() == 0
    counters = message_stream.stored_counters(spark, root).agg(
        F.sum("rows_total").alias("t"), F.sum("rows_inserted").alias("i"), F.sum("rows_skipped").alias("s")
    ).first()
    assert counters.t == counters.i + counters.s and counters.i == expected.count()


def test_new_checkpoint_replays_several_batches_without_duplicates(spark, folder, tmp_path):
    """The batches of the old stream stay; the new one finds all their rows."""
    feed = star.raw_messages(spark, folder)
    root = str(tmp_path)

    def run(checkpoint):
        source = spark.readStream.schema(feed.schema).parquet(f"{root}/landing")
        message_stream.start_ingest(source, root, f"{root}/{checkpoint}").awaitTermination()

    for part in ("arrival % 3 = 0", "arrival % 3 = 1", "arrival % 3 = 2"):
        land(feed.filter(part), f"{root}/landing")
        run("checkpoint-a")
    run("checkpoint-b")
    stored = tables.read(spark, f"{root}/messages", MESSAGES)
    assert stored.select("batch").distinct().count() == 3
    assert stored.count() == stored.select("message_id").distinct().count()
    assert stored.count() == registry._messages(spark, folder).count()


def lines_of(spark, *rows):
    """(ticket, line, phone) as ticket lines of one store."""
    values = [("TS0001", t, n, "TK", dt.date(2024, 1, 1), "s", "1/2EC", "d", "b", 1, 10, "CA", "name", p, "web") for t, n, p in rows]
    return spark.createDataFrame(
        [v[:9] + (Decimal(v[9]), Decimal(v[10])) + v[11:] for v in values], POS_LINES
    )


ODD = [("5", 1, "5511111111"), ("", 2, "5511111111"), (None, 3, "5511111111"), ("A7", 4, "5522222222"), ("0", 5, "5522222222"), ("9", 6, "12")]


def test_replayed_sales_count_once(spark, tmp_path):
    """Blank, missing and textual tickets are rejected once; sums and marks stay."""
    root = str(tmp_path)
    feed = sales.SalesFeed(f"{root}/sales", star.LOOKUPS, star.LIMITS, star.SALES_AS_OF)

    def run(checkpoint):
        source = spark.readStream.schema(POS_LINES).parquet(f"{root}/landing")
        sales.start_ingest(source, feed, f"{root}/{checkpoint}").awaitTermination()

    for upload in range(3):
        land(lines_of(spark, *ODD, (str(10 + upload), 1, "5511111111")), f"{root}/landing")
        run("checkpoint-a")
    run("checkpoint-b")
    bought = sales.stored_purchases(spark, feed)
    assert sorted(r.ticket_id for r in bought.collect()) == ["0", "10", "11", "12", "5"]
    totals = {r.phone: float(r.total_lifetime) for r in sales.current_customers(spark, feed).collect()}
    assert totals == {"5511111111": 40.0, "5522222222": 10.0}
    rejects = tables.read(spark, feed.path("rejects"), sales.REJECTS)
    reasons = Counter(r.reject_reason for r in rejects.collect())
    assert reasons == {"ticket_invalid": 3, "phone_invalid": 1}
    state = {r.sync_key: (r.last_cursor, r.rows_synced) for r in sales.sync_state(spark, feed).collect()}
    assert state["sales_sync_TS0001"] == ("12", 5) and state["sales_sync_TS0002"] == (None, 0)
    sales.compact_customers(spark, feed, f"{root}/compact")
    small = sales.SalesFeed(f"{root}/compact", star.LOOKUPS, star.LIMITS, star.SALES_AS_OF)
    assert set(sales.current_customers(spark, small).collect()) == set(sales.current_customers(spark, feed).collect())


def test_a_batch_reads_the_facts_of_its_buckets_only(spark, tmp_path, capsys):
    root = str(tmp_path)
    feed = sales.SalesFeed(f"{root}/sales", star.LOOKUPS, star.LIMITS, star.SALES_AS_OF)
    sales.create(spark, feed)
    lines = lines_of(spark, *[(str(n), 1, f"55{n:08d}") for n in range(1, 200)])
    sales.refresh_touched(sales.store_batch(lines, feed, "run.1"), feed, "run.1")
    new = sales.store_batch(lines_of(spark, ("900", 1, "5500000007")), feed, "run.2")
    sales.refresh_touched(new, feed, "run.2")
    written = tables.of_batch(spark, feed.path("customers"), "phone string, total_orders bigint", "run.2").collect()
    assert [(r.phone, r.total_orders) for r in written] == [("5500000007", 2)]
    known = keep.known_keys(sales.stored_purchases(spark, feed), new, ["ticket_id"])
    known.explain("formatted")
    plan = capsys.readouterr().out
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan  # the history is filtered before any shuffle


def test_touched_customers_equal_full_recompute(spark, folder, tmp_path):
    lines = star.pos_lines(spark, folder)
    root = str(tmp_path)
    feed = sales.SalesFeed(f"{root}/sales", star.LOOKUPS, star.LIMITS, star.SALES_AS_OF)
    half = F.col("ticket_id").cast("bigint") % 2 == 0
    for part in (half, ~half):
        land(lines.filter(part), f"{root}/landing")
        source = spark.readStream.schema(lines.schema).parquet(f"{root}/landing")
        sales.start_ingest(source, feed, f"{root}/checkpoint").awaitTermination()
    full = customers.customer_360(sales.stored_purchases(spark, feed), star.SALES_AS_OF, star.LIMITS)
    now = sales.current_customers(spark, feed).select(*full.columns)
    assert now.exceptAll(full).count() == 0 and full.exceptAll(now).count() == 0
    log = tables.read(spark, feed.path("sync_log"), "sync_key string, rows_synced bigint")
    assert log.agg(F.sum("rows_synced")).first()[0] == sales.stored_purchases(spark, feed).count()
    rejects = tables.read(spark, feed.path("rejects"), sales.REJECTS)
    assert rejects.count() == registry.purchase_rejects(spark, folder).distinct().count()


def test_a_batch_that_died_with_its_checkpoint(spark, folder, tmp_path):
    """Half of the tickets were stored by a batch that wrote nothing else; a new stream reads all lines."""
    lines = star.pos_lines(spark, folder)
    root = str(tmp_path)
    feed = sales.SalesFeed(f"{root}/sales", star.LOOKUPS, star.LIMITS, star.SALES_AS_OF)
    sales.create(spark, feed)
    half = sales.purchases.scan_pos(lines.filter("CAST(ticket_id AS BIGINT) % 2 = 0"), star.LOOKUPS.store_rules)
    clean = tables.landed(sales.purchases.clean_lines(half, star.LOOKUPS, star.LIMITS), feed.path("lines"), "lost.1")
    tables.write(sales.purchases.dedup_purchases(sales.purchases.accepted(clean)), feed.path("purchases"), "lost.1")

    land(lines, f"{root}/landing")
    source = spark.readStream.schema(lines.schema).parquet(f"{root}/landing")
    sales.start_ingest(source, feed, f"{root}/checkpoint").awaitTermination()
    full = customers.customer_360(sales.stored_purchases(spark, feed), star.SALES_AS_OF, star.LIMITS)
    now = sales.current_customers(spark, feed).select(*full.columns)
    assert now.exceptAll(full).count() == 0 and full.exceptAll(now).count() == 0
    synced = sales.sync_state(spark, feed).agg(F.sum("rows_synced")).first()[0]
    assert synced == sales.stored_purchases(spark, feed).count() == registry.purchases_dedup(spark, folder).count()
    assert tables.unfinished(spark, feed.path("purchases"), sales.PURCHASES) == []


def test_messages_that_were_stored_but_not_counted(spark, folder, tmp_path):
    feed = star.raw_messages(spark, folder)
    root = str(tmp_path)
    tables.create(spark, f"{root}/messages", MESSAGES)
    arrived = tables.landed(batch_messages.normalize_messages(feed.filter("arrival < 500")), f"{root}/arrived", "lost.1")
    tables.write(batch_messages.new_messages(arrived, arrived.limit(0)), f"{root}/messages", "lost.1")
    land(feed, f"{root}/landing")
    source = spark.readStream.schema(feed.schema).parquet(f"{root}/landing")
    message_stream.start_ingest(source, root, f"{root}/checkpoint").awaitTermination()
    inserted = message_stream.stored_counters(spark, root).agg(F.sum("rows_inserted")).first()[0]
    assert inserted == message_stream.stored_messages(spark, root).count() == registry._messages(spark, folder).count()


def _scanned_rows(plan):
    """Rows that the scans of a plan gave, if it has run."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _scanned_rows(plan.executedPlan())
    if "QueryStage" in name:
        return _scanned_rows(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if name.startswith("Scan parquet") else 0
    children = plan.children()
    return own + sum(_scanned_rows(children.apply(n)) for n in range(children.size()))


def test_known_keys_read_the_history_near_the_batch_only(spark, tmp_path):
    """Twenty batches of a thousand tickets each; what is read does not follow their number."""
    root = str(tmp_path)
    for n in range(20):
        rows = spark.range(100_000 + 1000 * n, 101_000 + 1000 * n, 1, 2).select(F.col("id").cast("string").alias("ticket_id"), F.lit("p").alias("phone"))
        tables.write(rows, root, f"run.{n:02d}")
    history = spark.read.schema("ticket_id string, phone string, batch string").parquet(root)
    for first, known in ((120_000, 0), (119_000, 1000), (105_500, 1000)):
        batch = spark.range(first, first + 1000).select(F.col("id").cast("string").alias("ticket_id"), F.lit("p").alias("phone"))
        found = keep.known_keys(history, batch, ["ticket_id", "phone"])
        execution = found._jdf.queryExecution()
        assert len(execution.executedPlan().executeCollectPublic()) == known
        assert _scanned_rows(execution.executedPlan()) <= 2 * known
    empty = history.limit(0)
    assert keep.known_keys(history, empty, ["ticket_id", "phone"]).count() == 0


def test_late_beacons_count_and_replays_do_not(spark, tmp_path):
    root = str(tmp_path)
    schema = "agent string, event string, detail string, ts timestamp"

    def run(checkpoint):
        source = activity.with_file(spark.readStream.schema(schema).parquet(f"{root}/landing"))
        activity.start_daily(source, f"{root}/daily", f"{root}/{checkpoint}").awaitTermination()

    def upload(*rows):
        land(spark.createDataFrame([("a", "page_open", None, t) for t in rows], schema), f"{root}/landing")
        run("checkpoint-a")

    upload(dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 10, 12))
    upload(dt.datetime(2024, 1, 9, 20))
    upload(dt.datetime(2024, 1, 1, 13))  # nine days late
    run("checkpoint-b")  # everything again
    days = {r.day: r.opens for r in activity.current_days(spark, f"{root}/daily").collect()}
    assert days == {dt.date(2024, 1, 1): 2, dt.date(2024, 1, 9): 1, dt.date(2024, 1, 10): 1}
    everything = spark.read.schema(schema).parquet(f"{root}/landing")
    batch = batch_activity.daily_activity(everything, dt.datetime(2024, 1, 11), 30)
    assert {r.day: r.opens for r in batch.collect()} == days


def test_uploads_are_cut_from_lines_joined_once(spark, folder, capsys, monkeypatch):
    """The three uploads read the written lines; none of them joins the tables again."""
    plans, land_one = [], registry._land

    def noted(upload, landing):
        capsys.readouterr()
        upload.explain()
        plans.append(capsys.readouterr().out)
        land_one(upload, landing)

    monkeypatch.setattr(registry, "_land", noted)
    registry._sales_feed(spark, folder)
    assert len(plans) == 3 and not any("Join" in plan for plan in plans)
