"""The pull as a stream: whole tickets, restarts, replays."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tillsight.operators import purchases
from tillsight.schemas import POS_LINES, column_names
from tillsight.sources import pull, star
from tillsight.streaming import sales


@pytest.fixture
def server(spark, tmp_path):
    spark.dataSource.register(pull.StorePull)
    path = str(tmp_path / "server")

    def add(lines):
        numbered = lines.withColumn(pull.NUMBER, F.col("ticket_id").cast("bigint"))
        numbered.select(*column_names(POS_LINES), pull.NUMBER).write.mode("append").parquet(path)

    def stream(**options):
        reader = spark.readStream.format("store_pull").option("path", path).option("stores", "TS0001,TS0002")
        for name, value in options.items():
            reader = reader.option(name, value)
        return reader.load()

    return add, stream


def test_pull_feeds_the_sales_stream(spark, folder, tmp_path, server):
    add, stream = server
    lines = star.pos_lines(spark, folder)
    feed = sales.SalesFeed(str(tmp_path / "sales"), star.LOOKUPS, star.LIMITS, star.SALES_AS_OF)
    number = F.col("ticket_id").cast("bigint")
    middle = lines.agg(F.max(number)).first()[0] // 2

    def run(checkpoint):
        sales.start_ingest(stream(tickets_per_task=500), feed, f"{tmp_path}/{checkpoint}").awaitTermination()

    add(lines.filter(number <= middle))
    run("a")
    half = sales.stored_purchases(spark, feed).count()
    run("a")  # nothing new
    assert sales.stored_purchases(spark, feed).count() == half > 0
    add(lines.filter(number > middle))
    run("a")
    expected = purchases.purchases_from_pos(lines, star.LOOKUPS, star.LIMITS)
    stored = sales.stored_purchases(spark, feed)
    assert stored.exceptAll(expected).count() == 0 and stored.count() == expected.count()
    marks = {r.sync_key: r.last_cursor for r in sales.sync_state(spark, feed).collect()}
    run("b")  # a lost checkpoint: everything is read again, nothing is stored twice
    assert sales.stored_purchases(spark, feed).count() == expected.count()
    assert {r.sync_key: r.last_cursor for r in sales.sync_state(spark, feed).collect()} == marks


def test_batches_hold_whole_tickets(spark, folder, tmp_path, server):
    add, stream = server
    lines = star.pos_lines(spark, folder).filter("CAST(ticket_id AS BIGINT) <= 400")
    add(lines.repartition(5))
    batches = []

    def keep(batch, number):
        batches.append([(r.store_code, r.ticket_id) for r in batch.collect()])

    query = stream(tickets_per_batch=150, tickets_per_task=40).writeStream.foreachBatch(keep)
    query = query.option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(10):
            query.processAllAvailable()
            assert query.exception() is None
    finally:
        query.stop()
    full = [b for b in batches if b]
    assert sum(map(len, full)) == lines.filter("store_code <> 'TS0003'").count() and len(full) >= 3
    tickets = [set(b) for b in full]
    assert all(not a & b for n, a in enumerate(tickets) for b in tickets[n + 1 :])


def test_an_empty_server(spark, tmp_path, server):
    add, stream = server
    add(star.pos_lines(spark, "/root/testdata/sf0.001").limit(0))
    stream().writeStream.format("memory").queryName("nothing_pulled").option("checkpointLocation", str(tmp_path / "c")).trigger(
        availableNow=True
    ).start().awaitTermination()
    assert spark.table("nothing_pulled").count() == 0
