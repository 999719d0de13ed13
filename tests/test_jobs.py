"""End-to-end jobs: repeated runs, resumed runs, uploads."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillsight import registry
from tillsight.operators import customers, messages
from tillsight.plans import sales, uploads
from tillsight.schemas import CUSTOMERS, column_names
from tillsight.sources import csvfiles, snapshots, star
from tillsight.streaming import tables
from tillsight.streaming.sales import SalesFeed

AS_OF = dt.datetime(2024, 1, 31)


def same(a, b) -> bool:
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    a, b = a.select(*names), b.select(*names)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_sales_runs_resume_and_repeat(spark, folder, tmp_path):
    lines = star.pos_lines(spark, folder)
    feed = SalesFeed(str(tmp_path / "sales"), star.LOOKUPS, star.LIMITS, star.SALES_AS_OF)
    half = F.col("ticket_id").cast("bigint") <= 700
    sales.sync(lines.filter(half), feed, 1)
    first = sales.marks(spark, feed, 2)
    assert all(0 < mark <= 700 for mark in first.values())
    sales.sync(lines, feed, 2)
    sales.sync(lines, feed, 2)  # the run is repeated after a failure
    sales.sync(lines, feed, 3, reset=True)  # everything again: nothing is new

    stored = tables.read(spark, feed.path("purchases"), "phone string, line_total decimal(12,2)")
    expected = registry._purchases(spark, folder)
    assert stored.count() == expected.count()
    summary = customers.customer_360(expected, star.SALES_AS_OF, star.LIMITS)
    kept = sales.stored_customers(spark, feed)
    assert kept.columns == column_names(CUSTOMERS)
    assert same(kept.select(*summary.columns), summary)

    states, totals = sales.status(spark, feed)
    assert sum(r.rows_synced for r in states.collect()) == expected.count()
    assert totals.first().purchases == expected.count()
    assert totals.first().customers == summary.count()

    listed, stats, counts = sales.customer_list(kept, star.contacts(spark, folder), feed, 50)
    assert listed.count() == min(50, summary.count())
    assert stats.first().total == summary.count()
    assert sum(r.customers for r in counts.collect()) == listed.count()


def test_identical_runs_leave_one_reject_and_the_mark_of_the_last_line(spark, tmp_path):
    from test_streams import ODD, lines_of

    feed = SalesFeed(str(tmp_path / "sales"), star.LOOKUPS, star.LIMITS, star.SALES_AS_OF)
    for run in (1, 2, 3):
        sales.sync(lines_of(spark, *ODD), feed, run, reset=run == 3)
    rejects = tables.read(spark, feed.path("rejects"), "ticket_id string, reject_reason string")
    assert rejects.filter("reject_reason = 'phone_invalid'").count() == 1
    assert rejects.count() == rejects.select("ticket_id", "reject_reason", ).distinct().count() + 1  # '' and missing
    assert sales.marks(spark, feed, 4) == {store: 9 if store == "TS0001" else None for store in feed.stores()}
    states = {r.sync_key: r.rows_synced for r in sales.status(spark, feed)[0].collect()}
    assert states["sales_sync_TS0001"] == 2 and len(states) == len(feed.stores())


def test_readers_of_versions_read_one_folder(spark, tmp_path):
    root = str(tmp_path / "versions")
    for number in range(3):
        tables.write_version(spark.range(number), root, f"run.{number}")
    newest = tables.newest_version(spark, root, "id bigint")
    assert newest.count() == 2 and len(newest.inputFiles()) >= 1
    assert all("batch=run.2" in file for file in newest.inputFiles())
    assert tables.newest_version(spark, root, "id bigint", but="run.2").count() == 1
    tables.write_version(spark.range(0), root, "run.3")
    assert tables.newest_version(spark, root, "id bigint").count() == 0


def test_an_empty_snapshot_replaces_the_last(spark, tmp_path):
    root = str(tmp_path)
    snapshots.publish(spark.createDataFrame([("a",)], "v string"), root, "contacts", dt.datetime(2024, 1, 1))
    snapshots.publish(spark.createDataFrame([], "v string"), root, "contacts", dt.datetime(2024, 1, 2))
    assert snapshots.read_latest(spark, root, "contacts").count() == 0


def test_last_contact_wins_in_file_order(spark, tmp_path):
    from tillsight.operators.enrich import contact_index

    head = "ContactID,PhoneNumber,ciudad\n"
    (tmp_path / "a.csv").write_text(head + "1,5500000001,old\n")
    (tmp_path / "b.csv").write_text(head + "".join(f"{i},55{i:08d},new\n" for i in range(1, 4000)))
    index = contact_index(csvfiles.read_contacts(spark, str(tmp_path)), star.LOOKUPS)
    assert index.filter("phone = '5500000001'").first().contact_city == "new"


def test_beacon_times_and_zero_scores(spark):
    from tillsight.operators import activity

    rows = [("a", "page_open", t) for t in (None, "", "  ", "no time", "2024-01-02 03:04:05")]
    beacons = spark.createDataFrame(rows, "agent string, event string, ts string").withColumn("detail", F.lit(None).cast("string"))
    got = sorted(r.ts for r in activity.accept_beacons(beacons, AS_OF).collect())
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5)] + [AS_OF] * 4
    assert activity.beacon_counts(beacons, AS_OF).first().asDict() == {"accepted": 5, "rejected": 0, "unreadable_times": 1}
    scores = spark.createDataFrame([(0,), (3,), (None,)], "score int")
    assert [r.score for r in activity.accept_checkins(scores, AS_OF).collect()] == ["", "3", ""]


def test_message_upload_twice(spark, tmp_path):
    path = str(tmp_path / "csv")
    rows = [("2024-01-01 10:00:00", "c1", "m1", "Incoming", "Text", "hi"),
            ("2023-01-01 10:00:00", "c1", "m2", "incoming", "text", "old"),
            ("", "c1", "m3", "incoming", "text", "no time"),
            ("2024-01-01 10:00:00", "c1", "", "incoming", "text", "no id")]
    names = ["`Date & Time`", "`Contact ID`", "`Message ID`", "`Message Type`", "`Content Type`", "Content"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).coalesce(1)
    csvfiles.write_csv(df, path)
    root = str(tmp_path / "root")
    for run in (1, 2):
        uploads.ingest_messages(spark, path, root, run, AS_OF, "u1")
    assert uploads.stored_messages(spark, root).count() == 2
    log = uploads.import_log(spark, root).orderBy("id").collect()
    # the second run finds the pruned message gone, takes it and prunes it again
    assert [(r.rows_total, r.rows_inserted, r.rows_skipped) for r in log] == [(4, 3, 1), (4, 1, 3)]
    kept = uploads.stored_messages(spark, root)  # the only chunk is the last one, so it pruned
    assert sorted(r.message_id for r in kept.collect()) == ["m1", "m3"]
    uploads.compact_messages(spark, root, str(tmp_path / "new"))
    assert sorted(r.message_id for r in uploads.stored_messages(spark, str(tmp_path / "new")).collect()) == ["m1", "m3"]


def test_only_the_last_chunk_prunes(spark, tmp_path):
    names = "`Date & Time` string, `Contact ID` string, `Message ID` string"
    root = str(tmp_path / "root")
    for index, row in enumerate([("2023-01-01 10:00:00", "c", "old"), ("2024-01-01 10:00:00", "c", "new")]):
        path = str(tmp_path / f"csv{index}")
        csvfiles.write_csv(spark.createDataFrame([row], names).coalesce(1), path)
        uploads.ingest_messages(spark, path, root, index, AS_OF, "u", index, 2)
        assert uploads.stored_messages(spark, root).count() == 1  # first "old", then "new" alone
    assert uploads.stored_messages(spark, root).first().message_id == "new"


def chunk(folder, upload, index, ids):
    path = folder / upload / f"{index}.csv"
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = ["ContactID,PhoneNumber,Assignee,ciudad"] + [f"{i},55{j:08d},,x{index}" for i, j in ids]
    path.write_text("\n".join(lines) + "\n")


def test_contact_chunks(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "root")
    chunk(folder, "u1", 0, [("a", 1), ("b", 2)])
    with pytest.raises(ValueError, match="got 1 of 2"):
        uploads.ingest_contacts(spark, str(folder), root, 1, AS_OF, "u1", 2)
    chunk(folder, "u1", 1, [("c", 3), ("a", 1)])
    uploads.ingest_contacts(spark, str(folder), root, 1, AS_OF, "u1", 2)
    snapshot = uploads.contact_snapshot(spark, root)
    order = [(r.contact_id, r.ciudad) for r in snapshot.orderBy("row_no").collect()]
    assert order == [("a", "x0"), ("b", "x0"), ("c", "x1"), ("a", "x1")]
    entries = uploads.import_log(spark, root)
    log = entries.filter("kind = 'contacts'").first()
    assert (log.rows_total, log.rows_skipped, log.total_chunks, log.details) == (4, 0, None, '{"newContacts":4}')
    parts = entries.filter("kind = 'contacts-chunk'").orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.total_chunks, r.rows_total, r.status) for r in parts] == [(0, 2, 0, "ok"), (1, 2, 0, "ok")]

    chunk(folder, "u2", 0, [("a", 1), ("z", 9)])
    uploads.ingest_contacts(spark, str(folder), root, 2, dt.datetime(2024, 2, 1), "u2", 1)
    assert sorted(r.contact_id for r in uploads.contact_snapshot(spark, root).collect()) == ["a", "z"]
    known = tables.read(spark, f"{root}/known_contacts", "contact_id string, first_seen timestamp")
    assert sorted(r.contact_id for r in known.collect()) == ["a", "b", "c", "z"]


def test_snapshot_rows_feed_the_contact_index(spark, tmp_path):
    from tillsight.operators.enrich import contact_index

    folder, root = tmp_path / "in", str(tmp_path / "root")
    chunk(folder, "u1", 0, [("a", 1)])
    chunk(folder, "u1", 1, [("b", 1)])
    uploads.ingest_contacts(spark, str(folder), root, 1, AS_OF, "u1", 2)
    index = contact_index(uploads.contact_snapshot(spark, root), star.LOOKUPS).collect()
    assert [(r.phone, r.contact_city) for r in index] == [("5500000001", "x1")]


def test_messages_of_other_uploads_are_not_counted_twice(spark):
    arrived = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "")], "arrival int, message_id string")
    stored = spark.createDataFrame([("b",)], "message_id string")
    c = messages.upload_counters(arrived, stored).first()
    assert (c.rows_total, c.rows_inserted, c.skipped_no_id, c.skipped_stored, c.skipped_repeated) == (4, 1, 1, 1, 1)
