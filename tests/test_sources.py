"""CSV files, JSON results, snapshots and store tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.operators import messages, purchases
from tillsight.sources import csvfiles, pos, snapshots, star


def write(path, content: str) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content.encode("utf-8"))
    return str(path)


def test_csv_shapes(spark, tmp_path):
    path = write(
        tmp_path / "c.csv",
        '﻿Contact ID,PhoneNumber,City,FirstName\r\n'
        '1,"220 765 4321","Nation ""1"", x","two\nlines"\r\n'
        "\r\n"
        "2,short\r\n"
        "3,p,c,n,extra\r\n",
    )
    got = csvfiles.read_contacts(spark, path).orderBy("row_no")
    values = [tuple(r) for r in got.select("contact_id", "phone", "ciudad", "first_name", "assignee").collect()]
    assert values == [
        ("1", "220 765 4321", 'Nation "1", x', "two\nlines", ""),
        ("2", "short", "", "", ""),
        ("3", "p", "c", "n", ""),
    ]


@pytest.mark.parametrize("duplicates, expected", [("first", "a"), ("last", "b")])
def test_duplicate_headers(spark, tmp_path, duplicates, expected):
    path = write(tmp_path / "d.csv", "id,Phone,phone\n1,a,b\n")
    df = csvfiles.read_csv(spark, path, {"phone": ("phone",)}, duplicates=duplicates)
    assert df.first()["phone"] == expected


def test_header_preference_is_list_order():
    found = csvfiles.resolve_headers(["mobile", " PHONE ", "id"], csvfiles.CONTACT_HEADERS)
    assert (found["phone"], found["contact_id"], found["ciudad"]) == (1, 2, None)


def test_required_headers(spark, tmp_path):
    path = write(tmp_path / "m.csv", "Message ID,Content\n1,x\n")
    with pytest.raises(ValueError, match="datetime, contact_id"):
        csvfiles.read_messages(spark, path)


def test_files_with_different_headers_are_refused(spark, tmp_path):
    write(tmp_path / "x" / "0.csv", "ContactID,Phone\n1,a\n")
    write(tmp_path / "x" / "1.csv", "Phone,ContactID\nb,2\n")
    with pytest.raises(Exception, match="header"):
        csvfiles.read_contacts(spark, str(tmp_path / "x")).collect()


def test_message_csv_to_rows(spark, tmp_path):
    path = write(
        tmp_path / "m.csv",
        "Date & Time,Contact ID,Message ID,Message Type,Content Type,Content\n"
        "2026-05-01 10:00:00, 7 , m1 ,INCOMING,Text,first\n"
        "bad,7,m1,incoming,text,again\n"
        "2026-05-01 11:00:00,7,,incoming,text,no id\n",
    )
    arrived = messages.normalize_messages(csvfiles.read_messages(spark, path))
    kept = messages.dedup_messages(arrived).collect()
    assert [(r.message_id, r.contact_id, r.message_type, r.content_raw, r.channel_id) for r in kept] == [
        ("m1", "7", "incoming", "first", "")
    ]


def test_csv_round_trip(spark, tmp_path):
    awkward = [("a,b", 'q"q', " pad ", "two\nlines"), ("", "", "", "")]
    df = spark.createDataFrame(awkward, "ContactID string, FirstName string, LastName string, ciudad string")
    csvfiles.write_csv(df, str(tmp_path / "out"))
    back = csvfiles.read_contacts(spark, str(tmp_path / "out"))
    got = {tuple(r) for r in back.select("contact_id", "first_name", "last_name", "ciudad").collect()}
    assert got == set(awkward)


def test_json_envelopes(spark):
    bodies = [
        ('[{"a": 1}, {"a": 2}]',),
        ('{"rows": [{"a": 3}], "data": [{"a": 99}]}',),
        ('{"recordset": [{"a": 4}]}',),
        ('{"data": [{"a": 5}]}',),
        ('{"rows": [], "data": [{"a": 98}]}',),
        ('{"error": "x"}',),
        ("not json",),
        (None,),
    ]
    df = spark.createDataFrame(bodies, "body string")
    row = T.StructType([T.StructField("a", T.IntegerType())])
    assert sorted(r.a for r in pos.envelope_rows(df, "body", row).collect()) == [1, 2, 3, 4, 5]


def test_canonical_lines_feed_the_cleaner(spark):
    rows = spark.createDataFrame(
        [("7", "2024-01-02T00:00:00", "1-URGENT ", "24/9EC-U", "", "brand", "2.5", "10.1x", "CA", "Ann",
          "+52 220 765 4321", "web")],
        "NO_REFEREN string, Fecha string, Vendedor string, Articulo string, Descripcion string, Marca string, "
        "Cantidad string, Precio_Venta string, PAGO2 string, CustCliente string, CustPhone string, CustGUIA string",
    )
    lines = pos.canonical_lines(rows, "TS0001")
    got = purchases.purchases_from_pos(lines, star.LOOKUPS, star.LIMITS).first()
    assert (got.phone, got.purchase_date, got.product_code, got.category) == (
        "2207654321", dt.date(2024, 1, 2), "9EC", "cat_a",
    )
    assert (got.product_name, got.qty, str(got.unit_price), str(got.line_total)) == ("brand", 3, "10.10", "25.25")


def test_numbers_that_do_not_fit_are_rejected(spark):
    lines = spark.createDataFrame(
        [("TS0001", "1", "9" * 15, "1"), ("TS0001", "2", "1", "1")],
        "store_code string, ticket_id string, qty string, unit_price string",
    ).selectExpr(
        "store_code", "ticket_id", "0L AS line_no", "'TK' AS movement", "DATE'2024-01-01' AS purchase_date",
        "'' AS seller", "'1EC' AS product_code_raw", "'' AS description", "'' AS brand", "qty", "unit_price",
        "'' AS payment_method", "'n' AS customer_name", "'2207654321' AS phone_raw", "'' AS lead_source",
    )
    cleaned = purchases.clean_lines(lines, star.LOOKUPS, star.LIMITS)
    assert [(r.ticket_id, r.reject_reason) for r in purchases.rejected(cleaned).collect()] == [
        ("1", purchases.NUMBER_OUT_OF_RANGE)
    ]
    assert [r.ticket_id for r in purchases.accepted(cleaned).collect()] == ["2"]


def test_jdbc_options_split_by_ticket():
    options = pos.jdbc_options("jdbc:x", "lines", "ticket", 0, 100, 8)
    assert options["partitionColumn"] == "ticket_number"
    assert options["numPartitions"] == "8"
    with pytest.raises(ValueError):
        pos.jdbc_options("jdbc:x", "lines", "ticket", 5, 5, 8)


def test_latest_snapshot(spark, tmp_path):
    root = str(tmp_path / "snap")
    for day, value in ((1, "old"), (2, "new")):
        snapshots.publish(
            spark.createDataFrame([(value,)], "v string"), root, "contacts", dt.datetime(2024, 1, day)
        )
    snapshots.publish(spark.createDataFrame([("other",)], "v string"), root, "orders", dt.datetime(2024, 1, 3))
    assert [r.v for r in snapshots.read_latest(spark, root, "contacts").collect()] == ["new"]


def test_latest_rows_break_ties_by_id(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [("contacts", at, "a", 1), ("contacts", at, "b", 2), ("x", at, "c", 3)],
        "kind string, uploaded_at timestamp, snapshot_id string, v int",
    )
    assert [r.v for r in snapshots.latest_rows(df, "contacts").collect()] == [2]


def test_splittable_reading_keeps_the_order(spark, tmp_path):
    path = write(tmp_path / "s.csv", "ContactID\n" + "".join(f"{i:06d}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = csvfiles.read_csv(spark, path, {"contact_id": ("ContactID",)}, quoted_line_breaks=False)
        assert df.rdd.getNumPartitions() > 1
        got = [r.contact_id for r in df.orderBy("row_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"{i:06d}" for i in range(5000)]


def test_additive_evolution_reads_missing_columns_as_null(spark, tmp_path):
    path = str(tmp_path / "old")
    spark.createDataFrame([("p",)], "phone string").write.parquet(path)
    row = spark.read.schema("phone string, sales_channel string").parquet(path).first()
    assert (row.phone, row.sales_channel) == ("p", None)


def test_marks_take_whole_tickets_and_pass_text_ids_on(spark):
    lines = spark.createDataFrame(
        [("A", "9"), ("A", "10"), ("A", "10"), ("A", "x"), ("B", "1"), ("C", "5")],
        "store_code string, ticket_id string",
    )
    got = purchases.after_marks(lines, {"A": 9, "B": None})
    assert sorted(tuple(r) for r in got.collect()) == [("A", "10"), ("A", "10"), ("A", "x"), ("B", "1")]
    marks = purchases.high_water_marks(got.filter(F.col("store_code") == "A")).first()
    assert (marks.last_ticket, marks.lines) == (10, 3)


def test_store_rules_reach_the_source_columns(spark, tmp_path, capsys):
    """Phone, name and movement are tested under the names that the source has."""
    columns = "NO_REFEREN string, CustPhone string, phone string, CustCliente string, Movimiento string, Articulo string"
    values = [
        ("1", "5511111111", None, "Ann", "TK", "a"), ("2", "", "5522222222", " ", "tk ", "b"), ("3", None, "", "Bob", "TK", "c"),
        ("4", " ", None, "Cid", "DV", "d"), ("5", "5533333333", "", "", None, "e"), ("6", "55", "1", None, "", "f"),
    ]
    path = str(tmp_path / "store")
    spark.createDataFrame(values, columns).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    for (store, rule), own in zip(star.LOOKUPS.store_rules, ("CustCliente", "Movimiento")):
        early = pos.source_lines(rows, store, rule)
        early.explain("formatted")
        pushed = capsys.readouterr().out.split("PushedFilters")[1]
        assert "IsNotNull(CustPhone)" in pushed and "Not(EqualTo(phone,))" in pushed and f"IsNotNull({own})" in pushed
        kept = purchases.scan_pos(early, star.LOOKUPS.store_rules).select("ticket_id", "phone_raw").collect()
        every = purchases.scan_pos(pos.canonical_lines(rows, store), star.LOOKUPS.store_rules).select("ticket_id", "phone_raw").collect()
        assert sorted(kept) == sorted(every) and kept and early.count() < rows.count()
