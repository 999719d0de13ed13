"""The feeds of this package derived from a TPC-H-like star schema.

Used by the registered queries and the tests: each function maps whole given
tables to one input of the operators. All business values are synthetic.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import (
    ALWAYS_ONLINE,
    NAME_REQUIRED,
    ONLINE_BEFORE_CUTOFF,
    TICKET_ONLY,
    Lookups,
    PriorityCity,
    Thresholds,
)

SALES_AS_OF = dt.date(2001, 8, 2)
CHAT_AS_OF = dt.datetime(2024, 1, 31)

LIMITS = Thresholds(
    vip_lifetime=900_000,
    vip_orders=14,
    regular_lifetime=500_000,
    lapsed_days=180,
    seller_cutoff=dt.date(1998, 7, 1),
)

LOOKUPS = Lookups(
    store_rules=(("TS0001", NAME_REQUIRED), ("TS0002", TICKET_ONLY)),
    categories=(("EC", "cat_a"), ("SM", "cat_b"), ("LA", "cat_c")),
    sellers=(
        ("1-URGENT", "A1", ALWAYS_ONLINE),
        ("2-HIGH", "A2", ALWAYS_ONLINE),
        ("3-MEDIUM", "A3", ONLINE_BEFORE_CUTOFF),
    ),
    agents=(("building@example.com", "A1"), ("machinery@example.com", "A2")),
    areas=tuple((str(code), f"city_{code}", f"state_{code % 4}") for code in range(220, 236))
    + (("24", "city_24", "state_24"),),
    cities=(
        PriorityCity("NATION_1", "S1", 1),
        PriorityCity("NATION_12", "S2", 2),
        PriorityCity("NATION_2", "S3", 3),
    ),
)


# Columns of the given tables that are read. Reading with a schema
# saves a job per table that would only infer it.
COLUMNS = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_returnflag string, l_linestatus string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{folder}/{name}.parquet")


# A phone with country code and blanks; every seventeenth customer has none.
PHONE = """CASE WHEN c_custkey % 17 = 0 THEN '12-34'
    ELSE concat('+52 1 ', CAST(220 + c_nationkey AS STRING), ' ',
                lpad(CAST(c_custkey DIV 2 AS STRING), 7, '0')) END"""


def _phone() -> Column:
    return F.expr(PHONE)


def pos_lines(spark: SparkSession, folder: str, by_ticket: bool = False) -> DataFrame:
    """Point-of-sale ticket lines: one per line item.

    Orders and customers are joined first, so line items meet two large tables
    (order keys, part keys) and not three. With ``by_ticket`` the last join is on the
    ticket as the lines carry it, so that large tables leave it dealt by ticket: what
    is grouped by a key that holds the ticket needs no shuffle of its own then.
    """
    tickets = (
        table(spark, folder, "orders")
        .join(table(spark, folder, "customer"), F.expr("o_custkey = c_custkey"))
        .filter("o_orderkey IS NOT NULL")
        .selectExpr(
            "o_orderkey",
            "coalesce(CAST(o_orderkey AS STRING), '') AS ticket_id",
            "CAST(o_orderdate AS DATE) AS purchase_date",
            "o_orderpriority AS seller",
            "c_name AS customer_name",
            f"{PHONE} AS phone_raw",
            "c_mktsegment AS lead_source",
        )
    )
    same_ticket = "line_ticket = ticket_id" if by_ticket else "l_orderkey = o_orderkey"
    # Texts that tests and sorts need are made where there are the fewest rows, or once before a join.
    stores = table(spark, folder, "supplier").selectExpr(
        "s_suppkey", "concat('TS000', CAST(s_nationkey % 3 + 1 AS STRING)) AS store_code"
    )
    sold = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey",
        "CAST(l_orderkey AS STRING) AS line_ticket",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        "CASE WHEN l_returnflag = 'R' THEN 'DV' ELSE 'TK' END AS movement",
        "concat(l_returnflag, l_linestatus) AS payment_method",
    )
    # The style stands for three columns of the part, so the lines are dealt by ticket with less.
    parts = table(spark, folder, "part").selectExpr(
        "p_partkey",
        "p_name",
        "p_brand",
        "concat(CAST(p_size AS STRING), '/', CAST(p_partkey % 200 AS STRING), upper(left(p_type, 2))) AS style",
        "CAST(p_retailprice AS DECIMAL(12,2)) AS unit_price",
    )
    return (
        sold.join(stores, F.expr("l_suppkey = s_suppkey"))
        .join(parts, F.expr("l_partkey = p_partkey"))
        .join(tickets, F.expr(same_ticket))
        .selectExpr(
            "store_code",
            "ticket_id",
            "CAST(l_linenumber AS BIGINT) AS line_no",
            "movement",
            "purchase_date",
            "seller",
            "concat(style, '-', CAST(l_linenumber AS STRING)) AS product_code_raw",
            "p_name AS description",
            "p_brand AS brand",
            "CAST(l_quantity AS DECIMAL(12,2)) AS qty",
            "unit_price",
            "payment_method",
            "customer_name",
            "phone_raw",
            "lead_source",
        )
    )


def first_scan(lines: DataFrame) -> DataFrame:
    """The ticket lines as an earlier scan saw them: some tickets had not been written yet."""
    return lines.filter("CAST(ticket_id AS BIGINT) % 13 <> 5")


def second_scan(lines: DataFrame) -> DataFrame:
    """A later scan: some old tickets are gone, some have other quantities, dates or phones, some lost a line."""
    number = "CAST(ticket_id AS BIGINT)"
    return lines.filter(f"{number} % 11 <> 3 AND ({number} % 19 <> 8 OR line_no <> 1)").withColumns(
        {
            "qty": F.expr(f"CAST(CASE WHEN {number} % 7 = 2 THEN qty + 1 ELSE qty END AS DECIMAL(12,2))"),
            "purchase_date": F.expr(f"CASE WHEN {number} % 17 = 4 THEN date_add(purchase_date, 40) ELSE purchase_date END"),
            "phone_raw": F.expr(f"CASE WHEN {number} % 23 = 6 THEN '5599999999' ELSE phone_raw END"),
        }
    )


def contacts(spark: SparkSession, folder: str) -> DataFrame:
    """A contact snapshot: one row per customer, in key order."""
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return (
        table(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("row_no"),
            F.col("c_custkey").cast("string").alias("contact_id"),
            _phone().alias("phone"),
            F.when(F.col("c_custkey") % 5 == 0, F.lit(""))
            .otherwise(F.concat(F.lower("c_mktsegment"), F.lit("@example.com")))
            .alias("assignee"),
            F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("n_name")).alias("ciudad"),
            F.col("c_mktsegment").alias("lifecycle"),
            F.col("c_name").alias("first_name"),
            F.lit("").alias("last_name"),
        )
    )


def contact_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """CSV uploads of 400 contacts each in pieces of five lines of text, some sent twice.

    Names hold quotes, commas and line ends, so pieces end inside quoted values. Every
    ninth upload lacks its last piece.
    """
    row = F.concat_ws(
        ",", "contact_id", F.concat(F.lit('"say ""'), "first_name", F.lit('"", then\r\nmore\n""\n"')), "phone",
        "lifecycle", "assignee", F.concat(F.lit('"'), "ciudad", F.lit('"')),
    )
    lines = contacts(spark, folder).select(
        F.floor(F.col("row_no") / 400).alias("upload"), "row_no", F.posexplode(F.split(row, "\n", -1)).alias("part", "line")
    )
    own = Window.partitionBy("upload").orderBy("row_no", "part")
    cut = lines.withColumn("chunk_index", F.floor((F.row_number().over(own) - 1) / 5).cast("int"))
    texts = cut.groupBy("upload", "chunk_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "part", "line"))), lambda p: p["line"]), "\n").alias("body")
    )
    header = F.lit("Contact ID, firstname ,PhoneNumber,Lifecycle,Assigned Agent,City\n")
    total = F.max("chunk_index").over(Window.partitionBy("upload")) + 1
    sent = texts.select(
        F.concat(F.lit("u"), F.col("upload").cast("string")).alias("upload_id"), "chunk_index", total.cast("int").alias("total_chunks"),
        F.concat(header, "body").alias("csv_text"),
    )
    sent = sent.where((F.substring("upload_id", 2, 20).cast("bigint") % 9 != 8) | (F.col("chunk_index") < F.col("total_chunks") - 1))
    at = F.lit(str(CHAT_AS_OF)).cast("timestamp")
    early = sent.where("chunk_index % 7 = 3").withColumns({"csv_text": F.lit("an earlier try"), "received_at": at - F.expr("INTERVAL 1 DAY")})
    return sent.withColumn("received_at", at).unionByName(early)


def contact_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Contact rows of three snapshots, uploaded on three days."""
    part = (F.col("row_no") % 3).cast("int")
    return contacts(spark, folder).withColumns(
        {
            "kind": F.lit("contacts"),
            "snapshot_id": F.concat(F.lit("s"), part.cast("string")),
            "uploaded_at": F.lit(str(CHAT_AS_OF)).cast("timestamp") - F.make_dt_interval(part),
        }
    )


def known_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """The first-seen registry: every fourth customer."""
    key = F.col("c_custkey")
    age = F.make_dt_interval(F.lit(0), (key % 48).cast("int"))
    return (
        table(spark, folder, "customer")
        .filter(key % 4 == 0)
        .select(
            key.cast("string").alias("contact_id"),
            (F.lit(str(CHAT_AS_OF)).cast("timestamp") - age).alias("first_seen"),
        )
    )


def stored_customers(spark: SparkSession, folder: str) -> DataFrame:
    """An earlier customer table: one row per valid phone, with old totals."""
    from ..functions.text import normalize_phone

    valid = (
        table(spark, folder, "customer")
        .select(normalize_phone(_phone()).alias("phone"), "c_custkey", "c_name")
        .filter(F.col("phone").isNotNull())
    )
    key = F.max("c_custkey")
    nothing = F.lit(None)
    return valid.groupBy("phone").agg(
        F.max("c_name").alias("name"),
        F.when(key % 2 == 0, F.lit("OLD CITY")).alias("city"),
        F.when(key % 2 == 0, F.lit("S9")).alias("state"),
        (key % 2 == 0).alias("is_priority_city"),
        F.when(key % 2 == 0, F.lit(3)).alias("city_priority_score"),
        F.lit(1).cast("bigint").alias("total_orders"),
        F.lit(10).cast("decimal(28,2)").alias("total_lifetime"),
        F.lit(1).cast("bigint").alias("total_online_orders"),
        F.lit(10).cast("decimal(28,2)").alias("total_online"),
        F.lit(0).cast("bigint").alias("total_walkin_orders"),
        F.lit(0).cast("decimal(28,2)").alias("total_walkin"),
        F.lit(dt.date(1995, 1, 1)).alias("first_purchase_date"),
        F.lit(dt.date(1995, 1, 1)).alias("last_purchase_date"),
        F.lit(1).alias("days_since_last_purchase"),
        nothing.cast("string").alias("favorite_category"),
        F.lit("OLD").alias("favorite_product"),
        F.lit("TS0001").alias("favorite_store"),
        nothing.cast("string").alias("favorite_seller"),
        nothing.cast("string").alias("favorite_agent"),
        nothing.cast("string").alias("favorite_payment"),
        nothing.cast("string").alias("top_lead_source"),
        F.lit("Casual").alias("buyer_tier"),
        F.lit(False).alias("is_lapsed"),
        F.lit("1995-01-02").cast("timestamp").alias("last_synced_at"),
        F.lit("1995-01-02").cast("timestamp").alias("created_at"),
    )




def raw_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Chat messages as they arrive: one per event, five percent with a repeated id."""
    key = F.col("event_id")
    message = F.when(key % 20 == 19, key - 1).otherwise(key)
    is_file = F.col("event_type") == "error"
    file_type = F.when(key % 2 == 0, F.lit("image/jpeg")).otherwise(F.lit("application/pdf"))
    return table(spark, folder, "events").select(
        key.alias("arrival"),
        F.concat(F.lit("m"), message.cast("string")).alias("message_id"),
        F.col("user_id").cast("string").alias("contact_id"),
        F.when(key % 97 != 0, F.col("ts").cast("timestamp")).alias("datetime"),
        F.when(F.col("event_type").isin("click", "view"), F.lit("Incoming"))
        .otherwise(F.lit("Outgoing"))
        .alias("message_type"),
        F.when(is_file, F.lit("Attachment")).otherwise(F.lit("Text")).alias("content_type"),
        F.when(is_file, F.concat(F.lit('{"type": "'), file_type, F.lit('"}')))
        .otherwise(F.concat_ws(" ", "event_type", "props"))
        .alias("content_raw"),
        F.lit("").alias("sender_type"),
        F.lit("").alias("channel_id"),
        F.lit("").alias("type_field"),
        F.lit("").alias("sub_type"),
    )


def beacons(spark: SparkSession, folder: str) -> DataFrame:
    """Raw activity beacons: padded, some without an agent, some without a time."""
    key = F.col("event_id")
    names = {
        "view": "page_open",
        "click": "tab_click",
        "purchase": "whatsapp_click",
        "error": "heartbeat",
        "signup": "session_end",
    }
    event = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in names.items()])
    agent = F.concat(F.lit(" agent_"), (F.col("user_id") % 4).cast("string"), F.lit(" \t"))
    return table(spark, folder, "events").select(
        F.when(key % 50 == 0, F.lit("  ")).otherwise(agent).alias("agent"),
        event.alias("event"),
        F.col("props").alias("detail"),
        F.when(key % 31 != 0, F.col("ts").cast("timestamp")).alias("ts"),
    )


def checkins(spark: SparkSession, folder: str) -> DataFrame:
    """Agent check-ins: one per conversation turn, with fields left out."""
    turn = F.col("turn")
    return table(spark, folder, "conversations").select(
        F.when(turn % 2 == 0, F.col("role")).alias("agent"),
        F.col("conv_id").cast("string").alias("contact_id"),
        F.when(turn > 0, F.lit("called")).alias("action"),
        F.col("text").alias("notes"),
        turn.alias("score"),
    )


def import_log(spark: SparkSession, folder: str) -> DataFrame:
    """Upload log: one row per order."""
    total = F.col("o_orderkey") % 1000
    inserted = F.floor(total * 3 / 4).cast("bigint")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(status == "P", F.lit("contacts"))
        .when(status == "F", F.lit("messages"))
        .when(status == "O", F.lit("contacts-chunk"))
        .alias("kind"),
        F.lit("csv").alias("source"),
        F.when(F.col("o_custkey") % 10 != 0, F.concat(F.lit("u"), F.col("o_custkey").cast("string"))).alias(
            "upload_id"
        ),
        (F.col("o_orderkey") % 5).cast("int").alias("chunk_index"),
        F.lit(5).alias("total_chunks"),
        total.alias("rows_total"),
        inserted.alias("rows_inserted"),
        (total - inserted).alias("rows_skipped"),
        F.when(priority == "5-LOW", F.lit("error")).when(priority != "1-URGENT", F.lit("ok")).alias("status"),
        F.lit(None).cast("string").alias("details"),
        F.col("o_orderdate").cast("timestamp").alias("performed_at"),
    )


def staged_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of uploads, some sent twice, some missing: one per order."""
    return table(spark, folder, "orders").select(
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("upload_id"),
        (F.col("o_orderkey") % 4).cast("int").alias("chunk_index"),
        (F.col("o_custkey") % 4 + 1).cast("int").alias("total_chunks"),
        F.col("o_orderdate").cast("timestamp").alias("received_at"),
    )


def sync_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Finished pulls: one per store and day, with the lines pulled that day."""
    lines = table(spark, folder, "orders")
    return lines.groupBy(
        F.concat(F.lit("sales_sync_TS000"), (F.col("o_custkey") % 2 + 1).cast("string")).alias("sync_key"),
        F.col("o_orderdate").cast("timestamp").alias("last_run_at"),
    ).agg(
        F.max("o_orderkey").cast("string").alias("last_cursor"),
        F.count(F.lit(1)).alias("rows_synced"),
        F.lit("complete").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
    )
