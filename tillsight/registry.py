"""The registered queries: every operator over the given tables.

Each query maps whole tables to its input (``sources.star``) and applies
operators with the test parameters. ``comparable`` only changes the types of the
result columns so that two engines can be compared value by value.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import rules, times
from .functions.text import normalize_city
from .operators import activity, contacts, customers, enrich, merge, messages, profiles, purchases, styles, uploads
from .params import customer_list_size, message_page_size, window_days
from .plans import ledger as ledger_plan
from .plans import sales as sales_plan
from .session import configure, scratch_path, small_tasks
from .sources import chunked, csvfiles, pos, snapshots, star
from .streaming import activity as activity_stream
from .streaming import messages as message_stream
from .streaming import sales as sales_stream

Query = Callable[[SparkSession, str], DataFrame]

CHAT_DAYS = window_days(7)
PAGE_SIZE = message_page_size(500)
LIST_SIZE = customer_list_size(200)
RETENTION_DAYS = 15
CURSOR = (dt.datetime(2024, 1, 29, 12), "m9")
STYLE = "18sm"
MARKS = {"TS0001": 1000, "TS0002": 2000}
STORED_BEFORE = dt.datetime(2024, 1, 10)

QUERIES: dict[str, Query] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Decimals as double, dates as ISO text, instants without zone."""
    columns = []
    for field in df.schema.fields:
        name = f"`{field.name}`"
        if isinstance(field.dataType, T.DecimalType):
            name = f"CAST({name} AS DOUBLE) AS {name}"
        elif isinstance(field.dataType, T.DateType):
            name = f"date_format({name}, 'yyyy-MM-dd') AS {name}"
        elif isinstance(field.dataType, T.TimestampType):
            name = f"CAST({name} AS TIMESTAMP_NTZ) AS {name}"
        columns.append(name)
    return df.selectExpr(*columns)


def query(function: Query) -> Query:
    """Register a query under the name of its function."""

    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return comparable(function(configure(spark), folder))

    QUERIES[function.__name__] = run
    return function


# Inputs shared by several queries.


def _cleaned(spark: SparkSession, folder: str) -> DataFrame:
    lines = purchases.scan_pos(star.pos_lines(spark, folder), star.LOOKUPS.store_rules)
    return purchases.clean_lines(lines, star.LOOKUPS, star.LIMITS)


def _purchases(spark: SparkSession, folder: str) -> DataFrame:
    """The purchases; the lines come by ticket, so they are not dealt anew to be de-duplicated."""
    small_tasks(spark)
    return purchases.purchases_from_pos(star.pos_lines(spark, folder, by_ticket=True), star.LOOKUPS, star.LIMITS)


STYLE_COLUMNS = (
    "phone", "ticket_id", "product_code", "qty", "line_total", "purchase_date", "agent_name", "raw_customer_name",
)


def _stored_purchases(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The purchases (some columns) as a written table, for queries that read them twice."""
    bought = _purchases(spark, folder).select(*(columns or ["*"]))
    path = scratch_path(spark, "purchases")
    bought.write.parquet(path)
    return spark.read.schema(bought.schema).parquet(path)


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    return customers.customer_360(_purchases(spark, folder), star.SALES_AS_OF, star.LIMITS)


def _base(bought: DataFrame) -> DataFrame:
    return customers.customer_base(bought, star.SALES_AS_OF, star.LIMITS)


def _enriched(spark: SparkSession, folder: str) -> DataFrame:
    summary, people = _summary(spark, folder), star.contacts(spark, folder)
    return enrich.flag_best_city(enrich.enrich_customers(summary, people, star.LOOKUPS), star.LOOKUPS)


def _flagged(spark: SparkSession, folder: str, bought: DataFrame) -> DataFrame:
    """Customer totals with city flags, for counts that need no favourites."""
    people = star.contacts(spark, folder)
    return enrich.flag_best_city(enrich.with_contact(_base(bought), people, star.LOOKUPS), star.LOOKUPS)


def _arrived(spark: SparkSession, folder: str) -> DataFrame:
    return messages.normalize_messages(star.raw_messages(spark, folder))


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return messages.dedup_messages(_arrived(spark, folder))


def _activity(spark: SparkSession, folder: str) -> DataFrame:
    return activity.accept_beacons(star.beacons(spark, folder), star.CHAT_AS_OF)


# Sales: scan, clean, de-duplicate.


@query
def pos_scan(spark: SparkSession, folder: str) -> DataFrame:
    return purchases.scan_pos(star.pos_lines(spark, folder), star.LOOKUPS.store_rules)


@query
def incremental_scan(spark: SparkSession, folder: str) -> DataFrame:
    return purchases.after_marks(pos_scan(spark, folder), MARKS)


@query
def high_water_marks(spark: SparkSession, folder: str) -> DataFrame:
    return purchases.high_water_marks(incremental_scan(spark, folder))


@query
def json_envelope_rows(spark: SparkSession, folder: str) -> DataFrame:
    row = T.StructType(
        [T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType())]
    )
    one = F.to_json(F.array(F.struct("event_id", "event_type")))
    shape = F.col("event_id") % 5

    def wrapped(name: str):
        return F.concat(F.lit(f'{{"{name}": '), one, F.lit("}"))

    body = (
        F.when(shape == 0, one)
        .when(shape == 1, wrapped("rows"))
        .when(shape == 2, wrapped("recordset"))
        .when(shape == 3, wrapped("data"))
        .otherwise(wrapped("other"))
    )
    bodies = star.table(spark, folder, "events").select(body.alias("body"))
    return pos.envelope_rows(bodies, "body", row)


@query
def purchases_clean(spark: SparkSession, folder: str) -> DataFrame:
    return purchases.accepted(_cleaned(spark, folder))


@query
def purchase_rejects(spark: SparkSession, folder: str) -> DataFrame:
    rejected = purchases.rejected(_cleaned(spark, folder))
    return rejected.select("store_code", "ticket_id", "line_no", "product_code_raw", "reject_reason")


@query
def purchases_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return purchases.purchases_from_pos(star.pos_lines(spark, folder), star.LOOKUPS, star.LIMITS)


@query
def purchases_dedup_by_size(spark: SparkSession, folder: str) -> DataFrame:
    key = ("store_code", "ticket_id", "product_code", "product_code_raw", "phone")
    return purchases.dedup_purchases(purchases.accepted(_cleaned(spark, folder)), key)


# Customers: roll-up, enrichment, statistics.


@query
def customer_360(spark: SparkSession, folder: str) -> DataFrame:
    return _summary(spark, folder)


@query
def customer_base(spark: SparkSession, folder: str) -> DataFrame:
    return _base(_purchases(spark, folder))


@query
def customer_base_per_store(spark: SparkSession, folder: str) -> DataFrame:
    bought = _purchases(spark, folder)
    base = customers.customer_base(bought, star.SALES_AS_OF, star.LIMITS, ticket_per_store=True)
    return base.select("phone", "total_orders", "total_online_orders", "total_walkin_orders")


@query
def favorites(spark: SparkSession, folder: str) -> DataFrame:
    return customers.favorites(_purchases(spark, folder))


@query
def customer_360_enriched(spark: SparkSession, folder: str) -> DataFrame:
    return _enriched(spark, folder)


@query
def customers_enriched(spark: SparkSession, folder: str) -> DataFrame:
    """The list is written once; only contacts of listed phones are indexed."""
    top = enrich.top_customers(_summary(spark, folder), LIST_SIZE)
    path = scratch_path(spark, "listed")
    top.write.parquet(path)
    listed = spark.read.schema(top.schema).parquet(path)
    people = enrich.listed_contacts(star.contacts(spark, folder), listed)
    return enrich.enrich_customers(listed, people, star.LOOKUPS)


@query
def customer_stats(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.customer_stats(_flagged(spark, folder, _purchases(spark, folder)))


@query
def agent_counts(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.agent_counts(customers_enriched(spark, folder), star.LOOKUPS)


@query
def agent_counts_all(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.agent_counts(_enriched(spark, folder), star.LOOKUPS)


@query
def contact_index(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.contact_index(star.contacts(spark, folder), star.LOOKUPS)


@query
def area_code_city(spark: SparkSession, folder: str) -> DataFrame:
    index = contact_index(spark, folder).select("phone")
    return enrich.with_area(index, star.LOOKUPS)


@query
def priority_city(spark: SparkSession, folder: str) -> DataFrame:
    cities = star.contacts(spark, folder).select("contact_id", F.initcap("ciudad").alias("city"))
    return enrich.flag_cities(cities, star.LOOKUPS.cities)


@query
def city_keys(spark: SparkSession, folder: str) -> DataFrame:
    """A key for every part against a city for every customer; longer keys contain shorter ones."""
    parts = star.table(spark, folder, "part")
    keys = parts.select(
        F.concat(F.lit("PLAZA "), F.col("p_partkey").cast("string")).alias("key"), (-F.col("p_size")).alias("rank"),
        F.concat(F.lit("S"), (F.col("p_partkey") % 7).cast("string")).alias("state"), (F.col("p_partkey") % 3).cast("int").alias("priority"),
    )
    number = F.when(F.col("c_custkey") % 10 == 0, F.lit("-")).otherwise((F.col("c_custkey") * 7).cast("string"))
    cities = star.table(spark, folder, "customer").select(
        "c_custkey", F.concat(F.lit("plàza "), number, F.when(F.col("c_custkey") % 4 > 0, F.lit(" norte")).otherwise(F.lit(""))).alias("raw")
    )
    cities = cities.withColumn("city", normalize_city(F.col("raw"))).drop("raw")
    return enrich.match_cities(cities, "city", keys)


@query
def customers_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return merge.upsert_customers(star.stored_customers(spark, folder), _summary(spark, folder))


@query
def sync_state_merge(spark: SparkSession, folder: str) -> DataFrame:
    runs = star.sync_runs(spark, folder)
    is_old = F.col("last_run_at") < F.lit("1998-01-01").cast("timestamp")
    stored = merge.sync_state(runs.filter(is_old))
    return merge.sync_state(stored.unionByName(runs.filter(~is_old)))


@query
def sync_status(spark: SparkSession, folder: str) -> DataFrame:
    bought = _stored_purchases(spark, folder)
    return enrich.sync_totals(bought, _flagged(spark, folder, bought))


@query
def sync_states(spark: SparkSession, folder: str) -> DataFrame:
    return sync_state_merge(spark, folder).orderBy("sync_key")


# Profiles and styles.


@query
def recent_purchases(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.recent_purchases(_purchases(spark, folder))


@query
def ticket_totals(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.ticket_totals(_purchases(spark, folder))


@query
def order_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.order_metrics(_base(_purchases(spark, folder)))


@query
def customer_profile(spark: SparkSession, folder: str) -> DataFrame:
    bought = _stored_purchases(spark, folder)
    profile = profiles.customer_profile(_base(bought), bought)
    recent = F.transform("recent_purchases", lambda p: F.concat_ws(":", p["ticket_id"], p["product_code"]))
    return profile.select(
        "phone", "name", "total_orders", "total_lifetime", "buyer_tier", "is_lapsed",
        "avg_order", "avg_days_between_orders", F.array_join(recent, ",").alias("recent"),
    )


@query
def profile_messages(spark: SparkSession, folder: str) -> DataFrame:
    return contacts.profile_messages(star.contacts(spark, folder), _messages(spark, folder))


@query
def style_buyers(spark: SparkSession, folder: str) -> DataFrame:
    bought = _stored_purchases(spark, folder, *STYLE_COLUMNS)
    return styles.style_buyers(bought, customers.customer_names(bought), STYLE)


@query
def style_totals(spark: SparkSession, folder: str) -> DataFrame:
    return styles.style_totals(style_buyers(spark, folder))


@query
def style_buyers_all(spark: SparkSession, folder: str) -> DataFrame:
    bought = _stored_purchases(spark, folder, *STYLE_COLUMNS)
    return styles.buyers_by_style(bought, customers.customer_names(bought))


@query
def style_totals_all(spark: SparkSession, folder: str) -> DataFrame:
    return styles.style_totals(style_buyers_all(spark, folder), ["style"])


# Messages and contacts.


@query
def messages_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return _messages(spark, folder)


@query
def messages_append(spark: SparkSession, folder: str) -> DataFrame:
    stored = _messages(spark, folder).filter(F.col("datetime") < F.lit(str(STORED_BEFORE)).cast("timestamp"))
    return messages.new_messages(_arrived(spark, folder), stored)


@query
def upload_counters(spark: SparkSession, folder: str) -> DataFrame:
    stored = _messages(spark, folder).filter(F.col("datetime") < F.lit(str(STORED_BEFORE)).cast("timestamp"))
    return messages.upload_counters(_arrived(spark, folder), stored)


@query
def retention_prune(spark: SparkSession, folder: str) -> DataFrame:
    cutoff = times.days_before(star.CHAT_AS_OF, RETENTION_DAYS)
    return messages.prune(_messages(spark, folder), cutoff)


@query
def retention_months(spark: SparkSession, folder: str) -> DataFrame:
    """Six calendar months before a day whose cutoff falls inside the data."""
    return messages.prune_months(_messages(spark, folder), dt.datetime(2024, 7, 15), 6)


@query
def message_page(spark: SparkSession, folder: str) -> DataFrame:
    return messages.message_page(_messages(spark, folder), star.CHAT_AS_OF, CHAT_DAYS, PAGE_SIZE, CURSOR)


@query
def message_page_cursor(spark: SparkSession, folder: str) -> DataFrame:
    return messages.page_cursor(message_page(spark, folder), PAGE_SIZE)


@query
def message_pages(spark: SparkSession, folder: str) -> DataFrame:
    return messages.message_pages(_messages(spark, folder), star.CHAT_AS_OF, CHAT_DAYS, PAGE_SIZE)


@query
def active_contacts(spark: SparkSession, folder: str) -> DataFrame:
    return messages.active_contacts(
        star.contacts(spark, folder), _messages(spark, folder), star.CHAT_AS_OF, CHAT_DAYS
    )


@query
def active_by_day(spark: SparkSession, folder: str) -> DataFrame:
    return messages.active_by_day(_messages(spark, folder), 7)


@query
def window_summary(spark: SparkSession, folder: str) -> DataFrame:
    return messages.window_summary(
        _messages(spark, folder),
        star.contacts(spark, folder),
        star.known_contacts(spark, folder),
        star.contact_uploads(spark, folder).select("uploaded_at"),
        star.CHAT_AS_OF,
        CHAT_DAYS,
    )


@query
def json_mixed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """JSON results of five events each, some with ill-typed values, rows or bodies."""
    row = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("ok", T.BooleanType())])
    key = F.col("event_id")
    flag = F.when(key % 4 == 0, F.lit("null")).when(key % 4 == 1, F.lit('"maybe"')).otherwise(F.lit("true"))
    number = F.when(key % 6 == 0, F.lit("[1]")).otherwise(key.cast("string"))
    one = F.when(key % 23 == 7, F.lit("17")).otherwise(
        F.concat(F.lit('{"event_id": '), number, F.lit(', "event_type": "'), F.col("event_type"), F.lit('", "ok": '), flag, F.lit("}"))
    )
    events = star.table(spark, folder, "events").select((key / 5).cast("bigint").alias("page"), key.alias("at"), one.alias("one"))
    pages = events.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("at", "one"))).alias("rows"))
    rows = F.array_join(F.transform("rows", lambda r: r["one"]), ", ")
    shape = F.col("page") % 5
    body = (
        F.when(shape == 0, F.concat(F.lit("["), rows, F.lit("]")))
        .when(shape == 1, F.concat(F.lit('{"rows": ['), rows, F.lit("]}")))
        .when(shape == 2, F.concat(F.lit('{"count": 3, "data": ['), rows, F.lit("]}")))
        .when(shape == 3, F.concat(F.lit('{"recordset": ['), rows, F.lit("]")))
        .otherwise(F.lit('{"rows": []}'))
    )
    return pos.mixed_rows(pages.select("page", body.alias("body")), "body", row, keep=["page"])


@query
def contacts_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts written as a CSV export with awkward values, and read back."""
    awkward = star.contacts(spark, folder).select(
        F.col("contact_id").alias("Contact ID"),
        F.col("phone").alias("PhoneNumber"),
        F.concat(F.lit('say "'), F.col("first_name"), F.lit('", then\nmore')).alias("FirstName"),
        F.concat(F.lit(" a,b "), F.col("lifecycle")).alias("Lifecycle"),
        F.col("assignee").alias("Assignee"),
        F.col("ciudad").alias("city"),
    )
    path = scratch_path(spark, "contacts-csv")
    csvfiles.write_csv(awkward, path)
    return csvfiles.read_contacts(spark, path).drop("file", "row_no")


@query
def assembled_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """Uploads of 400 contacts, cut after every fifth line of text, also inside quoted values."""
    pieces = star.contact_pieces(spark, folder)
    complete = contacts.assemble_rows(contacts.staged_chunks(pieces).drop("total_chunks", "received_at"), pieces)
    return chunked.read_contact_pieces(complete).drop("chunk_place", "line_no")


@query
def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.latest_rows(star.contact_uploads(spark, folder), "contacts")


@query
def new_contacts(spark: SparkSession, folder: str) -> DataFrame:
    return contacts.new_contacts(
        star.contacts(spark, folder), star.known_contacts(spark, folder), star.CHAT_AS_OF
    )


@query
def new_contact_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Contact ids of the message feed, which repeat, against the registry."""
    return contacts.new_contact_counts(
        star.raw_messages(spark, folder), star.known_contacts(spark, folder)
    )


@query
def staged_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return contacts.staged_chunks(star.staged_chunks(spark, folder))


@query
def chunk_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return contacts.chunk_manifest(star.staged_chunks(spark, folder))


# Activity and uploads.


@query
def activity_ingest(spark: SparkSession, folder: str) -> DataFrame:
    return _activity(spark, folder)


@query
def beacon_counts(spark: SparkSession, folder: str) -> DataFrame:
    return activity.beacon_counts(star.beacons(spark, folder), star.CHAT_AS_OF)


@query
def checkin_ingest(spark: SparkSession, folder: str) -> DataFrame:
    return activity.accept_checkins(star.checkins(spark, folder), star.CHAT_AS_OF)


@query
def activity_daily(spark: SparkSession, folder: str) -> DataFrame:
    return activity.daily_activity(_activity(spark, folder), star.CHAT_AS_OF, 40)


@query
def activity_today(spark: SparkSession, folder: str) -> DataFrame:
    return activity.today_activity(_activity(spark, folder), star.CHAT_AS_OF)


@query
def recent_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return activity.recent_sessions(_activity(spark, folder), star.CHAT_AS_OF)


@query
def log_entries(spark: SparkSession, folder: str) -> DataFrame:
    return uploads.log_entries(star.import_log(spark, folder))


@query
def upload_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return uploads.upload_sessions(star.import_log(spark, folder))


@query
def upload_sessions_all(spark: SparkSession, folder: str) -> DataFrame:
    return uploads.upload_sessions(star.import_log(spark, folder), limit=None)


# Streams: the feed lands in three uploads; after each one the stream is started
# again from its checkpoint and runs until nothing is left.


def _land(upload: DataFrame, landing: str) -> None:
    upload.write.mode("append").parquet(landing)


def _stream(spark: SparkSession, landing: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(landing)


@query
def stream_messages(spark: SparkSession, folder: str) -> DataFrame:
    feed = star.raw_messages(spark, folder)
    root = scratch_path(spark, "messages")
    arrival = F.col("arrival")
    bounds = feed.agg(F.max("arrival").alias("last")).first()["last"] or 0
    third = bounds // 3
    for part in (arrival <= third, (arrival > third) & (arrival <= 2 * third), arrival > 2 * third):
        _land(feed.filter(part), f"{root}/landing")
        source = _stream(spark, f"{root}/landing", feed.schema)
        message_stream.start_ingest(source, root, f"{root}/checkpoint").awaitTermination()
    return message_stream.stored_messages(spark, root)


def _written_lines(spark: SparkSession, folder: str, tracked: bool = False) -> DataFrame:
    """The ticket lines as a written table, for jobs that read them several times: joined once.

    With ``tracked`` they are those of the tracked stores, and the lines of a ticket lie together.
    """
    lines = star.pos_lines(spark, folder, by_ticket=tracked)
    if tracked:
        lines = lines.filter(rules.store_filter(star.LOOKUPS.store_rules))
    path = scratch_path(spark, "pos-lines")
    lines.write.parquet(path)
    return spark.read.schema(lines.schema).parquet(path)


def _sales_feed(spark: SparkSession, folder: str) -> sales_stream.SalesFeed:
    """Run the sales stream over three uploads, by store day, and return its tables."""
    lines = _written_lines(spark, folder)
    root = scratch_path(spark, "sales")
    feed = sales_stream.SalesFeed(root, star.LOOKUPS, star.LIMITS, star.SALES_AS_OF)
    day = F.col("purchase_date")
    first, second = F.lit(dt.date(1997, 1, 1)), F.lit(dt.date(1999, 6, 1))
    for part in (day < first, (day >= first) & (day < second), (day >= second) | day.isNull()):
        _land(lines.filter(part), f"{root}/landing")
        source = _stream(spark, f"{root}/landing", lines.schema)
        sales_stream.start_ingest(source, feed, f"{root}/checkpoint").awaitTermination()
    return feed


@query
def stream_purchases(spark: SparkSession, folder: str) -> DataFrame:
    return sales_stream.stored_purchases(spark, _sales_feed(spark, folder))


@query
def stream_customers(spark: SparkSession, folder: str) -> DataFrame:
    return sales_stream.current_customers(spark, _sales_feed(spark, folder))


@query
def stream_sync_state(spark: SparkSession, folder: str) -> DataFrame:
    return sales_stream.sync_state(spark, _sales_feed(spark, folder))


@query
def stream_activity_daily(spark: SparkSession, folder: str) -> DataFrame:
    events = _activity(spark, folder)
    root = scratch_path(spark, "activity")
    # The newest rows land first, so most of what follows is late.
    days = events.agg(F.min("ts").alias("a"), F.max("ts").alias("z")).first()
    step = (days["z"] - days["a"]) / 3
    first, second = F.lit(days["z"] - step), F.lit(days["a"] + step)
    moment = F.col("ts")
    for part in (moment >= first, (moment < first) & (moment >= second), moment < second):
        _land(events.filter(part), f"{root}/landing")
        source = _stream(spark, f"{root}/landing", events.schema)
        source = activity_stream.with_file(source)
        activity_stream.start_daily(source, f"{root}/daily", f"{root}/checkpoint").awaitTermination()
    return activity_stream.current_days(spark, f"{root}/daily")


def _sales_runs(spark: SparkSession, folder: str) -> sales_stream.SalesFeed:
    """The batch job three times: half of the lines, all of them, and all of them again."""
    lines = _written_lines(spark, folder, tracked=True)
    root = scratch_path(spark, "sales-runs")
    feed = sales_stream.SalesFeed(root, star.LOOKUPS, star.LIMITS, star.SALES_AS_OF)
    half = F.col("ticket_id").cast("bigint") % 2 == 0
    sales_plan.sync(lines.filter(half), feed, 1, by_ticket=True)
    sales_plan.sync(lines, feed, 2, reset=True, by_ticket=True)
    sales_plan.sync(lines, feed, 3, by_ticket=True)
    return feed


@query
def sync_states_after_runs(spark: SparkSession, folder: str) -> DataFrame:
    return sales_plan.status(spark, _sales_runs(spark, folder))[0]


@query
def sync_rejects_after_runs(spark: SparkSession, folder: str) -> DataFrame:
    feed = _sales_runs(spark, folder)
    return sales_stream.tables.read(spark, feed.path("rejects"), sales_stream.REJECTS).drop("batch")


def _ledger(spark: SparkSession, folder: str) -> ledger_plan.Ledger:
    """Two scans of the source, between which tickets were added, edited and removed."""
    ledger = ledger_plan.Ledger(scratch_path(spark, "ledger"), star.LOOKUPS, star.LIMITS, star.SALES_AS_OF)
    lines = _written_lines(spark, folder, tracked=True)
    ledger_plan.sync(star.first_scan(lines), ledger, 1, by_ticket=True)
    ledger_plan.sync(star.second_scan(lines), ledger, 2, by_ticket=True)
    return ledger


@query
def ticket_changes(spark: SparkSession, folder: str) -> DataFrame:
    """What the second scan found."""
    return ledger_plan.ticket_log(spark, _ledger(spark, folder)).filter("run_id = 2")


@query
def ledger_customers(spark: SparkSession, folder: str) -> DataFrame:
    """The customers after edits, equal to a roll-up of the second scan alone."""
    return ledger_plan.current_customers(spark, _ledger(spark, folder))
