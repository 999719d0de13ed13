"""Ticket lines: scan, clean, reject, de-duplicate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules, text
from ..params import Lookups, Thresholds
from ..schemas import PURCHASES, column_names
from .keep import keep_first, not_in

# The ticket comes first: sorts compare the first column most cheaply, and it is
# the most selective one.
PURCHASE_KEY = ("ticket_id", "product_code", "phone", "store_code")

PHONE_INVALID = "phone_invalid"
TICKET_INVALID = "ticket_invalid"
NUMBER_OUT_OF_RANGE = "number_out_of_range"


def scan_pos(lines: DataFrame, store_rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Lines of the tracked stores that carry a phone."""
    return lines.filter(rules.store_filter(store_rules) & rules.phone_present(F.col("phone_raw")))


def ticket_number(ticket: Column) -> Column:
    """A ticket's number; null unless it is a whole number that is not negative."""
    number = ticket.try_cast("bigint")
    return F.when(number >= 0, number)


def after_marks(lines: DataFrame, marks: Mapping[str, int | None]) -> DataFrame:
    """Lines of each store with a ticket number above the store's high-water mark.

    Whole tickets are taken and nothing is paged; a store without a mark gives all its
    lines. Lines whose ticket has no number
    come along; ``rejected`` keeps them, with the reason.
    """
    ticket = ticket_number(F.col("ticket_id"))
    wanted = F.lit(False)
    for store, mark in marks.items():
        above = F.lit(True) if mark is None else ticket.isNull() | (ticket > F.lit(int(mark)))
        wanted = wanted | ((F.col("store_code") == store) & above)
    return lines.filter(F.col("store_code").isin(list(marks)) & wanted)


def high_water_marks(lines: DataFrame) -> DataFrame:
    """Per store: the new mark and the number of lines behind it."""
    return lines.groupBy("store_code").agg(
        F.max(ticket_number(F.col("ticket_id"))).alias("last_ticket"),
        F.count(F.lit(1)).alias("lines"),
    )


def _number(lines: DataFrame, name: str) -> Column:
    if isinstance(lines.schema[name].dataType, T.StringType):
        return text.parse_number(F.col(name))
    return F.coalesce(F.col(name), F.lit(0).cast(lines.schema[name].dataType))


def clean_lines(lines: DataFrame, lookups: Lookups, limits: Thresholds, numbered: bool = False) -> DataFrame:
    """Every scanned line in table form; see ``accepted`` and ``rejected``.

    The line total is computed from the unrounded quantity and price. A phone or
    number that does not fit its column is NULL instead of failing the job. No ticket
    of ``numbered`` lines is missing: the column stays as it is, and so does what is
    known about how the lines are dealt by it.
    """
    spark = lines.sparkSession
    qty, unit = _number(lines, "qty"), _number(lines, "unit_price")
    base = lines.select(
        text.normalize_phone(F.col("phone_raw")).alias("phone"),
        "purchase_date",
        "store_code",
        text.stripped("seller").alias("seller"),
        "ticket_id" if numbered else text.or_empty(F.col("ticket_id")).alias("ticket_id"),
        "line_no",
        "product_code_raw",
        text.clean_product_code(F.col("product_code_raw")).alias("product_code"),
        text.first_non_empty(text.stripped("description"), text.stripped("brand")).alias("product_name"),
        F.round(qty).try_cast("int").alias("qty"),
        unit.try_cast("decimal(12,2)").alias("unit_price"),
        (qty * unit).try_cast("decimal(12,2)").alias("line_total"),
        text.stripped("payment_method").alias("payment_method"),
        text.stripped("lead_source").alias("lead_source"),
        text.stripped("customer_name").alias("raw_customer_name"),
        F.lit("").alias("raw_city"),
    )
    keyed = base.withColumns(
        {
            "seller_key": F.upper("seller"),
            "suffix": text.category_suffix(F.col("product_code")),
        }
    )
    known = keyed.join(lookups.seller_frame(spark), "seller_key", "left").join(
        lookups.category_frame(spark), "suffix", "left"
    )
    channel = rules.sales_channel(F.col("channel_rule"), F.col("purchase_date"), limits.seller_cutoff)
    return known.withColumn("sales_channel", channel).drop("seller_key", "suffix", "channel_rule")


NUMBERS = ("qty", "unit_price", "line_total")


def accepted(lines: DataFrame) -> DataFrame:
    """Lines with a phone, a ticket number and numbers that fit; each test can reach its own scan."""
    lines = lines.filter(ticket_number(F.col("ticket_id")).isNotNull())
    for name in ("phone", *NUMBERS):
        lines = lines.filter(F.col(name).isNotNull())
    return lines


def rejected(lines: DataFrame) -> DataFrame:
    """The other lines, with the reason."""
    bad_number = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in NUMBERS])
    bad_ticket = ticket_number(F.col("ticket_id")).isNull()
    reason = (
        F.when(F.col("phone").isNull(), F.lit(PHONE_INVALID))
        .when(bad_number, F.lit(NUMBER_OUT_OF_RANGE))
        .when(bad_ticket, F.lit(TICKET_INVALID))
    )
    return lines.withColumn("reject_reason", reason).filter(F.col("reject_reason").isNotNull())


def dedup_purchases(lines: DataFrame, key: Sequence[str] = PURCHASE_KEY) -> DataFrame:
    """First line per key in ticket order.

    The default key holds the cleaned code, so two sizes of a style on one
    ticket become one line; add ``product_code_raw`` to the key to keep both.
    Equal line numbers are ordered by the remaining columns.
    """
    rest = [c for c in ("product_code_raw", *column_names(PURCHASES)) if c not in key]
    return keep_first(lines, key, ["line_no", *rest]).select(*column_names(PURCHASES))


def new_purchases(lines: DataFrame, table: DataFrame) -> DataFrame:
    """De-duplicated lines whose key the purchase table does not have."""
    return not_in(dedup_purchases(lines), table, PURCHASE_KEY)


REJECT_KEY = ("store_code", "ticket_id", "line_no", "product_code_raw", "reject_reason")


def new_rejects(lines: DataFrame, table: DataFrame) -> DataFrame:
    """Rejected lines, each once, that the reject table does not have; missing values are equal."""
    bad = rejected(lines).select(*REJECT_KEY).distinct()
    stored = table.select(*[F.col(c).alias(f"_{c}") for c in REJECT_KEY])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in REJECT_KEY])
    return bad.join(stored, same, "left_anti")


def purchases_from_pos(lines: DataFrame, lookups: Lookups, limits: Thresholds) -> DataFrame:
    """Scan, clean and de-duplicate in one lazy plan."""
    scanned = scan_pos(lines, lookups.store_rules)
    return dedup_purchases(accepted(clean_lines(scanned, lookups, limits)))
