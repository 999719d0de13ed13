"""Column expressions over literal values."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillsight.functions import rules, text, times
from tillsight.params import (
    PriorityCity,
    Lookups,
    Thresholds,
    customer_list_size,
    message_page_size,
    window_days,
)


def one(spark, expression, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return row.select(expression).first()[0]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("+52 1 220 765 4321", "2207654321"),
        ("2207654321", "2207654321"),
        ("(220) 765-4321", "2207654321"),
        ("1 2207654321", "2207654321"),
        ("12-34", None),
        ("", None),
        (None, None),
        ("no digits", None),
    ],
)
def test_phone(spark, raw, expected):
    value = F.lit(raw).cast("string")
    assert one(spark, text.normalize_phone(value)) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("2063VE-UNVA", "2063VE"),
        ("24/9133VE-UNVA", "9133VE"),
        ("8010BA", "8010BA"),
        ("a/b/c-d-e", "c"),
        ("A-24/B", "A"),
        ("  517VE \t", "517VE"),
        ("", ""),
        (None, ""),
    ],
)
def test_product_code(spark, raw, expected):
    assert one(spark, text.clean_product_code(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("12abc", 12.0), ("1.5", 1.5), (".5x", 0.5), ("-3", -3.0), ("+2.", 2.0), ("1e3", 1000.0),
        ("1e", 1.0), ("abc", 0.0), ("", 0.0), ("  7 ", 7.0), (None, 0.0), ("--1", 0.0),
    ],
)
def test_number_prefix(spark, raw, expected):
    assert one(spark, text.parse_number(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Cancún", "CANCUN"),
        ("Cancún", "CANCUN"),
        (" Mérida ", "MERIDA"),
        ("ÑANDÚ", "NANDU"),
        ("Playa del Carmen", "PLAYA DEL CARMEN"),
        ("Việt", "VIET"),
        ("", None),
        (None, None),
    ],
)
def test_city(spark, raw, expected):
    assert one(spark, text.normalize_city(F.lit(raw).cast("string"))) == expected


def test_priority_city_prefers_exact_then_first(spark):
    cities = [PriorityCity("NATION_1", "S1", 1), PriorityCity("NATION_12", "S2", 2), PriorityCity("N", "S3", 3)]

    def state(name):
        found = one(spark, rules.priority_city(F.lit(name).cast("string"), cities))
        return found and (found["state"], found["priority"])

    assert state("NATION_12") == ("S2", 2)
    assert state("NATION_13") == ("S1", 1)
    assert state("IN") == ("S3", 3)
    assert state("ELSE") is None
    assert state(None) is None


@pytest.mark.parametrize(
    "seller_rule, day, expected",
    [
        (None, dt.date(2020, 1, 1), "walkin"),
        ("always", None, "agent_online"),
        ("cutoff", dt.date(2026, 5, 2), "agent_online"),
        ("cutoff", dt.date(2026, 5, 3), "walkin"),
        ("cutoff", None, "walkin"),
    ],
)
def test_channel(spark, seller_rule, day, expected):
    channel = rules.sales_channel(
        F.lit(seller_rule).cast("string"), F.lit(day).cast("date"), Thresholds().seller_cutoff
    )
    assert one(spark, channel) == expected


@pytest.mark.parametrize(
    "lifetime, orders, expected",
    [(50_000, 1, "VIP"), (1, 15, "VIP"), (49_999, 14, "Regular"), (10_000, 1, "Regular"), (9_999, 1, "Casual")],
)
def test_tier(spark, lifetime, orders, expected):
    assert one(spark, rules.buyer_tier(F.lit(lifetime), F.lit(orders), Thresholds())) == expected


@pytest.mark.parametrize(
    "content, kind, expected",
    [
        (None, "text", ""),
        ("", "attachment", ""),
        ("hello image/png", "text", "hello image/png"),
        ('{"type":"Image/JPEG","url":"x"}', "ATTACHMENT", "[Image/JPEG]"),
        ('{"type":"application/pdf"}', "some_attachment", "[attachment]"),
        ("hello", None, "hello"),
    ],
)
def test_slim_content(spark, content, kind, expected):
    value = text.slim_content(F.lit(content).cast("string"), F.lit(kind).cast("string"))
    assert one(spark, value) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("2026-05-01 10:11:12", "2026-05-01 10:11:12"),
        (" 2026-05-01T10:11:12.5Z ", "2026-05-01 10:11:12"),
        ("2026-05-01T10:11:12+02:00", "2026-05-01 08:11:12"),
        ("2026-05-01", "2026-05-01 00:00:00"),
        ("01/05/2026 10:00", ""),
        ("10:00", ""),
        ("2026-13-01", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_message_time(spark, raw, expected):
    moment = times.parse_time(F.lit(raw).cast("string"))
    assert one(spark, times.format_time(moment)) == expected


def test_months_clamp_to_month_end(spark):
    cutoff = times.months_before(dt.datetime(2024, 8, 31, 5), 6)
    assert one(spark, times.format_time(cutoff)) == "2024-02-29 05:00:00"


def test_local_date_follows_summer_time(spark):
    def day(moment):
        return one(spark, times.local_date(times.instant(moment), "America/Mexico_City"))

    assert day(dt.datetime(2021, 7, 1, 4, 59)) == dt.date(2021, 6, 30)
    assert day(dt.datetime(2021, 7, 1, 5, 0)) == dt.date(2021, 7, 1)
    assert day(dt.datetime(2024, 7, 1, 5, 59)) == dt.date(2024, 6, 30)


def test_strip_takes_every_blank(spark):
    assert one(spark, text.strip(F.lit("﻿ \t a b  　\n"))) == "a b"


def test_first_non_empty(spark):
    value = text.first_non_empty(F.lit(None).cast("string"), F.lit(""), F.lit("x"))
    assert one(spark, value) == "x"


@pytest.mark.parametrize(
    "code, matches",
    [("31EC", True), ("31EC-M", True), ("31ECX", False), ("131EC", False), (None, None)],
)
def test_style_match(spark, code, matches):
    style = text.clean_style(F.lit(" 31ec! "))
    assert one(spark, text.matches_style(F.lit(code).cast("string"), style)) is matches


def test_clamps():
    assert (window_days(None), window_days(999)) == (7, 999)
    assert (message_page_size(None), message_page_size(10**6)) == (5000, 10**6)
    assert (customer_list_size(None), customer_list_size(20_000)) == (1000, 20_000)
    for size in (window_days, message_page_size, customer_list_size):
        with pytest.raises(ValueError):
            size(0)


def test_lookup_keys_must_be_unique():
    with pytest.raises(ValueError):
        Lookups(categories=(("EC", "a"), ("EC", "b")))
