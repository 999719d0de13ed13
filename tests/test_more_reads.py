"""Single-phone reads, long key lists, all code points, rolling windows, mixed JSON."""

from __future__ import annotations

import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.functions import rules, text
from tillsight.operators import enrich, messages
from tillsight.params import PriorityCity
from tillsight.plans import lookup
from tillsight.sources import pos


def normal(name: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", name) if not "̀" <= c <= "ͯ")
    return plain


def test_every_code_point_decomposes_as_nfd(spark):
    points = [p for p in range(1, 0x110000) if not 0xD800 <= p <= 0xDFFF]
    # Neighbours on both sides show that nothing but the character itself changes.
    names = [f"x{chr(p)}y" for p in points]
    df = spark.createDataFrame([(n,) for n in names if unicodedata.normalize("NFD", n) != n or ord(n[1]) < 0x3000], "raw string")
    got = df.select("raw", text.normalize_city(F.col("raw")).alias("n"), F.upper(F.lit("ǰ")).alias("u")).collect()
    expected = spark.createDataFrame([(r.raw, normal(r.raw)) for r in got], "raw string, plain string")
    upper = {r.raw: r.u for r in expected.select("raw", text.strip(F.upper("plain")).alias("u")).collect()}
    assert len(got) > 12_000
    assert [r.raw for r in got if r.n != upper[r.raw]] == []


def test_hangul_name(spark):
    assert spark.range(1).select(text.normalize_city(F.lit("서울 각"))).first()[0] == unicodedata.normalize("NFD", "서울 각")


def test_match_cities_equals_the_chain_of_tests(spark):
    cities = [PriorityCity(k, f"s{n}", n % 3) for n, k in enumerate(["AB", "ABC", "B", "XYZ", "C D", "AB"])]
    names = ["ABC", "AB", "XABY", "B", "QB", "XYZ", "C D E", "", None, "none", "A B C", "ABXYZ"]
    keys = spark.createDataFrame([(c.key, n, c.state, c.priority) for n, c in enumerate(cities)], "key string, rank int, state string, priority int")
    rows = spark.createDataFrame([(n, name) for n, name in enumerate(names)], "n int, city string")
    got = {r.n: (r.state, r.priority) for r in enrich.match_cities(rows, "city", keys).collect()}
    chain = rows.select("n", rules.priority_city(F.col("city"), cities).alias("f")).collect()
    assert got == {r.n: (r.f.state, r.f.priority) if r.f else (None, None) for r in chain}
    none = enrich.match_cities(rows, "city", keys.limit(0)).collect()
    assert len(none) == len(names) and all(r.state is None for r in none)


def test_match_cities_has_no_theta_join(spark):
    keys = spark.range(10_000).select(
        F.concat(F.lit("K"), "id").alias("key"), F.col("id").alias("rank"), F.lit("s").alias("state"), F.lit(1).alias("priority")
    )
    rows = spark.range(2_000).select(F.concat(F.lit("IN K"), "id", F.lit(" X")).alias("city"))
    found = enrich.match_cities(rows, "city", keys)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("state = 's'").count() == 2_000


def test_single_phones_skip_row_groups(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.range(200_000).select(F.concat(F.lit("555"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("phone"), F.md5(F.col("id").cast("string")).alias("name"))
    lookup.publish(rows, path, 256 << 10)
    found = lookup.customers_of(spark, path, ["+52 555 000 0123", "55", "5550000123"])
    plan = found._jdf.queryExecution()
    assert "EqualTo(phone" in plan.executedPlan().toString()
    assert len(plan.executedPlan().executeCollectPublic()) == 1
    assert 0 < sum(_scan_rows(plan.executedPlan())) < 60_000
    assert lookup.customers_of(spark, path, ["5559999999", "", "5550000124"]).count() == 1


def _scan_rows(plan):
    """Output rows of every scan of a plan that has run."""
    if plan.nodeName().startswith("Scan"):
        yield plan.metrics().apply("numOutputRows").value()
    children = plan.children()
    for n in range(children.size()):
        yield from _scan_rows(children.apply(n))


def test_rolling_windows(spark):
    at = lambda d, h=12: dt.datetime(2024, 1, d, h)
    rows = [("a", at(1)), ("a", at(1)), ("b", at(1)), ("a", at(3)), ("c", at(9)), ("", at(9)), (None, at(9)), ("d", None)]
    df = spark.createDataFrame([(c, t) for c, t in rows], "contact_id string, datetime timestamp")
    got = {r.day.day: (r.messages, r.active_contacts) for r in messages.active_by_day(df, 7).collect()}
    assert got == {1: (3, 2), 3: (1, 2), 9: (3, 2)}
    assert messages.active_by_day(df.limit(0), 7).count() == 0


@pytest.mark.parametrize("size", [40_000])
def test_bitmaps_over_several_buckets(spark, size):
    df = spark.range(size).select(F.col("id").cast("string").alias("contact_id"), F.lit(dt.datetime(2024, 1, 1)).alias("datetime"))
    numbers = messages.dense_numbers(df.select("contact_id"), "contact_id")
    assert numbers.agg(F.min("number"), F.max("number"), F.count_distinct("number")).first()[:] == (0, size - 1, size)
    assert messages.active_by_day(df, 7).first().active_contacts == size


def test_mixed_json(spark):
    row = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    bodies = ['[{"a": 1, "b": "x"}, {"a": "q", "b": 2}]', '{"rows": [{"a": null}]}', '{"data": "no"}', "not json", None, "[]", "[3]", '{"recordset": [{"b": {}}]}']
    df = spark.createDataFrame([(n, b) for n, b in enumerate(bodies)], "n int, body string")
    got = [tuple(r) for r in pos.mixed_rows(df, "body", row, keep=["n"]).orderBy("n", "a").collect()]
    assert (0, 1, "x", None) in got and (0, None, "2", "type of a") in got and (1, None, None, None) in got
    assert [(n, why) for n, _, _, why in got if n in (2, 3, 4)] == [(2, "no rows"), (3, "no rows"), (4, "no rows")]
    assert not [r for r in got if r[0] == 5] and (6, None, None, "not an object") in got
    assert len([r for r in got if r[0] == 7]) == 1
