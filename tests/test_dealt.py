"""Tables dealt by a key: no shuffle when they are read again, and the same rows however they were dealt."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillsight.operators import changes, customers, purchases
from tillsight.plans import ledger as ledger_plan
from tillsight.plans import sales
from tillsight.schemas import POS_LINES, PURCHASES
from tillsight.session import SUBSET
from tillsight.sources import star
from tillsight.streaming import tables
from tillsight.streaming.sales import SalesFeed


def lines_of(spark, tickets):
    """(ticket, phone) as two ticket lines each; the ticket and the phone may be missing."""
    values = [
        ("TS0001", t, n, "TK", dt.date(2024, 1, 1 + n), "1-URGENT", f"1/{n}EC", "d", "b", Decimal(n), Decimal(10), "CA", f"name {p}", p, "web")
        for t, p in tickets
        for n in (1, 2)
    ]
    return spark.createDataFrame(values, POS_LINES)


def tickets(first, last):
    """Half of the tickets belong to one phone."""
    return [(str(n), "5500000000" if n % 2 else f"55111111{10 + n % 50}") for n in range(first, last)]


ODD = [(None, "5511111111"), ("", "5511111111"), ("A1", "5511111111"), ("7", "12"), ("8", None)]


def same(a, b):
    b = b.select(*a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture
def partitions(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    yield lambda number: spark.conf.set(name, str(number))
    spark.conf.set(name, before)


def plan_of(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.fixture
def feed(tmp_path):
    return SalesFeed(str(tmp_path / "sales"), star.LOOKUPS, star.LIMITS, star.SALES_AS_OF)


def recomputed(lines):
    return customers.customer_360(purchases.purchases_from_pos(lines, star.LOOKUPS, star.LIMITS), star.SALES_AS_OF, star.LIMITS)


@pytest.mark.parametrize("by_ticket", [False, True])
def test_runs_equal_a_roll_up_of_all_lines(spark, feed, partitions, by_ticket):
    first = lines_of(spark, tickets(0, 200) + ODD)
    both = lines_of(spark, tickets(0, 400) + ODD)
    sales.sync(first, feed, 1, by_ticket=by_ticket)
    partitions(7)  # other buckets than those of the first run
    for _ in range(2):
        sales.sync(both, feed, 2, reset=True, by_ticket=by_ticket)
    sales.sync(both, feed, 3, by_ticket=by_ticket)
    expected = recomputed(both)
    same(sales.stored_customers(spark, feed).select(*expected.columns), expected)
    assert tables.read(spark, feed.path("purchases"), PURCHASES).count() == purchases.purchases_from_pos(both, star.LOOKUPS, star.LIMITS).count()
    assert spark.conf.get(SUBSET) == "true"


def test_a_run_that_died_before_it_dealt_its_purchases_is_counted(spark, feed, monkeypatch):
    def die(*args):
        raise RuntimeError("dead")

    with monkeypatch.context() as broken:
        broken.setattr(sales, "refresh_customers", die)
        with pytest.raises(RuntimeError):
            sales.sync(lines_of(spark, tickets(0, 100)), feed, 1)
    both = lines_of(spark, tickets(0, 150))
    sales.sync(both, feed, 2, reset=True)
    expected = recomputed(both)
    same(sales.stored_customers(spark, feed).select(*expected.columns), expected)


def test_roll_ups_and_known_keys_do_not_shuffle_lines(spark, feed, capsys):
    sales.sync(lines_of(spark, tickets(0, 200)), feed, 1, by_ticket=True)
    known, plain = sales.bought_by_phone(spark, feed)
    assert plan_of(customers.customer_360(known, feed.as_of, feed.limits), capsys).count("Exchange") == 0
    often = customers.frequent_phones(plain)
    assert "5500000000" in often
    # Only the lines of frequent phones, by value and by phone.
    often = F.col("phone").isin(["5500000000"])
    apart = customers.customer_360(known.filter(~often), feed.as_of, feed.limits, apart=plain.filter(often))
    assert plan_of(apart, capsys).count("Exchange") == 2
    landed = tables.read_by(spark, "ticket_id", feed.path("lines"), PURCHASES + ", line_no bigint, product_code_raw string", ["run.000000000001"])
    assert plan_of(purchases.dedup_purchases(purchases.accepted(landed)), capsys).count("Exchange") == 0


def test_ledger_joins_and_facts_stay_where_they_lie(spark, tmp_path, partitions, capsys):
    ledger = ledger_plan.Ledger(str(tmp_path / "ledger"), star.LOOKUPS, star.LIMITS, star.SALES_AS_OF)
    ledger_plan.sync(lines_of(spark, tickets(0, 200) + ODD), ledger, 1, by_ticket=True)
    facts = tables.read_by(spark, "phone", ledger.path("facts"), changes.FACTS, ["run.000000000001"])
    assert plan_of(changes.summaries(facts, ledger.as_of, ledger.limits), capsys).count("Exchange") == 0
    scanned = tables.read_by(spark, "ticket_id", ledger.path("scans"), POS_LINES, ["run.000000000001"])
    assert plan_of(changes.ticket_digests(scanned), capsys).count("Exchange") == 0
    partitions(7)
    later = lines_of(spark, tickets(100, 300) + [(str(n), "5500000000") for n in range(50, 100)] + ODD)
    ledger_plan.sync(later, ledger, 2)
    same(ledger_plan.current_customers(spark, ledger), recomputed(later))


def test_batches_dealt_otherwise_come_along(spark, tmp_path, partitions):
    root = str(tmp_path / "table")
    rows = [spark.range(10 * n, 10 * n + 10).selectExpr("CAST(id AS STRING) AS k", "id % 3 AS v") for n in range(4)]
    tables.write(rows[0], root, "a")
    tables.write_by(rows[1], "k", root, "b")
    partitions(3)
    tables.write_by(rows[2], "k", root, "c")
    tables.write_by(rows[3], "k", root, "d")
    tables.forget(spark, root, "d")
    got = tables.read_by(spark, "k", root, "k string, v bigint", ["a", "b", "c", "d"])
    assert sorted(int(r.k) for r in got.collect()) == list(range(40))
    assert {(r.batch, r["count"]) for r in got.groupBy("batch").count().collect()} == {(b, 10) for b in "abcd"}
    assert {k: r.k for k, r in ((r.k, r) for r in got.groupBy("k").count().collect()) if r["count"] > 1} == {}
    assert tables.dealt_batches(spark, "k", root).keys() == {"b", "c"}
    tables.write_by(rows[0], "k", root, "c")  # a repeated batch is read as it is now
    assert tables.read_by(spark, "k", root, "k string, v bigint", ["c"]).agg(F.max(F.col("k").cast("int"))).first()[0] == 9
    assert tables.read_by(spark, "k", root, "k string, v bigint", []).count() == 0
