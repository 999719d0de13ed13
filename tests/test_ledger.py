"""Ledger runs: edits, removals, repeats, against a roll-up of the current lines."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillsight.operators import changes, customers, purchases
from tillsight.plans import ledger as plan
from tillsight.schemas import POS_LINES
from tillsight.sources import star


def lines_of(spark, rows):
    """(ticket, line, phone, quantity, day, seller) as ticket lines of one store."""
    values = [
        ("TS0001", t, n, "TK", dt.date(2024, 1, d), s, f"1/{q}EC", "d", "b", Decimal(q), Decimal(10), "CA", f"name {p}", p, "web")
        for t, n, p, q, d, s in rows
    ]
    return spark.createDataFrame(values, POS_LINES)


@pytest.fixture
def ledger(tmp_path):
    return plan.Ledger(str(tmp_path / "ledger"), star.LOOKUPS, star.LIMITS, star.SALES_AS_OF)


def recomputed(spark, ledger, lines):
    bought = purchases.purchases_from_pos(lines, star.LOOKUPS, star.LIMITS)
    return customers.customer_360(bought, star.SALES_AS_OF, star.LIMITS)


def same(a, b):
    b = b.select(*a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def log(spark, ledger, run_id):
    return sorted((r.ticket_id, r.change, r.n) for r in plan.ticket_log(spark, ledger).filter(F.col("run_id") == run_id).collect())


def test_edits_leave_sums_and_favourites(spark, ledger):
    first = [("1", 1, "5511111111", 5, 1, "1-URGENT"), ("1", 2, "5511111111", 6, 1, "1-URGENT"), ("2", 1, "5511111111", 7, 9, "x"),
             ("3", 1, "5522222222", 1, 5, "2-HIGH"), ("A", 1, "5522222222", 1, 5, ""), ("4", 1, "12", 1, 1, "")]
    plan.sync(lines_of(spark, first), ledger, 1)
    assert log(spark, ledger, 1) == [("1", "added", 2), ("2", "added", 1), ("3", "added", 1), ("4", "added", 1)]
    # The first day goes with a ticket, a phone with its only ticket, a line moves to another phone.
    second = [("2", 1, "5511111111", 7, 9, "x"), ("3", 1, "5533333333", 1, 5, "2-HIGH"), ("5", 1, "5511111111", 2, 3, "x")]
    plan.sync(lines_of(spark, second), ledger, 2)
    assert log(spark, ledger, 2) == [("1", "gone", 0), ("3", "changed", 1), ("4", "gone", 0), ("5", "added", 1)]
    now = plan.current_customers(spark, ledger)
    same(now, recomputed(spark, ledger, lines_of(spark, second)))
    got = {r.phone: r for r in now.collect()}
    assert set(got) == {"5511111111", "5533333333"}
    assert (got["5511111111"].first_purchase_date, got["5511111111"].total_orders) == (dt.date(2024, 1, 3), 2)
    # Back to the first state: gone tickets come again.
    plan.sync(lines_of(spark, first), ledger, 3)
    same(plan.current_customers(spark, ledger), recomputed(spark, ledger, lines_of(spark, first)))
    assert ("1", "added", 2) in log(spark, ledger, 3)


def test_repeated_and_empty_runs(spark, ledger):
    rows = [("1", 1, "5511111111", 5, 1, "x"), ("1", 1, "5511111111", 5, 1, "x")]
    for _ in range(2):
        plan.sync(lines_of(spark, rows), ledger, 1)
    plan.sync(lines_of(spark, rows), ledger, 2)
    assert log(spark, ledger, 2) == []
    edited = [("1", 1, "5511111111", 5, 1, "x")]  # one of two equal lines less
    for _ in range(2):
        plan.sync(lines_of(spark, edited), ledger, 3)
    assert log(spark, ledger, 3) == [("1", "changed", 1)]
    same(plan.current_customers(spark, ledger), recomputed(spark, ledger, lines_of(spark, edited)))
    plan.sync(lines_of(spark, []), ledger, 4)
    assert plan.current_customers(spark, ledger).count() == 0 and plan.current_lines(spark, ledger).count() == 0


def test_scope_bounds_what_can_be_gone(spark, ledger):
    rows = [(str(n), 1, f"551111111{n}", n, 1, "x") for n in range(1, 8)]
    plan.sync(lines_of(spark, rows), ledger, 1)
    late = F.col("ticket_id").cast("bigint") >= 5
    plan.sync(lines_of(spark, rows[5:]), ledger, 2, scope=late)
    assert log(spark, ledger, 2) == [("5", "gone", 0)]
    assert plan.current_customers(spark, ledger).count() == 6


def test_random_edits_equal_recompute(spark, ledger):
    draw = random.Random(2)
    state = {}
    for run in range(1, 4):
        for _ in range(60):
            ticket = str(draw.randrange(40))
            if draw.random() < 0.3:
                state.pop(ticket, None)
            else:
                phone = draw.choice(["5500000000", f"55111111{draw.randrange(10, 20)}"])
                state[ticket] = [(ticket, n, phone, draw.randrange(1, 4), draw.randrange(1, 28), draw.choice(["1-URGENT", "", "y"])) for n in range(draw.randrange(1, 4))]
        lines = lines_of(spark, [row for rows in state.values() for row in rows])
        plan.sync(lines, ledger, run)
        same(plan.current_customers(spark, ledger), recomputed(spark, ledger, lines))
    same(plan.current_lines(spark, ledger), lines)


def test_digests_see_nulls_and_order(spark):
    schema = "store_code string, ticket_id string, a string, b string"

    def digest(*rows):
        r = changes.ticket_digests(spark.createDataFrame([("s", "1", *row) for row in rows], schema)).first()
        return r.n, r.d1, r.d2

    assert digest(("x", None), ("y", "z")) == digest(("y", "z"), ("x", None))
    assert len({digest(("x", None)), digest((None, "x")), digest(("x", "")), digest(("x", None), ("x", None))}) == 4
