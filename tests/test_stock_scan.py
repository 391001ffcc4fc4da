"""Regular products by windows alone, against the event-by-event walk."""

import random

import pytest
from pyspark.sql import functions as F

from shelfledger.operators import ledger, stock_scan
from test_ledger import EVENTS, PRODUCTS, random_case, run_history, walk, with_shown_shares

PYTHON = ("MapInArrow", "PythonMapInArrow", "FlatMapGroupsInArrow", "ArrowEvalPython", "BatchEvalPython")


def regular_case(seed, products=6, events=200, hot=0.3):
    """Members without voids, and voids without members."""
    rng = random.Random(seed)
    shelf = []
    for p in range(products):
        q = rng.choice([0, 3, 20, 60, 200])
        who = rng.choice([7, 9]) if p % 2 else rng.choice([None, 0])
        shelf.append((p, q, who, rng.choice([0, q // 3, q]) if who else rng.choice([0, 2]), rng.choice([None, 0.0, 2.5]), "in_stock"))
    out, sales = [], []
    for seq in range(events):
        pid = 1 if rng.random() < hot else rng.randrange(products + 1)
        roll, member = rng.random(), pid % 2 == 1
        if roll < 0.5:
            out.append((pid, seq, "sale", f"s{seq}", rng.choice([0, 1, 2, 5, 9, 30]), None, None, None))
            sales.append((pid, f"s{seq}"))
        elif roll < 0.85 or member or not sales:
            n = rng.choice([0, 1, 4, 10, 25])
            who = rng.choice([None, 0, 8]) if member else None
            out.append((pid, seq, "restock", f"r{seq}", n, who, rng.choice([None, 0, 1, 40]), rng.choice([None, 0.0, 1.25, 9.99])))
        else:
            taken = [s for s in sales if s[0] % 2 == 0]
            if taken:
                who, ref = rng.choice(taken)
                out.append((who, seq, "void", rng.choice([ref, ref, None, "old"]), rng.choice([None, 3]), None, None, None))
    return shelf, out


def frames(spark, shelf, events):
    return spark.createDataFrame(shelf, PRODUCTS), spark.createDataFrame(events, EVENTS)


def python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [p for p in PYTHON if p in plan]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hot_rows", [10_000, 15])
def test_history_and_state_without_python(spark, seed, hot_rows, monkeypatch):
    shelf, events = regular_case(seed)
    monkeypatch.setattr(ledger, "_fold", lambda *a, **k: pytest.fail("no product needs the fold"))
    rows, states = walk(shelf, events)
    assert run_history(spark, shelf, events, hot_rows) == with_shown_shares(rows)
    state = ledger.ledger_state(*frames(spark, shelf, events), ["seq"], hot_rows)
    assert not python_nodes(state)
    found = {r[0]: tuple(r)[1:] for r in state.select("product_id", "quantity", "member_qty", "member_id", "cost_price", "stock").collect()}
    assert found == states


@pytest.mark.parametrize("seed", range(4))
def test_mixed_products_are_dealt_right(spark, seed):
    """Regular and irregular products in one batch; sizes on both sides of the limit."""
    shelf, events = regular_case(50 + seed, events=120)
    more_shelf, more_events = random_case(70 + seed, events=120)
    shelf += [(p[0] + 100, *p[1:]) for p in more_shelf]
    events += [(e[0] + 100, e[1] + 1000, *e[2:]) for e in more_events]
    assert run_history(spark, shelf, events, [10_000, 14][seed % 2]) == with_shown_shares(walk(shelf, events)[0])


def test_long_products_lose_no_digits(spark):
    """Restocks that each halve what is left of the first cost: no running product may be divided by."""
    rng, events = random.Random(4), []
    for seq in range(3000):
        if seq % 2:
            events.append((1, seq, "sale", f"s{seq}", 10, None, None, None))
        else:
            events.append((1, seq, "restock", f"r{seq}", 10, None, rng.randint(0, 3), 1 + rng.random()))
    shelf = [(1, 10, 7, 3, 2.5, "in_stock")]
    rows, _ = walk(shelf, events)
    for hot_rows in (10_000, 400):
        got = {r.seq: r for r in ledger.ledger_history(*frames(spark, shelf, events), ["seq"], hot_rows).collect()}
        for row in rows:
            assert (got[row[1]].quantity, got[row[1]].member_qty) == row[4:6]
            assert got[row[1]].cost_price == pytest.approx(row[7], abs=2e-6)


def test_what_is_irregular(spark):
    opening = F.struct(*[F.col(c).alias(n) for c, n in (("quantity", "quantity"), ("member_qty", "member_qty"), ("member_id", "current_member"), ("cost_price", "cost_price"), ("stock", "stock"))])
    base = (5, None, 0, 1.0, "in_stock")
    cases = [
        (base, [], False),
        ((5, 7, 6, 1.0, "in_stock"), [], True),  # more of the member than there is
        ((5, None, 6, 1.0, "in_stock"), [], False),  # but nobody's
        ((5, None, 2, 1.0, "in_stock"), [("restock", 1, 8, 0, None)], True),  # units that a member finds
        ((-5, None, 0, 1.0, "in_stock"), [], True),
        (base, [("sale", -1, None, None, None)], True),
        (base, [("restock", 1, None, -1, None)], True),
        (base, [("restock", 1, None, None, -2.0)], True),
        (base, [("restock", 1, None, None, float("nan"))], True),
        (base, [("void", None, None, None, None)], False),
        ((5, 7, 2, 1.0, "in_stock"), [("void", None, None, None, None)], True),
        (base, [("sale", 3, None, None, None), ("restock", 2, 8, 1, 3.0)], False),
    ]
    shelf = [(i, *c[0]) for i, c in enumerate(cases)]
    events = [(i, *e) for i, c in enumerate(cases) for e in c[1]]
    opened = spark.createDataFrame(shelf, "product_id long, quantity long, member_id long, member_qty long, cost_price double, stock string")
    rows = opened.select("product_id", F.lit("open").alias("kind"), opening.alias("_open")).unionByName(
        spark.createDataFrame(events, "product_id long, kind string, n long, member_id long, member_n long, unit_cost double"), allowMissingColumns=True
    )
    found = {r.product_id: r.odd for r in rows.groupBy("product_id").agg(stock_scan.irregular().alias("odd")).collect()}
    assert found == {i: c[2] for i, c in enumerate(cases)}
