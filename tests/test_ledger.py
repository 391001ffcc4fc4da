"""The ledger against a plain event-by-event walk written from the rules alone."""

import math
import random

import pytest

from shelfledger.operators import ledger
from shelfledger.operators.ledger import ledger_history, ledger_state, running_quantity

PRODUCTS = (
    "id bigint, quantity bigint, member_id bigint, member_qty bigint, cost_price double, stock string"
)
EVENTS = (
    "product_id bigint, seq bigint, kind string, ref string, n bigint, member_id bigint, "
    "member_n bigint, unit_cost double"
)


def walk(products, events):
    """Expected history and final states."""
    state = {p[0]: dict(q=p[1] or 0, m=p[3] or 0, who=p[2] or None, c=p[4], band=p[5]) for p in products}
    ledger, rows = {}, []

    def band(q):
        return "out_stock" if q == 0 else "low_stock" if q <= 5 else "in_stock"

    for pid, seq, kind, ref, n, who, mn, cost in sorted(events, key=lambda e: e[1]):
        s = state.get(pid)
        sold, applied = None, True
        if kind == "sale":
            sold = 0
            if s:
                if s["who"]:
                    own = max(0, s["q"] - s["m"])
                    sold = max(0, n - min(n, own))
                s["q"], s["m"] = max(0, s["q"] - n), max(0, s["m"] - sold)
                s["band"] = band(s["q"])
            ledger[ref] = (n, sold)
        elif kind == "restock" and s:
            old = s["q"]
            s["q"] = old + n
            s["m"] += min(mn or 0, n)
            s["who"] = s["who"] or who or None
            if cost:
                if old > 0 and s["c"]:
                    s["c"] = (old * s["c"] + n * cost) / s["q"] if s["q"] else None
                else:
                    s["c"] = cost
            s["band"] = "in_stock" if s["q"] > 5 else "low_stock" if s["q"] > 0 else "out_stock"
        elif kind == "void":
            # A sale is taken back once, and a void that names none finds none.
            row = ledger.get(ref) if ref is not None else None
            if row is None and ref is not None and ref not in ledger and n is not None:
                row = (n, mn or 0)
            if row is not None:
                ledger[ref] = None
            sold, applied = (row[1], True) if row else (0, False)
            if row and s:
                s["q"] += row[0]
                s["m"] = min(s["q"], s["m"] + row[1])
                s["band"] = band(s["q"])
        after = (s["q"], s["m"], s["who"], shown(s["c"]), s["band"]) if s else (None,) * 5
        rows.append((pid, seq, kind, sold, *after, applied))
    return rows, {k: (s["q"], s["m"], s["who"], shown(s["c"]), s["band"]) for k, s in state.items()}


def shown(cost):
    return cost if cost is None or abs(cost) >= 1e9 else math.floor(cost / 1e-6 + 0.5) * 1e-6


def random_case(seed, products=4, events=160, hot=0.5, odd=True):
    rng = random.Random(seed)
    shelf = [
        (
            p,
            rng.choice([None, 0, 3, 20, 60]),
            rng.choice([None, 0, 7]),
            rng.choice([None, 0, 2, 30]),
            rng.choice([None, 0.0, 2.5]),
            "in_stock",
        )
        for p in range(products)
    ]
    out, sales = [], []
    for seq in range(events):
        pid = 0 if rng.random() < hot else rng.randrange(products + 1)
        roll = rng.random()
        if roll < 0.45:
            ref = f"s{seq}"
            n = rng.choice([1, 2, 5, 9, 30] + ([-2, 0] if odd else []))
            sales.append((pid, ref))
            out.append((pid, seq, "sale", ref, n, None, None, None))
        elif roll < 0.8:
            n = rng.choice([1, 4, 10, 25] + ([-6, 0] if odd else []))
            out.append(
                (
                    pid, seq, "restock", f"r{seq}", n, rng.choice([None, None, 0, 8]),
                    rng.choice([None, 0, 1, 4, 40] + ([-3] if odd else [])),
                    rng.choice([None, 0.0, 1.25, 3.7, 9.99]),
                )
            )
        elif sales:
            who, ref = rng.choice(sales)
            units = rng.choice([None, None, 3, 12])
            share = rng.choice([None, 0, 2]) if units else None
            if rng.random() < 0.3:  # a stored sale, a missing name, the same void again
                ref = rng.choice([None, f"old{who}-{rng.randrange(4)}", ref])
            out.append((who, seq, "void", ref, units, None, share, None))
    return shelf, out


def run_history(spark, shelf, events, hot_rows):
    got = ledger_history(
        spark.createDataFrame(shelf, PRODUCTS), spark.createDataFrame(events, EVENTS), ["seq"], hot_rows
    )
    return sorted(
        tuple(r)
        for r in got.select(
            "product_id", "seq", "kind", "member_sold", "quantity", "member_qty",
            "current_member", "cost_price", "stock", "applied",
        ).collect()
    )


def with_shown_shares(rows):
    """A restock shows no member share."""
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("seed", range(2))
def test_history_matches_walk(spark, seed):
    shelf, events = random_case(seed)
    assert run_history(spark, shelf, events, 10_000) == with_shown_shares(walk(shelf, events)[0])


@pytest.mark.parametrize("seed", range(2))
def test_hot_products_match_walk(spark, seed):
    """Products over 12 events are cut into blocks and folded side by side."""
    shelf, events = random_case(100 + seed, products=3, events=150)
    assert run_history(spark, shelf, events, 12) == with_shown_shares(walk(shelf, events)[0])


@pytest.mark.parametrize("seed", range(3))
def test_size_does_not_show(spark, seed):
    """Voids that carry units, name no sale or come twice do the same above and below the limit."""
    shelf, events = random_case(200 + seed, products=2, events=120, hot=0.8)
    assert run_history(spark, shelf, events, 10_000) == run_history(spark, shelf, events, 9)


@pytest.mark.parametrize("blocks", [5, 20, 80])
def test_rounds_do_not_grow_with_blocks(spark, blocks, monkeypatch):
    """Stock never sells out, restocks cost something and bring member units."""
    rng, events = random.Random(blocks), []
    for seq in range(blocks * 6):
        if seq % 3:
            events.append((1, seq, "sale", f"s{seq}", rng.randint(1, 5), None, None, None))
        else:
            events.append((1, seq, "restock", f"r{seq}", 40, None, rng.randint(0, 9), 1 + rng.random()))
    shelf, folds, fold = [(1, 500, 7, 3, 2.5, "in_stock")], [], ledger._fold
    monkeypatch.setattr(ledger, "_fold", lambda *a, **k: folds.append(1) or fold(*a, **k))
    got = run_history(spark, shelf, events, 6)
    assert len(folds) <= 2 + 3
    assert got == with_shown_shares(walk(shelf, events)[0])


@pytest.mark.parametrize("hot_rows", [10_000, 15])
def test_state_matches_walk(spark, hot_rows):
    shelf, events = random_case(7)
    shelf.append((99, 4, None, 0, 1.5, "low_stock"))
    got = ledger_state(
        spark.createDataFrame(shelf, PRODUCTS), spark.createDataFrame(events, EVENTS), ["seq"], hot_rows
    )
    found = {r[0]: tuple(r)[1:] for r in got.select(
        "product_id", "quantity", "member_qty", "member_id", "cost_price", "stock").collect()}
    assert found == walk(shelf, events)[1]


@pytest.mark.parametrize("hot_rows", [10_000, 20])
def test_running_quantity(spark, hot_rows):
    shelf, events = random_case(11, odd=True)
    events = [e for e in events if e[2] != "void"]
    got = running_quantity(
        spark.createDataFrame(shelf, PRODUCTS), spark.createDataFrame(events, EVENTS), ["seq"], hot_rows
    )
    found = {r.seq: r.running_quantity for r in got.collect()}
    assert found == {r[1]: r[4] for r in walk(shelf, events)[0]}
