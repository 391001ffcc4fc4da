"""What the ledger's passes cost: voids are linked in the fold's own walk, hot states need no maps on every row."""

import random

import pytest
from pyspark.sql import functions as F

from shelfledger.operators import ledger, stock_scan

SHELF = "id bigint, quantity bigint, member_id bigint, member_qty bigint, cost_price double, stock string"
EVENT = "product_id bigint, seq bigint, kind string, ref string, n bigint, member_id bigint, member_n bigint, unit_cost double"


def plan_of(df):
    return str(df._jdf.queryExecution().optimizedPlan())


@pytest.fixture
def shelf(spark):
    rows = [(1, 9, 7, 3, 2.0, "in_stock"), (2, 0, 5, 0, None, "out_stock"), (3, 30, None, 0, 1.5, "in_stock")]
    return spark.createDataFrame(rows, SHELF)


def dealt(spark, seed, kinds, members=True):
    draw, rows = random.Random(seed), []
    for seq in range(400):
        product, kind = draw.choice([1, 2, 3, 4]), draw.choice(kinds)
        # Few refs: sales are sold again and voided several times, before and after.
        ref = draw.choice([None, *(f"r{k}" for k in range(25))])
        if kind == "restock":
            rows.append((product, seq, kind, ref, draw.randint(0, 40), 7 if members and product == 3 else None, 4 if members else None, draw.choice([None, 0.0, 2.5, 9.0])))
        else:
            given = draw.random() < 0.3 or kind == "sale"
            rows.append((product, seq, kind, ref, draw.randint(0, 12) if given else None, None, 2 if given and kind == "void" else None, None))
    return spark.createDataFrame(rows, EVENT)


@pytest.mark.parametrize("seed", range(3))
def test_the_fold_links_voids_by_the_rule(spark, shelf, seed):
    events = dealt(spark, seed, ["sale", "sale", "restock", "void"])
    history = ledger.ledger_history(shelf, events, ["seq"])
    assert "MapInArrow" in plan_of(history) and "Window" not in plan_of(history)
    linked = ledger.link_voids(ledger.typed_events(events), ["seq"]).where("kind = 'void'")
    takes = {r.seq: r._takes for r in linked.collect()}
    found = {r.seq: r.applied for r in history.where("kind = 'void'").collect()}
    assert found == {seq: units is not None for seq, units in takes.items()} and set(found.values()) == {True, False}
    # Blocks of hot products get their links by windows; they come to the same rows.
    hot = ledger.ledger_history(shelf, events, ["seq"], hot_rows=20)
    by_seq = lambda df: sorted(df.select("seq", *[c for c in df.columns if c != "seq"]).collect())
    assert [str(r) for r in by_seq(history)] == [str(r) for r in by_seq(hot)]


def test_states_of_hot_products_carry_no_maps_and_no_references(spark, shelf, monkeypatch):
    events = dealt(spark, 5, ["sale", "sale", "restock"], members=False).withColumn("ref", F.concat_ws("-", "ref", "seq"))
    events = events.withColumn("notes", F.lit("long text"))
    cold = ledger.ledger_state(shelf, events, ["seq"])
    cut, seen = ledger.cut_blocks, []

    def watch(df, *args):
        seen.append(plan_of(df))
        return cut(df, *args)

    def no_maps(*args):
        raise AssertionError("a map on every row of a block")

    monkeypatch.setattr(ledger, "cut_blocks", watch)
    monkeypatch.setattr(stock_scan, "scan_blocks", no_maps)
    hot = ledger.ledger_state(shelf, events, ["seq"], hot_rows=20)
    assert sorted(hot.collect()) == sorted(cold.collect())
    assert len(seen) == 1 and "concat_ws" not in seen[0] and "long text" not in seen[0]


def test_history_folds_no_last_block_twice(spark, shelf, monkeypatch):
    events = dealt(spark, 9, ["sale", "sale", "restock", "void"])
    hand, seen = ledger._hand_over, []

    def watch(starts, ends):
        seen.append(({tuple(r) for r in starts.select("product_id", ledger.BLOCK).collect()}, {tuple(r) for r in ends.select("product_id", ledger.BLOCK).collect()}))
        return hand(starts, ends)

    monkeypatch.setattr(ledger, "_hand_over", watch)
    cold = ledger.ledger_history(shelf, events, ["seq"])
    hot = ledger.ledger_history(shelf, events, ["seq"], hot_rows=20)
    assert sorted(map(str, hot.select(*cold.columns).collect())) == sorted(map(str, cold.collect()))
    last = {product: max(b for p, b in seen[0][0] if p == product) for product, _ in seen[0][0]}
    assert seen and all(ends == starts - set(last.items()) for starts, ends in seen)
