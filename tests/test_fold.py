"""The per-product step against the plain walk, and its invariants."""

from hypothesis import given, settings
from hypothesis import strategies as st
from test_ledger import shown, walk

from shelfledger.functions.stock_fold import Stock, TracedStock

small = st.integers(-5, 40)
cost = st.sampled_from([None, 0.0, 1.25, 7.5])
event = st.tuples(
    st.sampled_from(["sale", "restock", "void"]), small, st.sampled_from([None, 0, 8]), small, cost
)


@settings(max_examples=300, deadline=None)
@given(
    st.tuples(small, st.sampled_from([None, 0, 7]), st.integers(0, 40), cost),
    st.lists(event, max_size=40),
)
def test_step_matches_walk(opening, moves):
    quantity, member, share, first_cost = opening
    events, sales = [], []
    for seq, (kind, n, who, mn, unit) in enumerate(moves):
        if kind == "void":
            if not sales:
                continue
            events.append((1, seq, kind, sales[n % len(sales)], None, None, None, None))
        else:
            if kind == "sale":
                sales.append(f"s{seq}")
            events.append((1, seq, kind, f"s{seq}", n, who, mn, unit))
    expected = walk([(1, quantity, member, share, first_cost, "in_stock")], events)[1][1]
    for stock in (Stock(), TracedStock()):
        stock.open(quantity, share, member, first_cost, "in_stock")
        ledger = {}
        for _, _, kind, ref, n, who, mn, unit in events:
            if kind == "sale":
                ledger[ref] = (n, stock.sell(n))
            elif kind == "restock":
                stock.restock(n, mn or 0, who, unit)
            elif ref in ledger:
                stock.void(*ledger.pop(ref))
        got = (stock.quantity, stock.member_qty, stock.member_id, shown(stock.cost), stock.stock)
        assert got == expected


@given(st.integers(0, 30), st.lists(st.tuples(st.booleans(), st.integers(0, 30)), max_size=30))
def test_quantity_never_negative(quantity, moves):
    stock = Stock()
    stock.open(quantity, 0, 7, 2.0, "in_stock")
    for sale, n in moves:
        if sale:
            assert 0 <= stock.sell(n) <= n
        else:
            stock.restock(n, n // 2, None, 3.0)
        assert stock.quantity >= stock.member_qty >= 0


def test_oversell_then_void_is_not_undone():
    stock = Stock()
    stock.open(3, 0, None, None, "low_stock")
    stock.sell(10)
    assert (stock.quantity, stock.stock) == (0, "out_stock")
    stock.void(10, 0)
    assert stock.quantity == 10
