from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from shelfledger.operators import catalog, maintenance, members, sales
from shelfledger.operators import validation as check
from shelfledger.operators.filters import all_of, lookup, lookup_many
from shelfledger.plans import pnl, product_pl
from shelfledger.sources import tables

SALES = (
    "id string, product_id bigint, product_name string, quantity_sold bigint, sale_price decimal(12,2), "
    "cost_price decimal(16,4), profit decimal(24,4), payment_method string, notes string, sold_at timestamp, "
    "member_id bigint, member_qty_sold bigint"
)


def sale(i, pid, qty, price, cost, at, member=None, share=None, name="P"):
    return (f"s{i}", pid, name, qty, D(price), D(cost), (D(price) - D(cost)) * qty, None, None, at, member, share)


@pytest.fixture(scope="module")
def shop(spark):
    ledger = [
        sale(1, 1, 2, "10.00", "6.0000", datetime(2024, 1, 1, 0, 0, 0)),
        sale(2, 1, 1, "12.00", "6.0000", datetime(2024, 1, 31, 23, 59, 59), 7, 1),
        sale(3, None, 1, "5.00", "0.0000", datetime(2024, 1, 15), name="Ad hoc"),
        sale(4, 9, 3, "1.00", "2.0000", datetime(2024, 2, 1), 8, 2, name="Gone"),
        sale(5, 1, 1, "3.00", "1.0000", None),
    ]
    products = [
        (1, "Oak", "Flooring", 4, 1, D("6.0000"), 7),
        (2, "Sink", "Vanity", 0, 5, D("9.0000"), 7),
        (3, "Saw", "Tools", None, None, None, None),
        (4, "Odd", "Tools", 2, 5, D("3.0000"), 99),
    ]
    expenses = [
        (1, "Rent", D("100.00"), date(2024, 1, 1)),
        (2, "Rent", D("50.00"), date(2024, 1, 31)),
        (3, "Ads", D("20.00"), date(2024, 2, 1)),
    ]
    return {
        "sales": spark.createDataFrame(ledger, SALES),
        "products": spark.createDataFrame(
            products,
            "id bigint, name string, category string, quantity bigint, member_qty bigint, "
            "cost_price decimal(16,4), member_id bigint",
        ),
        "expenses": spark.createDataFrame(
            expenses, "id bigint, category string, amount decimal(14,2), expense_date date"
        ),
        "members": spark.createDataFrame(
            [(7, "Ann"), (8, "Bo"), (5, "Cy")], "id bigint, name string"
        ),
    }


def test_pl_range_includes_both_days(shop):
    r = pnl.pl_summary(shop["sales"], shop["expenses"], shop["products"], "2024-01-01", "2024-01-31").first()
    assert (r.revenue, r.transactions, r.member_cogs, r.cogs) == (37.0, 3, 6.0, 12.0)
    assert (r.gross_profit, r.total_expenses, r.net_profit) == (25.0, 150.0, -125.0)
    assert (r.inventory_value, r.inventory_value_all) == (9.0, 30.0)
    assert r.total_invested == 12.0 + 2.0 + 1.0 + 9.0
    assert r.revenue - r.cogs - r.total_expenses == r.net_profit


def test_pl_of_empty_range_is_zero(shop):
    r = pnl.pl_summary(shop["sales"], shop["expenses"], shop["products"], "2030-01-01", None).first()
    assert (r.revenue, r.transactions, r.total_expenses, r.net_profit) == (0.0, 0, 0.0, 0.0)


def test_unreadable_bound_matches_nothing(shop):
    assert sales.expense_list(shop["expenses"], "soon", None).count() == 0


def test_document_arrays_are_ordered(shop):
    r = pnl.pl_document(shop["sales"], shop["expenses"], shop["products"], shop["members"]).first()
    assert [(e.category, e.total) for e in r.expense_breakdown] == [("Rent", 150.0), ("Ads", 20.0)]
    assert [t.product_name for t in r.top_products] == ["P", "Ad hoc", "Gone"]
    assert [s.id for s in r.recent_sales] == ["s4", "s2", "s3", "s1", "s5"]
    assert [s.member_name for s in r.recent_sales] == ["Bo", "Ann", None, None, None]


def test_product_statements(shop):
    stats = {r.product_id: r for r in sales.product_sales(shop["sales"]).collect()}
    assert set(stats) == {1, 9} and stats[1].units_sold == 4 and stats[1].revenue == 35.0
    pl = {r.product_id: r for r in product_pl.product_pl(shop["products"], shop["sales"]).collect()}
    assert (pl[3].units_sold, pl[3].revenue, pl[3].inventory_value, pl[3].margin_pct) == (0, 0.0, 0.0, 0.0)
    assert pl[1].margin_pct_ref == 0.0
    assert pl[1].margin_pct == pytest.approx(16 / 19 * 100)


def test_member_statements(shop):
    rows = members.member_statements(shop["members"], shop["products"], shop["sales"]).collect()
    assert [r.name for r in rows] == ["Ann", "Bo", "Cy"]
    ann, bo, cy = rows
    assert (ann.stock_value, ann.active_products, ann.total_products) == (6.0, 1, 2)
    assert (ann.sold_cost, ann.sold_revenue, ann.total_fronted, ann.owed_back) == (6.0, 12.0, 12.0, 6.0)
    assert (bo.sold_cost, bo.total_products) == (4.0, 0)
    assert (cy.stock_value, cy.sold_cost, cy.active_products) == (0.0, 0.0, 0)


def test_filters_default_to_all(shop):
    assert shop["products"].where(all_of([None, None])).count() == 4
    assert lookup(shop["products"], "id", 3).count() == 1
    keys = shop["sales"].select("product_id")
    assert [r.id for r in lookup_many(shop["products"], "id", keys).collect()] == [1]


def test_settings(spark):
    stored = spark.createDataFrame([("a", "1"), ("employee_password", "x"), ("e", "")], "key string, value string")
    assert {r.key for r in catalog.settings_object(stored).collect()} == {"a", "e"}
    entries = catalog.settings_entries(stored).collect()
    assert {r.json for r in entries} == {'{"a":"1"}', '{"e":""}'}
    assert catalog.setting_or_default(stored, "e", "d").first().value == "d"
    assert catalog.setting_or_default(stored, "none", "d").first().value == "d"
    filled = catalog.with_default_settings(stored, catalog.default_settings(spark))
    assert filled.count() == 10
    writes = spark.createDataFrame([("a", "2", 1), ("a", "3", 2), ("b", "4", 3)], "key string, value string, seq int")
    assert dict(tuple(r) for r in maintenance.upsert(stored, writes, "key").collect())["a"] == "3"


def test_overwrite_can_clear_and_ignores_unknown(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, note string")
    changes = spark.createDataFrame([(1, 1, "c", "z"), (1, 2, "d", None), (5, 1, "e", "w")], "id int, seq int, name string, note string")
    got = maintenance.overwrite(table, changes, ["name", "note"])
    assert sorted(map(tuple, got.collect())) == [(1, "d", None), (2, "b", "y")]


def test_unlink_keeps_quantity(shop, spark):
    gone = spark.createDataFrame([(7,)], "id bigint")
    left, products = maintenance.delete_members(shop["members"], shop["products"], gone)
    assert sorted(r.id for r in left.collect()) == [5, 8]
    rows = {r.id: (r.member_id, r.member_qty) for r in products.collect()}
    assert rows == {1: (None, 1), 2: (None, 5), 3: (None, None), 4: (99, 5)}


def test_edit_profit_quirk(shop, spark):
    edits = spark.createDataFrame(
        [("s1", 1, "20", "", None), ("s1", 2, "0", "Card", ""), ("zz", 1, "1", None, None)],
        "id string, seq int, sale_price string, payment_method string, notes string",
    )
    got = {r.id: r for r in maintenance.edit_sales(shop["sales"], edits).collect()}
    assert (got["s1"].sale_price, got["s1"].payment_method, got["s1"].notes) == (D("20.00"), "Card", "")
    assert got["s1"].profit == D("8.0000") and got["s1"].profit_line == D("28.0000")
    assert got["s2"].profit == D("6.0000")
    known = check.check_existing(edits, shop["sales"], "id", check.NOT_FOUND)
    assert [r.id for r in check.rejected(known).collect()] == ["zz"]


def test_sale_requests(spark):
    raw = spark.createDataFrame(
        [
            ("1", "N", "0", "0", None, "", None, ""),
            ("", "N", "2 pcs", "", "1.5", "n", "Cash", "2024-01-01"),
            ("1", "", "1", "1", None, None, None, None),
            ("1", "N", "1", None, None, None, None, None),
        ],
        "product_id string, product_name string, quantity_sold string, sale_price string, "
        "cost_price string, notes string, payment_method string, sold_at string",
    )
    checked = check.check_sales(raw)
    assert check.rejected(checked).count() == 2
    a, b = check.normal_sales(check.accepted(checked)).orderBy(F.desc("product_id")).collect()
    assert (a.product_id, a.quantity_sold, a.sale_price, a.profit, a.notes) == (1, 1, D("0.00"), D("0"), None)
    assert (b.product_id, b.quantity_sold, b.profit) == (None, 2, D("-3.0000"))


def test_tables_round_trip(shop, tmp_path, spark):
    path = str(tmp_path / "expenses")
    rows = shop["expenses"].withColumns({"payment_method": F.lit("Cash"), "notes": F.lit(None).cast("string")})
    rows.write.parquet(path)
    assert tables.read_table(spark, str(tmp_path), "expenses").count() == 3
    empty = rows.where("id < 0")
    assert tables.seed_if_empty(empty, rows).count() == 3
    assert tables.seed_if_empty(rows, rows).count() == 3
