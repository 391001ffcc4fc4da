"""Reports of daily totals equal those of the rows."""

import pytest

from shelfledger.plans import day_cube, pnl
from shelfledger.sources import retail_views as view

SF = "/root/testdata/sf0.001"
RANGES = [
    (None, None), ("1996-01-01", "1998-12-31"), (None, "1995-06-17"), ("1997-02-28", None), ("1996-05-05", "1996-05-05"),
    ("1900-01-01", "1990-01-01"), ("2100-01-01", None), ("1998-01-01", "1996-01-01"), ("no day", "1998-01-01"), ("1996-01-01", "1996-13-45"),
    ("", ""), ("1992-01-01", "2000-01-01"),
]


@pytest.fixture(scope="module")
def shop(spark):
    undated = "CASE WHEN id LIKE '%7%' AND line_no = 3 THEN NULL ELSE sold_at END AS sold_at"
    sales = view.sales(spark, SF)
    sales = sales.selectExpr(*[undated if c == "sold_at" else c for c in sales.columns]).cache()
    return sales, view.expenses(spark, SF).cache(), view.products(spark, SF).cache()


@pytest.mark.parametrize(("start", "end"), RANGES)
def test_ranges(shop, start, end):
    sales, expenses, products = shop
    sold, spent = (day_cube.with_prefixes(d) for d in (day_cube.sale_days(sales), day_cube.expense_days(expenses)))
    got = day_cube.pl_summary_from_days(sold, spent, products, start, end)
    wanted = pnl.pl_summary(sales, expenses, products, start, end)
    assert got.columns == wanted.columns and got.collect() == wanted.collect()


def test_the_cube_has_a_row_per_day(shop):
    sales, _, _ = shop
    cube = day_cube.with_prefixes(day_cube.sale_days(sales).union(day_cube.sale_days(sales)))
    assert cube.count() == sales.selectExpr("to_date(sold_at) AS d").distinct().count()
    row = day_cube.between(cube).first()
    assert row.sales == 2 * sales.count() and row.all_sales == row.sales


def test_no_rows(spark, shop):
    sales, expenses, products = (t.where("false") for t in shop)
    cubes = [day_cube.with_prefixes(d) for d in (day_cube.sale_days(sales), day_cube.expense_days(expenses))]
    for bounds in RANGES[:3]:
        assert day_cube.pl_summary_from_days(*cubes, products, *bounds).collect() == pnl.pl_summary(sales, expenses, products, *bounds).collect()
