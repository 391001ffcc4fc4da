"""The order of the listings that promise one."""

from datetime import datetime
from pathlib import Path

import pytest

from shelfledger.operators import catalog, members, sales
from shelfledger.sources import retail_views as view

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_ledgers_start_with_the_latest(spark):
    for rows, moment in (
        (sales.sales_ledger(view.sales(spark, SF)).collect(), "sold_at"),
        (sales.restock_history(view.restocks(spark, SF)).collect(), "restocked_at"),
        (sales.expense_list(view.expenses(spark, SF)).collect(), "expense_date"),
    ):
        keys = [(r[moment], r.id) for r in rows]
        assert keys == sorted(keys, reverse=True) and len(keys) > 10


def test_catalogue_and_members_by_name(spark):
    found = catalog.search_products(view.products(spark, SF), view.members(spark, SF)).collect()
    featured = [r.featured for r in found]
    assert featured == sorted(featured, reverse=True) and len(found) == 200
    for rows in (
        members.member_products(view.products(spark, SF)).collect(),
        members.member_statements(view.members(spark, SF), view.products(spark, SF), view.sales(spark, SF)).collect(),
    ):
        names = [(r.name, r.id) for r in rows]
        assert names == sorted(names)


def test_pages_joined_are_the_listing(spark):
    """Ties in time, missing times, and the bound in the scan."""
    rows = [(f"s{i % 37:02d}-{i}", None if i % 11 == 0 else datetime(2024, 1, 1 + i % 9), i % 3) for i in range(200)]
    stored = spark.createDataFrame(rows, "id string, sold_at timestamp_ntz, product_id long")
    for product in (None, 1):
        whole = [r.id for r in sales.sales_ledger(stored, product).collect()]
        found, token = [], None
        while True:
            page = sales.ledger_page(stored, 23, token, product)
            token = sales.page_token(page)
            if token is None:
                break
            found += [r.id for r in page.collect()]
        assert found == whole
    lines = view.sales(spark, "/root/testdata/sf0.001")
    plan = sales.ledger_page(lines, 5, (datetime(1996, 5, 5), "x"))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(l_" in plan and "TakeOrderedAndProject" in plan
