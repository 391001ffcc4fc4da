"""Running totals of the sales and expense streams.

The aggregates are those of the batch reports; Spark keeps one partial row per
group as state and combines each micro-batch before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfledger.operators.sales import expense_totals_by_category, product_sales, sales_totals


def stream_product_sales(sales: DataFrame) -> DataFrame:
    return product_sales(sales)


def stream_expenses(expenses: DataFrame) -> DataFrame:
    return expense_totals_by_category(expenses)


def stream_sales_totals(sales: DataFrame) -> DataFrame:
    totals = sales_totals(sales)
    return totals.select([c for c in totals.columns if not c.startswith("_")])
