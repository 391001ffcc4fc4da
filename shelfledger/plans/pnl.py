"""Shop-wide profit and loss."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfledger.operators.sales import (
    Day,
    expense_breakdown,
    expense_total,
    inventory_value,
    recent_sales,
    sales_totals,
    top_products,
)


def merge_single_rows(*parts: DataFrame) -> DataFrame:
    """One row with the columns of several one-row frames.

    The rows are stacked and folded by an aggregate; nothing is joined.
    """
    names = [name for part in parts for name in part.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.first(name, ignorenulls=True).alias(name) for name in names])


def pl_summary(
    sales: DataFrame, expenses: DataFrame, products: DataFrame, start: Day = None, end: Day = None
) -> DataFrame:
    """Revenue, cost split, expenses, profit and inventory value in one row.

    ``gross_profit`` is revenue less the shop's own cost; the sum of the stored
    line profits is ``stored_profit``.
    """
    totals = merge_single_rows(
        sales_totals(sales, start, end),
        expense_total(expenses, start, end),
        inventory_value(products),
    )
    return summary_of(totals)


def summary_of(totals: DataFrame) -> DataFrame:
    """The summary's figures of one row of totals."""
    my_cogs = F.col("_cogs") - F.col("_member_cogs")
    my_gross = F.col("_revenue") - my_cogs
    return totals.select(
        "revenue",
        my_cogs.cast("double").alias("cogs"),
        "member_cogs",
        my_gross.cast("double").alias("gross_profit"),
        "stored_profit",
        "transactions",
        "total_expenses",
        (my_gross - F.col("_expenses")).cast("double").alias("net_profit"),
        "inventory_value",
        "inventory_value_all",
        (F.col("_own_cogs") + F.col("_own_value")).cast("double").alias("total_invested"),
    )


def pl_document(
    sales: DataFrame,
    expenses: DataFrame,
    products: DataFrame,
    members: DataFrame,
    start: Day = None,
    end: Day = None,
) -> DataFrame:
    """The report as one nested row.

    The arrays hold report rows only: one per expense category, and the fixed
    sizes of the two rankings.
    """
    return merge_single_rows(
        pl_summary(sales, expenses, products, start, end),
        _as_array(
            expense_breakdown(expenses, start, end),
            "expense_breakdown",
            ("total", True),
            ("category", False),
        ),
        _as_array(
            top_products(sales, start, end).select("product_name", "units", "revenue", "profit"),
            "top_products",
            ("revenue", True),
            ("product_name", False),
        ),
        _as_array(
            recent_sales(sales, members, start, end),
            "recent_sales",
            ("sold_at", True),
            ("id", True),
        ),
    )


def _as_array(rows: DataFrame, name: str, *order: tuple[str, bool]) -> DataFrame:
    """All rows as one ordered array; ``order`` pairs a column with its descending flag."""

    def compare(a, b):
        result = F.lit(0)
        for column, descending in reversed(order):
            less, more = (1, -1) if descending else (-1, 1)
            # NULL is the smallest value, as in the listings.
            result = (
                F.when(a[column].eqNullSafe(b[column]), result)
                .when(a[column].isNull(), less)
                .when(b[column].isNull(), more)
                .when(a[column] < b[column], less)
                .otherwise(more)
            )
        return result

    entries = F.collect_list(F.struct(*rows.columns))
    return rows.agg(F.array_sort(entries, compare).alias(name))
