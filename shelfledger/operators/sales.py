"""Sales, restock and expense listings and their aggregates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from shelfledger.functions.stock import (
    count_total,
    exact_total,
    line_cogs,
    line_member_cogs,
    line_own_cogs,
    line_revenue,
    total,
    zero_if_null,
)
from shelfledger.operators.catalog import with_member_name
from shelfledger.operators.filters import in_days, in_stock, of_product

Day = str | date | None

# Report sizes.
TOP_PRODUCTS = 5
RECENT_SALES = 200


def product_sales(sales: DataFrame) -> DataFrame:
    """Units, revenue, cost, profit and count per product; sales without a product drop out."""
    return (
        sales.where(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(
            count_total(F.col("quantity_sold")).alias("units_sold"),
            total(line_revenue()).alias("revenue"),
            total(line_cogs()).alias("cogs"),
            total(F.col("profit")).alias("profit"),
            F.count("*").alias("transactions"),
        )
    )


def sales_ledger(sales: DataFrame, product_id: int | None = None) -> DataFrame:
    return sales.where(of_product(product_id)).orderBy(F.desc("sold_at"), F.desc("id"))


def ledger_page(sales: DataFrame, size: int, after: tuple | None = None, product_id: int | None = None) -> DataFrame:
    """The next ``size`` rows of :func:`sales_ledger` behind the row ``after``, its (sold_at, id).

    The time bound reaches the scan, and the rest is a top-n: no page sorts the
    ledger. Ids are unique. Missing values come last, as in the whole listing.
    """
    rows = sales.where(of_product(product_id))
    if after is not None:
        time, key = after
        behind = F.col("id").isNull() | (F.col("id") < F.lit(key)) if key is not None else F.lit(False)
        undated = rows.where(F.col("sold_at").isNull())
        if time is None:
            rows = undated.where(behind)
        else:
            kind = sales.schema["sold_at"].dataType
            # A literal of the column's own type, so that the bound can be pushed down.
            moment = F.lit(str(time)).cast(kind) if kind == TimestampNTZType() else F.lit(time)
            dated = rows.where((F.col("sold_at") <= moment) & ((F.col("sold_at") < moment) | behind))
            rows = dated.unionByName(undated)
    return rows.orderBy(F.desc("sold_at"), F.desc("id")).limit(size)


def page_token(page: DataFrame) -> tuple | None:
    """Where the page ends, for the one behind it; None for an empty page."""
    last = page.select("sold_at", "id").tail(1)
    return tuple(last[0]) if last else None


def restock_history(restocks: DataFrame, product_id: int | None = None) -> DataFrame:
    return restocks.where(of_product(product_id)).orderBy(F.desc("restocked_at"), F.desc("id"))


def expense_list(expenses: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    return expenses.where(in_days("expense_date", start, end)).orderBy(
        F.desc("expense_date"), F.desc("id")
    )


def expense_totals_by_category(
    expenses: DataFrame, start: Day = None, end: Day = None
) -> DataFrame:
    return (
        expenses.where(in_days("expense_date", start, end))
        .groupBy("category")
        .agg(total(F.col("amount")).alias("total"))
    )


def expense_breakdown(expenses: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    totals = expense_totals_by_category(expenses, start, end)
    return totals.orderBy(F.desc("total"), F.asc("category"))


def sales_totals(sales: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """One row of range totals, with the all-time own cost, in one scan.

    The all-time sum needs every sale, so the range is a condition inside the
    aggregates instead of a filter.
    """
    inside = in_days("sold_at", start, end)

    def ranged(measure):
        return F.when(inside, measure)

    return sales.agg(
        total(ranged(line_revenue())).alias("revenue"),
        total(ranged(line_cogs())).alias("total_cogs"),
        total(ranged(F.col("profit"))).alias("stored_profit"),
        F.count(ranged(F.lit(1))).alias("transactions"),
        total(ranged(line_member_cogs())).alias("member_cogs"),
        total(line_own_cogs()).alias("all_time_my_cogs"),
        # The derived figures stay decimal until the end, so that they are exact.
        exact_total(ranged(line_revenue())).alias("_revenue"),
        exact_total(ranged(line_cogs())).alias("_cogs"),
        exact_total(ranged(line_member_cogs())).alias("_member_cogs"),
        exact_total(line_own_cogs()).alias("_own_cogs"),
    )


def expense_total(expenses: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    return expenses.where(in_days("expense_date", start, end)).agg(
        total(F.col("amount")).alias("total_expenses"),
        exact_total(F.col("amount")).alias("_expenses"),
    )


def inventory_value(products: DataFrame) -> DataFrame:
    """Value of the stock on hand: own units, and all units."""
    cost = zero_if_null(F.col("cost_price"))
    own = (F.col("quantity") - zero_if_null(F.col("member_qty"))) * cost
    every = F.col("quantity") * cost
    return products.where(in_stock()).agg(
        total(own).alias("inventory_value"),
        total(every).alias("inventory_value_all"),
        exact_total(own).alias("_own_value"),
    )


def top_products(
    sales: DataFrame, start: Day = None, end: Day = None, limit: int = TOP_PRODUCTS
) -> DataFrame:
    """Best sellers by revenue; sales without a product rank under their own name."""
    return (
        sales.where(in_days("sold_at", start, end))
        .groupBy("product_id", "product_name")
        .agg(
            count_total(F.col("quantity_sold")).alias("units"),
            total(line_revenue()).alias("revenue"),
            total(F.col("profit")).alias("profit"),
        )
        .orderBy(F.desc("revenue"), F.asc("product_name"), F.asc("product_id"))
        .limit(limit)
    )


def recent_sales(
    sales: DataFrame,
    members: DataFrame,
    start: Day = None,
    end: Day = None,
    limit: int = RECENT_SALES,
) -> DataFrame:
    """Newest sales of the range with the member's name.

    The cut comes before the join: only ``limit`` rows are looked up.
    """
    newest = (
        sales.where(in_days("sold_at", start, end))
        .select(
            "id", "product_name", "quantity_sold", "sale_price", "profit",
            "payment_method", "notes", "sold_at", "member_id",
        )
        .orderBy(F.desc("sold_at"), F.desc("id"))
        .limit(limit)
    )
    named = with_member_name(newest, members)
    return named.select(*newest.columns, "member_name").orderBy(F.desc("sold_at"), F.desc("id"))
