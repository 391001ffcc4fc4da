"""Member statements and member product lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfledger.functions.stock import (
    line_member_cogs,
    line_member_revenue,
    zero_if_null,
)
from shelfledger.operators.filters import in_stock


def member_stock(products: DataFrame) -> DataFrame:
    """Value and count of each member's stocked products, and count of all their products."""
    stocked = in_stock()
    worth = zero_if_null(F.col("member_qty")) * zero_if_null(F.col("cost_price"))
    return (
        products.where(F.col("member_id").isNotNull())
        .groupBy("member_id")
        .agg(
            F.sum(F.when(stocked, worth).cast("decimal(38,6)")).cast("decimal(38,4)").alias("stock_value"),
            F.count(F.when(stocked, 1)).alias("active_products"),
            F.count("*").alias("total_products"),
        )
    )


def member_sold(sales: DataFrame) -> DataFrame:
    """Cost and revenue of each member's sold units."""
    return (
        sales.where(F.col("member_id").isNotNull())
        .groupBy("member_id")
        .agg(
            F.sum(line_member_cogs().cast("decimal(38,6)")).cast("decimal(38,4)").alias("sold_cost"),
            F.sum(line_member_revenue().cast("decimal(38,6)")).cast("decimal(38,4)").alias("sold_revenue"),
        )
    )


def member_statements(members: DataFrame, products: DataFrame, sales: DataFrame) -> DataFrame:
    """One settlement line per member, zeros where a member has no stock or sales.

    Both fact tables are reduced to one row per member before they meet the
    register, so no ledger row is ever shuffled for the join.
    """
    stock = member_stock(products).withColumnRenamed("member_id", "id")
    sold = member_sold(sales).withColumnRenamed("member_id", "id")
    worth = zero_if_null(F.col("stock_value"))
    cost = zero_if_null(F.col("sold_cost"))
    joined = members.join(stock, "id", "left").join(sold, "id", "left")
    return joined.select(
        *members.columns,
        worth.cast("double").alias("stock_value"),
        zero_if_null(F.col("active_products")).alias("active_products"),
        zero_if_null(F.col("total_products")).alias("total_products"),
        (cost + worth).cast("double").alias("total_fronted"),
        cost.cast("double").alias("sold_cost"),
        zero_if_null(F.col("sold_revenue")).cast("double").alias("sold_revenue"),
        cost.cast("double").alias("owed_back"),
    ).orderBy("name", "id")


def member_products(products: DataFrame, member_id: int | None = None) -> DataFrame:
    """Products fronted by one member, or by any member, in name order."""
    owned = F.col("member_id") == member_id if member_id is not None else F.col(
        "member_id"
    ).isNotNull()
    listed = ["id", "name", "quantity", "member_qty", "cost_price", "price", "stock"]
    if member_id is None:
        listed.append("member_id")
    return products.where(owned).select(*listed).orderBy("name", "id")
