"""Profit and loss of single products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfledger.functions.stock import zero_if_null
from shelfledger.operators.sales import product_sales
from shelfledger.sources.tables import row_json


def product_pl(products: DataFrame, sales: DataFrame) -> DataFrame:
    """One summary per product, zeros for a product without sales.

    ``margin_pct_ref`` is always 0: the figure it stands for divides by a total
    that is never produced. ``margin_pct`` is the gross profit over the cost.
    """
    stats = product_sales(sales).withColumnRenamed("product_id", "id")
    stocked = zero_if_null(F.col("quantity")) * zero_if_null(F.col("cost_price"))
    joined = products.select("id", "quantity", "cost_price").join(stats, "id", "left")
    cogs = zero_if_null(F.col("cogs"))
    gross = zero_if_null(F.col("profit"))
    return joined.select(
        F.col("id").alias("product_id"),
        zero_if_null(F.col("units_sold")).alias("units_sold"),
        zero_if_null(F.col("revenue")).alias("revenue"),
        cogs.alias("cogs"),
        gross.alias("gross_profit"),
        zero_if_null(F.col("transactions")).alias("transactions"),
        stocked.cast("double").alias("inventory_value"),
        F.lit(0.0).alias("margin_pct_ref"),
        F.when(cogs > 0, gross / cogs * 100).otherwise(0.0).alias("margin_pct"),
    )


def product_documents(products: DataFrame, sales: DataFrame, restocks: DataFrame) -> DataFrame:
    """Summary, sales and restocks of every product, one JSON entry per row.

    ``section`` names the part of the document and ``happened_at`` orders its
    entries, newest first. A product's history stays spread over rows because
    one product may hold a large share of the ledger.
    """
    no_time = F.lit(None).cast("timestamp_ntz")
    summary = product_pl(products, sales)
    parts = [
        _entries(summary, "summary", no_time),
        _entries(sales.where(F.col("product_id").isNotNull()), "sale", F.col("sold_at")),
        _entries(restocks, "restock", F.col("restocked_at")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _entries(rows: DataFrame, section: str, at) -> DataFrame:
    return rows.select(
        "product_id",
        F.lit(section).alias("section"),
        at.cast("timestamp_ntz").alias("happened_at"),
        row_json(*rows.columns).alias("entry"),
    )
