"""Stock bands, clamps and line measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band names and the low-stock threshold.
OUT, LOW, IN = "out_stock", "low_stock", "in_stock"
LOW_LIMIT = 5


def band_after_sale(quantity: Column) -> Column:
    """Band written by a sale or a void: a negative quantity counts as low."""
    return (
        F.when(quantity == 0, OUT).when(quantity <= LOW_LIMIT, LOW).otherwise(IN)
    )


def band_after_restock(quantity: Column) -> Column:
    """Band written by a restock: a negative quantity counts as out."""
    return F.when(quantity > LOW_LIMIT, IN).when(quantity > 0, LOW).otherwise(OUT)


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def line_revenue() -> Column:
    return F.col("sale_price") * F.col("quantity_sold")


def line_cogs() -> Column:
    return F.col("cost_price") * F.col("quantity_sold")


def line_member_cogs() -> Column:
    return F.col("cost_price") * zero_if_null(F.col("member_qty_sold"))


def line_member_revenue() -> Column:
    return F.col("sale_price") * zero_if_null(F.col("member_qty_sold"))


def line_own_cogs() -> Column:
    return F.col("cost_price") * (
        F.col("quantity_sold") - zero_if_null(F.col("member_qty_sold"))
    )


def exact_total(measure: Column) -> Column:
    """Decimal sum at six decimals, which no order of rows changes; zero over no rows."""
    return F.coalesce(F.sum(measure.cast("decimal(38,6)")), F.lit(0)).cast("decimal(38,4)")


def total(measure: Column) -> Column:
    """The same at full length, given out as DOUBLE."""
    return F.coalesce(F.sum(measure.cast("decimal(38,6)")), F.lit(0)).cast("double")


def count_total(measure: Column) -> Column:
    return F.coalesce(F.sum(measure), F.lit(0)).cast("bigint")
