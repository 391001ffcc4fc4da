"""Profit and loss from daily totals.

One row per day holds exact sums of the measures that the shop report adds up, so
a report over any range of days reads days and not sales. Each row also carries
the sums of all days up to it, and a range is the difference of two rows. The
sums are decimals, so nothing is lost on the way; rows without a day count for
all time only.

The table is kept up to date by micro-batches: each adds the sums of its days,
and equal days are added up when the prefix sums are made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfledger.functions.stock import line_cogs, line_member_cogs, line_own_cogs, line_revenue
from shelfledger.operators.filters import as_day
from shelfledger.operators.sales import Day, inventory_value
from shelfledger.plans.pnl import merge_single_rows, summary_of
from shelfledger.session import staging_path
from shelfledger.streaming.runs import run_to_end

SALE_MEASURES: dict[str, Callable[[], Column]] = {
    "revenue": line_revenue,
    "cogs": line_cogs,
    "profit": lambda: F.col("profit"),
    "member_cogs": line_member_cogs,
    "own_cogs": line_own_cogs,
    "sales": lambda: F.lit(1),
}
EXPENSE_MEASURES: dict[str, Callable[[], Column]] = {"amount": lambda: F.col("amount")}


def _days(rows: DataFrame, time: str, measures: dict[str, Callable[[], Column]]) -> DataFrame:
    sums = [F.coalesce(F.sum(m().cast("decimal(38,6)")), F.lit(0)).cast("decimal(38,6)").alias(name) for name, m in measures.items()]
    return rows.groupBy(F.to_date(time).alias("day")).agg(*sums)


def sale_days(sales: DataFrame) -> DataFrame:
    """Exact sums per day of sale."""
    return _days(sales, "sold_at", SALE_MEASURES)


def expense_days(expenses: DataFrame) -> DataFrame:
    return _days(expenses, "expense_date", EXPENSE_MEASURES)


def with_prefixes(days: DataFrame) -> DataFrame:
    """One row per day with ``<measure>_upto``; days that come several times are added up.

    The window runs over days, of which a century has 36,525.
    """
    measures = [c for c in days.columns if c != "day"]
    sums = days.groupBy("day").agg(*[F.sum(c).cast("decimal(38,6)").alias(c) for c in measures])
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dated = [F.when(F.col("day").isNotNull(), F.sum(F.when(F.col("day").isNotNull(), F.col(c))).over(upto)) for c in measures]
    return sums.select("*", *[d.cast("decimal(38,6)").alias(f"{c}_upto") for c, d in zip(measures, dated, strict=True)])


def between(cube: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """One row: each measure over an inclusive range of days, and over all rows as ``all_<measure>``.

    A range is the prefix of its last day less that of the day before its first.
    Without any bound rows without a day count too; an unreadable day matches nothing.
    """
    measures = [c for c in cube.columns if f"{c}_upto" in cube.columns]
    zero = F.lit(0).cast("decimal(38,6)")

    def upto(name: str, inside: Column) -> Column:
        return F.coalesce(F.max_by(F.when(inside, F.col(f"{name}_upto")), F.when(inside, F.col("day"))), zero)

    day = F.col("day")
    last = day <= as_day(end) if end else day.isNotNull()
    before = F.coalesce(day < as_day(start), F.lit(False)) if start else F.lit(False)
    whole = {c: F.coalesce(F.sum(c), zero).cast("decimal(38,6)") for c in measures}
    readable = [as_day(d).isNotNull() for d in (start, end) if d]
    ordered = as_day(start) <= as_day(end) if start and end else F.lit(True)
    ranged = F.lit(True)
    for holds in [*readable, ordered]:
        ranged = ranged & F.coalesce(holds, F.lit(False))

    def within(name: str) -> Column:
        if not start and not end:
            return whole[name]
        return F.when(ranged, upto(name, last) - upto(name, before)).otherwise(zero).cast("decimal(38,6)")

    return cube.agg(*[within(c).alias(c) for c in measures], *[whole[c].alias(f"all_{c}") for c in measures])


def pl_summary_from_days(
    sales_cube: DataFrame, expense_cube: DataFrame, products: DataFrame, start: Day = None, end: Day = None
) -> DataFrame:
    """The shop report's summary, of two tables that :func:`with_prefixes` made."""
    exact = lambda c: F.col(c).cast("decimal(38,4)")
    double = lambda c: F.col(c).cast("double")
    sold = between(sales_cube, start, end).select(
        double("revenue").alias("revenue"), double("profit").alias("stored_profit"), F.col("sales").cast("bigint").alias("transactions"),
        double("member_cogs").alias("member_cogs"), exact("revenue").alias("_revenue"), exact("cogs").alias("_cogs"),
        exact("member_cogs").alias("_member_cogs"), exact("all_own_cogs").alias("_own_cogs"),
    )
    spent = between(expense_cube, start, end).select(double("amount").alias("total_expenses"), exact("amount").alias("_expenses"))
    return summary_of(merge_single_rows(sold, spent, inventory_value(products)))


def stream_days(rows: DataFrame, days: Callable[[DataFrame], DataFrame], name: str, path: str | None = None) -> DataFrame:
    """Runs a stream to its end and gives the day sums that its micro-batches added.

    A micro-batch writes the sums of its own days over what a broken attempt left.
    """
    spark = rows.sparkSession
    path = path or staging_path(spark, name)
    form = days(rows.sparkSession.createDataFrame([], rows.schema)).schema
    _empty(spark, form, f"{path}/days/batch=-1")

    def step(batch: DataFrame, number: int) -> None:
        days(batch).write.mode("overwrite").parquet(f"{path}/days/batch={number}")

    run_to_end(rows, step, f"{path}/checkpoint")
    return spark.read.schema(form).option("recursiveFileLookup", "true").parquet(f"{path}/days")


def _empty(spark: SparkSession, form, path: str) -> None:
    spark.createDataFrame([], form).write.mode("ignore").parquet(path)
