"""The retail tables seen through a star schema (part, supplier, lineitem, orders, events).

parts are products, suppliers are members, returned line items are restocks,
the other line items are sales, orders are expenses, and the event
log stands for settings writes and for the import slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOID_DELAY_DAYS = 30


def star(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _member_keys(spark: SparkSession, sf_dir: str) -> Column:
    """Number of member keys in use; two more than exist, so some ids dangle."""
    return star(spark, sf_dir, "supplier").agg(F.count("*") + 2).scalar()


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id", "s_name AS name", "CAST(s_nationkey AS STRING) AS phone"
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = star(spark, sf_dir, "part")
    member = F.when(F.expr("p_partkey % 3 = 0"), F.col("p_partkey") % _member_keys(spark, sf_dir))
    return part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.expr(
            "CASE WHEN p_type IN ('ECONOMY','MEDIUM') THEN 'Flooring' "
            "WHEN p_type IN ('PROMO','SMALL') THEN 'Vanity' "
            "WHEN p_type = 'LARGE' THEN 'Tools' ELSE 'Other' END"
        ).alias("category"),
        F.expr("CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END").alias("subcategory"),
        F.concat_ws(" ", "p_name", "p_type").alias("description"),
        F.col("p_retailprice").alias("price"),
        F.expr("CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END").alias("featured"),
        F.expr("p_size % 5").alias("sort_order"),
        F.expr("CAST(p_size - 1 AS BIGINT)").alias("quantity"),
        F.expr(
            "CASE WHEN p_size - 1 = 0 THEN 'out_stock' WHEN p_size - 1 <= 5 THEN 'low_stock' "
            "ELSE 'in_stock' END"
        ).alias("stock"),
        F.expr(
            "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2))"
            " * CAST(0.6 AS DECIMAL(3,2)) AS DECIMAL(16,4)) END"
        ).alias("cost_price"),
        member.alias("member_id"),
        F.expr(
            "CASE WHEN p_partkey % 3 = 0 THEN CAST(FLOOR((p_size - 1) / 3.0) AS BIGINT) "
            "WHEN p_partkey % 3 = 1 THEN CAST(0 AS BIGINT) END"
        ).alias("member_qty"),
        F.expr("DATE'2024-01-01' + p_size").alias("created_at"),
    )


LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE)) AS id"


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_of(star(spark, sf_dir, "lineitem"), _member_keys(spark, sf_dir))


def sales_of(lines: DataFrame, member_keys: Column | int) -> DataFrame:
    member = F.when(F.expr("l_partkey % 3 = 0"), F.col("l_partkey") % member_keys)
    priced = lines.where("l_returnflag <> 'R'").select(
        F.expr(LINE_ID),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.expr("CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_partkey END").alias("product_id"),
        F.expr("concat('Part ', CAST(l_partkey AS STRING))").alias("product_name"),
        F.expr("CAST(l_quantity AS BIGINT)").alias("quantity_sold"),
        F.expr("CAST(l_extendedprice AS DECIMAL(12,2))").alias("sale_price"),
        F.expr(
            "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * "
            "(CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(16,4))"
        ).alias("cost_price"),
        F.expr("CASE WHEN l_linestatus = 'F' THEN 'Cash' END").alias("payment_method"),
        F.expr("CASE WHEN l_tax > 0 THEN concat('tax ', l_returnflag) END").alias("notes"),
        member.alias("member_id"),
        F.expr(
            "CASE WHEN l_partkey % 3 = 0 THEN CAST(FLOOR(l_quantity / 4.0) AS BIGINT) END"
        ).alias("member_qty_sold"),
        F.col("l_shipdate").alias("sold_at"),
    )
    return priced.withColumn(
        "profit",
        ((F.col("sale_price") - F.col("cost_price")) * F.col("quantity_sold")).cast(
            "decimal(24,4)"
        ),
    )


def restocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = star(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    member = F.when(F.expr("l_partkey % 4 = 0"), F.col("l_partkey") % _member_keys(spark, sf_dir))
    return lines.select(
        F.expr(LINE_ID),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("product_id"),
        F.expr("concat('Part ', CAST(l_partkey AS STRING))").alias("product_name"),
        F.expr("CAST(l_quantity AS BIGINT)").alias("quantity_added"),
        F.expr("CASE WHEN l_suppkey % 5 <> 0 THEN l_extendedprice END").alias("cost_per_unit"),
        F.col("l_shipdate").alias("restocked_at"),
        member.alias("member_id"),
        F.expr(
            "CASE WHEN l_partkey % 4 = 0 THEN CAST(FLOOR(l_quantity / 2.0) AS BIGINT) "
            "ELSE CAST(0 AS BIGINT) END"
        ).alias("member_qty"),
    )


def expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expenses_of(star(spark, sf_dir, "orders"))


def expenses_of(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey AS id",
        "o_orderpriority AS category",
        "CAST(o_totalprice AS DECIMAL(14,2)) AS amount",
        "CAST(o_orderdate AS DATE) AS expense_date",
    )


def settings_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir, "events").selectExpr(
        "CAST(user_id AS STRING) AS key", "props AS value", "ts AS written_at", "event_id AS seq"
    )


def slot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups post to the user's import slot, purchases poll it."""
    return slot_events_of(star(spark, sf_dir, "events"))


def slot_events_of(events: DataFrame) -> DataFrame:
    return events.where("event_type IN ('signup', 'purchase')").selectExpr(
        "user_id AS session",
        "event_id AS seq",
        "ts",
        "CASE WHEN event_type = 'signup' THEN 'import' ELSE 'poll' END AS kind",
        "CAST(event_id AS STRING) AS payload",
    )


LEDGER_ORDER = ["day", "order_id", "line_no", "kind_rank"]


def grouped_events(spark: SparkSession, sf_dir: str, shelves: int, voids: bool = True) -> DataFrame:
    """The same with many parts to a product, in the order ``[*LEDGER_ORDER, "part"]``."""
    events = ledger_events(spark, sf_dir, voids).withColumnRenamed("product_id", "part")
    shelf, ref = F.col("part") % shelves, F.concat_ws("-", "ref", "part")
    return events.withColumns({"product_id": shelf, "ref": ref})


def ledger_events(spark: SparkSession, sf_dir: str, voids: bool = True) -> DataFrame:
    """Sales, restocks and voids of one product each, in arrival order ``LEDGER_ORDER``.

    A sale with return flag A and line status O is voided ``VOID_DELAY_DAYS`` later.
    """
    member_keys = _member_keys(spark, sf_dir)
    return ledger_events_of(star(spark, sf_dir, "lineitem"), member_keys, voids)


def ledger_events_of(lines: DataFrame, member_keys: Column | int, voids: bool = True) -> DataFrame:
    restock = F.col("l_returnflag") == "R"
    voided = F.expr("l_returnflag = 'A' AND l_linestatus = 'O'")
    fronted = restock & F.expr("l_partkey % 4 = 0")
    day = F.col("l_shipdate").cast("date")
    first = F.struct(
        F.when(restock, "restock").otherwise("sale").alias("kind"),
        day.alias("day"),
        F.lit(0).alias("kind_rank"),
    )
    later = F.struct(
        F.lit("void").alias("kind"),
        F.date_add(day, VOID_DELAY_DAYS).alias("day"),
        F.lit(1).alias("kind_rank"),
    )
    # A line and its void leave in one pass over the table.
    steps = F.when(voided, F.array(first, later)).otherwise(F.array(first)) if voids else F.array(first)
    return (
        lines.withColumn("step", F.explode(steps))
        .select(
            F.col("l_partkey").alias("product_id"),
            F.col("step.day").alias("day"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("step.kind_rank").alias("kind_rank"),
            F.col("step.kind").alias("kind"),
            F.concat_ws("-", "l_orderkey", "l_linenumber", day).alias("ref"),
            F.when(F.col("step.kind") != "void", F.col("l_quantity").cast("bigint")).alias("n"),
            F.when(fronted, F.col("l_partkey") % member_keys).alias("member_id"),
            F.when(fronted, F.expr("CAST(FLOOR(l_quantity / 2.0) AS BIGINT)")).alias("member_n"),
            F.when(restock & F.expr("l_suppkey % 5 <> 0"), F.col("l_extendedprice")).alias(
                "unit_cost"
            ),
        )
    )
