"""What reading requests and folding events costs: each text is read once, by methods the JVM compiles."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from shelfledger.functions import coerce
from shelfledger.operators import ledger
from shelfledger.operators import validation as check
from shelfledger.plans import record
from shelfledger.sources.requests import product_requests

#: Methods with more bytes are never compiled by the JVM.
COMPILED = 8000
SALE = "id string, seq bigint, product_id string, product_name string, quantity_sold string, sale_price string, cost_price string, notes string, payment_method string, sold_at string"
RESTOCK = "id string, seq bigint, product_id string, product_name string, quantity_added string, cost_per_unit string, notes string, member_id string, member_qty string, restocked_at string"


@pytest.fixture
def requests(spark):
    sales = [
        ("a", 2, "1", "x", " 3 pcs", "2.5", None, "", "Cash", "2024-01-01"), ("b", 3, "1", "x", "0x1F", "1e2", "1", None, None, ""),
        ("c", 4, "", "x", "many", "", "1", None, None, "never"), ("d", 5, "1", "", "1", "2", "1", None, None, ""),
    ]
    restocks = [("r", 1, "1", "x", "40", "1.5", "", "6", "0X1f", "2024-01-01"), ("s", 6, "1", "x", "", "1", "", "", "all", "")]
    return spark.createDataFrame(sales, SALE), spark.createDataFrame(restocks, RESTOCK)


def largest_method(df):
    with contextlib.redirect_stdout(io.StringIO()) as said:
        df.explain("codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", said.getvalue())), default=0)


def test_parsing_stays_compiled(spark, requests):
    sales, restocks = requests
    for typed in (record.accepted_sales(sales, F.lit("2024-05-05")), check.normal_restocks(check.accepted(check.check_restocks(restocks)))):
        assert largest_method(typed) < COMPILED


def test_a_text_is_read_once(spark):
    rows = spark.createDataFrame([("0X1f",), ("-0x10 ",), (" 7 pcs",), ("many",), (None,), ("",)], "v string")
    parsed = rows.select("v", coerce.leading_int(F.col("v")).alias("n"))
    assert str(parsed._jdf.queryExecution().optimizedPlan()).count("regexp_extract") == 1
    assert [r.n for r in parsed.collect()] == [31, -16, 7, None, None, None]


def test_events_are_parsed_once(spark, requests):
    events = record.request_events(*requests)
    plan = str(events._jdf.queryExecution().optimizedPlan())
    assert "RLIKE" not in plan and "regexp" not in plan
    assert {(r.ref, r.kind, r.n) for r in events.collect()} == {("a", "sale", 3), ("b", "sale", 31), ("c", "sale", 1), ("r", "restock", 40)}


def test_only_kept_columns_go_through_the_fold(spark):
    shelf = spark.createDataFrame([(1, 5, 7, 3, None, "low_stock")], "id bigint, quantity bigint, member_id bigint, member_qty bigint, cost_price double, stock string")
    rows = [(1, 1, "sale", "a", 3, "long"), (1, 2, "void", "a", None, "text"), (1, 3, "sale", "b", 9, None)]
    events = spark.createDataFrame(rows, "product_id bigint, seq bigint, kind string, ref string, n bigint, notes string")
    whole = ledger.ledger_history(shelf, events, ["seq"])
    kept = ledger.ledger_history(shelf, events, ["seq"], keep=["seq"])
    fold = [line for line in str(kept._jdf.queryExecution().optimizedPlan()).splitlines() if "MapInArrow" in line]
    assert fold and not any("notes" in line for line in fold)
    assert sorted(kept.collect()) == sorted(whole.select(*kept.columns).collect())
    assert [(r.seq, r.quantity, r.member_qty, r.cost_price) for r in sorted(kept.collect(), key=lambda r: r.seq)] == [(1, 2, 2, None), (2, 5, 3, None), (3, 0, 0, None)]


def test_first_void_of_a_sale_among_many_that_name_none(spark):
    voids = spark.createDataFrame(
        [("v1", 9, "a"), ("v2", 5, "a"), ("v3", 1, "a"), (None, 2, "none"), (None, 3, "none"), (None, 1, "s"), ("v4", 4, "s"), ("v5", 5, None)],
        "id string, seq bigint, sale_id string",
    )
    recorded = spark.createDataFrame([("a", 1, 3)], "id string, product_id bigint, seq bigint")
    stored = spark.createDataFrame([("s", 1, 4, None)], "id string, product_id bigint, quantity_sold bigint, member_qty_sold bigint")
    checked = check.check_voids(voids, recorded, stored)
    assert {(r.sale_id, r.seq) for r in check.accepted(checked).collect()} == {("a", 5), ("s", 1)}
    assert checked.count() == voids.count()
    assert str(checked._jdf.queryExecution().optimizedPlan()).count("Join LeftOuter") == 1


def test_requests_of_a_single_file_are_dealt_out(spark, tmp_path):
    row = "id AS p_partkey, 'n' AS p_name, 'Brand#2' AS p_brand, 'SMALL' AS p_type, CAST(id % 50 AS INT) AS p_size, 1.5D AS p_retailprice"
    spark.range(1000).selectExpr(*row.split(", ")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in product_requests(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)
    assert sum(sizes) == 2000 and max(sizes) < 1000
