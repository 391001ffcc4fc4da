import math

import pytest
from pyspark.sql import functions as F

from shelfledger.functions import coerce, stock, text


def values(spark, column, data, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_leading_int(spark):
    data = ["", "0", "12abc", " 3", "3.7", "abc", None, "-4", "+5", "0x1F", "-0x10", "0x", " 7", "1e3",
            "99999999999999999999"]
    assert values(spark, coerce.leading_int(F.col("v")), data) == [
        None, 0, 12, 3, 3, None, None, -4, 5, 31, -16, 0, 7, 1, 2**63 - 1]


def test_int_or_takes_default_for_zero(spark):
    assert values(spark, coerce.int_or(F.col("v"), 1), ["0", "", "7", None]) == [1, 1, 7, 1]


def test_leading_float(spark):
    data = ["12.5kg", ".5", "5.", "1e2x", "-3.25", "e5", "", None, " \n8", "Infinity"]
    assert values(spark, coerce.leading_float(F.col("v")), data) == [
        12.5, 0.5, 5.0, 100.0, -3.25, None, None, None, 8.0, math.inf]


def test_defaults_differ(spark):
    data = ["", None, "x"]
    assert values(spark, coerce.text_or(F.col("v"), "d"), data) == ["d", "d", "x"]
    assert values(spark, coerce.empty_to_null(F.col("v")), data) == [None, None, "x"]
    assert values(spark, F.coalesce("v", F.lit("d")), data) == ["", "d", "x"]



def test_typed_values(spark):
    rows = spark.createDataFrame(
        [("0", "number"), ("0", "string"), ("false", "boolean"), ("false", "string"), ("7", "number"), ("true", "boolean"), (None, "string"), ("", "string")],
        "v string, v_type string",
    )
    assert [r[0] for r in rows.select(coerce.given(rows, "v")).collect()] == [False, True, False, True, True, True, False, False]


def test_array_json(spark):
    data = [None, [], ["a", 'q"']]
    assert values(spark, coerce.array_json(F.col("v")), data, "array<string>") == ["[]", "[]", '["a","q\\""]']


def test_bands_differ_for_negatives(spark):
    data = [-1, 0, 1, 5, 6]
    assert values(spark, stock.band_after_sale(F.col("v")), data, "bigint") == [
        "low_stock", "out_stock", "low_stock", "low_stock", "in_stock"]
    assert values(spark, stock.band_after_restock(F.col("v")), data, "bigint") == [
        "out_stock", "out_stock", "low_stock", "low_stock", "in_stock"]


@pytest.mark.parametrize(
    "term, hits",
    [
        ("OAK", ["Red oak", "oak_1"]),
        ("%", ["Red oak", "oak_1", "ÉCLAIR", "a\\b", "50%"]),
        ("k_1", ["oak_1"]),
        ("éclair", []),
        ("ÉCLAIR", ["ÉCLAIR"]),
        ("a\\b", ["a\\b"]),
        ("0%", ["50%"]),
    ],
)
def test_search_folds_ascii_only(spark, term, hits):
    data = ["Red oak", "oak_1", "ÉCLAIR", "a\\b", "50%", None]
    got = values(spark, text.contains_pattern(F.col("v"), term), data)
    assert [v for v, hit in zip(data, got) if hit] == hits and None not in got


def test_price_texts(spark):
    data = ["$1,299.00", "1,234,567", "Call us", ",", "now 5.999", ""]
    assert values(spark, text.price_of_text(F.col("v")), data) == [1299.0, 1234.0, None, None, 5.99, None]


def test_crumbs(spark):
    data = [["Vinyl Plank"], ["Bath", "Tile"], ["Sinks"], ["Drill bits"], ["Garden"], []]
    assert values(spark, text.category_of_crumbs(F.col("v")), data, "array<string>") == [
        "Flooring", "Flooring", "Vanity", "Tools", "Other", None]


def test_space_and_store(spark):
    assert values(spark, text.collapse_space(F.col("v")), [" a \n b ", "﻿"]) == ["a b", ""]
    assert values(spark, text.store_of_url(F.col("v")), ["https://lowes.com/x", "http://homedepot.com", "y"]) == [
        "Lowe's", "Home Depot", "Other"]
