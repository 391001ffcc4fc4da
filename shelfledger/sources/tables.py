"""Readers for the retail tables and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfledger.schemas import TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One retail table from ``root/name`` with its declared schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def seed_if_empty(target: DataFrame, seed: DataFrame) -> DataFrame:
    """``target``, or ``seed`` in the target's columns when it holds no row.

    One-row look-ahead, so a full table is not counted.
    """
    if not target.isEmpty():
        return target
    return target.unionByName(seed.select(*target.columns))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON object, NULL fields kept."""
    return df.select(row_json(*df.columns).alias(name))


def row_json(*columns: str | Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def keyed_json(df: DataFrame, key: str, name: str = "json") -> DataFrame:
    """Rows of a map keyed by id: the key as text and the row as JSON.

    One entry per row keeps the map distributed, however many keys there are.
    """
    return df.select(F.col(key).cast("string").alias("key"), row_json(*df.columns).alias(name))
