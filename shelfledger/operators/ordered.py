"""Order-dependent work per key that survives a key holding much of the data.

A window over one key is one task. Keys with more than ``hot_rows`` rows are
therefore split off and cut into consecutive blocks by a range partitioning on
(key, order); running values are taken within each block and completed from the
totals of the blocks before it. All other keys use a plain window. Both ways
see every row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfledger.session import stage

HOT_ROWS = 250_000
# A hot key has over HOT_ROWS rows, so N rows hold at most N / HOT_ROWS of them.
# Beyond this many the key list is joined by shuffle.
BROADCAST_KEYS = 500_000
BLOCK = "_block"


class Split(NamedTuple):
    cold: DataFrame
    hot: DataFrame | None
    hot_rows: int
    keys: DataFrame | None

    def cold_of(self, df: DataFrame, key: str) -> DataFrame:
        return df if self.keys is None else _on_keys(df, self.keys, key, "left_anti")

    def hot_of(self, df: DataFrame, key: str) -> DataFrame:
        return _on_keys(df, self.keys, key, "left_semi")


class Counts(NamedTuple):
    """Keys with more than the limit of rows, how many there are, and how many rows they hold."""

    keys: DataFrame
    n_keys: int
    rows: int


def count_keys(df: DataFrame, key: str, hot_rows: int) -> Counts:
    """One pass over ``df``; its outcome is staged, so that all readers agree on it."""
    counted = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot_rows)
    counted = stage(counted, "key-counts")
    n_keys, rows = counted.agg(F.count("*"), F.sum("_rows")).first()
    return Counts(counted.select("_key"), n_keys, rows or 0)


def split_counted(df: DataFrame, key: str, counts: Counts) -> Split:
    """Rows of ordinary keys and, if there are any, rows of hot keys."""
    if not counts.n_keys:
        return Split(df, None, 0, None)
    keys = _sized(counts)
    cold, hot = _on_keys(df, keys, key, "left_anti"), _on_keys(df, keys, key, "left_semi")
    return Split(cold, hot, counts.rows, keys)


def _sized(counts: Counts) -> DataFrame:
    return F.broadcast(counts.keys) if counts.n_keys <= BROADCAST_KEYS else counts.keys


def of_keys(counts: Counts):
    """A join (semi or anti) with the counted keys: ``join(df, key, how)``."""
    keys = _sized(counts)
    return lambda df, key, how: _on_keys(df, keys, key, how)


def split_hot(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> Split:
    return split_counted(df, key, count_keys(df, key, hot_rows))


def _on_keys(df: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    # NULL is a key like any other: it may be the hot one.
    return df.join(keys, df[key].eqNullSafe(keys["_key"]), how)


def cut_blocks(
    df: DataFrame, rows: int, key: str, order: Sequence[str], block_rows: int = HOT_ROWS
) -> DataFrame:
    """Adds a block number that grows with the order inside each key.

    A block is one range partition, of about ``block_rows`` rows whatever the
    keys are. The result is staged: a second run could draw other bounds. It is
    staged in order, since later sorts of the same rows then meet sorted runs.
    """
    parts = max(1, math.ceil(rows / block_rows))
    ranged = df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    return stage(ranged.withColumn(BLOCK, F.spark_partition_id()), "blocks")


def ordered_window(key: str, order: Sequence[str]):
    return Window.partitionBy(key).orderBy(*order)


def block_window(key: str, order: Sequence[str]):
    return Window.partitionBy(key, BLOCK).orderBy(*order)


def up_to_here(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before_here(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def join_blocks(rows: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Bring one row per (key, block) back to the block's rows; the key may be NULL."""
    right = totals.withColumnsRenamed({key: "_right_key", BLOCK: "_right_block"})
    same = rows[key].eqNullSafe(right["_right_key"]) & (rows[BLOCK] == right["_right_block"])
    return rows.join(right, same, "left").drop("_right_key", "_right_block")


def previous_row(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    columns: Sequence[str],
    name: str = "previous",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds a struct of ``columns`` of the preceding row of the key, NULL for the first."""
    row = F.struct(*columns)
    cold, hot, count, _ = split_hot(df, key, hot_rows)
    result = cold.withColumn(name, F.lag(row).over(ordered_window(key, order)))
    if hot is None:
        return result
    blocks = cut_blocks(hot, count, key, order, hot_rows)
    ends = blocks.groupBy(key, BLOCK).agg(F.max_by(row, F.struct(*order)).alias("_end"))
    # One row per block of a hot key.
    ends = ends.withColumn("_carried", F.lag("_end").over(ordered_window(key, [BLOCK])))
    local = blocks.withColumn(name, F.lag(row).over(block_window(key, order)))
    carried = join_blocks(local, ends.drop("_end"), key)
    completed = carried.withColumn(name, F.coalesce(name, "_carried")).select(*df.columns, name)
    return result.unionByName(completed)
