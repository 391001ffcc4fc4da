"""Append-only ledgers on files: rows by month and batch, and a log of finished batches.

A ledger is a folder with ``month=<yyyy-MM>/batch=<id>`` inside and a ``_log`` of
the batches that are whole. A batch id names its rows for good: a batch that is
in the log is not written again, so a retried append adds nothing, and one whose
first attempt broke off is written over. Readers see batches of the log alone.

A range of days carries over to months, so a reader opens the folders of these
months and no others. Rows without a time lie in a folder of their own that no
range opens.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfledger.operators.filters import all_of, as_day, in_days

Day = str | date | None

MONTH, BATCH = "month", "batch"
_LOG = "batch string, n_rows long"


def month_of(time: str | Column) -> Column:
    return F.date_format(time, "yyyy-MM")


def _log(spark: SparkSession, path: str) -> DataFrame:
    log = f"{path}/_log"
    spark.createDataFrame([], _LOG).write.mode("ignore").parquet(log)
    return spark.read.schema(_LOG).parquet(log)


def append_batch(rows: DataFrame, path: str, batch: str, time: str) -> bool:
    """Appends ``rows`` once under the id ``batch``; False if that was done before.

    Every month goes to as few files as its size asks for, sorted by time, so that
    the statistics of a file tell its days apart.
    """
    spark = rows.sparkSession
    if not _log(spark, path).where(F.col(BATCH) == batch).isEmpty():
        return False
    placed = rows.withColumns({MONTH: month_of(time), BATCH: F.lit(batch)})
    files = placed.hint("rebalance", F.col(MONTH)).sortWithinPartitions(MONTH, time)
    # Over what a broken attempt at this batch may have left, and nothing else.
    writer = files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(MONTH, BATCH).parquet(path)
    n_rows = _files(spark, path, rows.schema).where(F.col(BATCH) == batch).count()
    spark.createDataFrame([(batch, n_rows)], _LOG).write.mode("append").parquet(f"{path}/_log")
    return True


def _files(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    placed = StructType([*schema.fields]).add(MONTH, "string").add(BATCH, "string")
    return spark.read.schema(placed).parquet(path)


def in_months(start: Day, end: Day) -> Column:
    """The months that a range of days lies in."""
    return all_of(
        [
            F.col(MONTH) >= month_of(as_day(start)) if start else None,
            F.col(MONTH) <= month_of(as_day(end)) if end else None,
        ]
    )


def read_ledger(
    spark: SparkSession, path: str, schema: StructType, time: str, start: Day = None, end: Day = None
) -> DataFrame:
    """The rows of all whole batches within an inclusive range of days, both ends optional.

    An unreadable day matches nothing.
    """
    rows = _files(spark, path, schema).where(in_months(start, end) & in_days(time, start, end))
    return rows.join(_log(spark, path).select(BATCH).distinct(), BATCH, "left_semi").select(*schema.names)


def batches(spark: SparkSession, path: str) -> DataFrame:
    """The finished batches and how many rows each added."""
    return _log(spark, path).groupBy(BATCH).agg(F.max("n_rows").alias("n_rows"))
