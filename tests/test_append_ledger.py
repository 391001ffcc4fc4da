"""Stored ledgers: pruning by month, appends that come twice or break off."""

import datetime

import pytest
from pyspark.sql import functions as F

from shelfledger.operators.filters import in_days
from shelfledger.sources import append_ledger
from shelfledger.sources.append_ledger import append_batch, read_ledger

SCHEMA = "id long, at timestamp_ntz, month_no int"
DAYS = [datetime.datetime(2023, 11, 3) + datetime.timedelta(hours=31 * i) for i in range(120)]


@pytest.fixture
def rows(spark):
    found = [(i, day, day.month) for i, day in enumerate(DAYS)] + [(900, None, None), (901, None, None)]
    return spark.createDataFrame(found, SCHEMA)


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "ledger")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_repeated_batch_adds_nothing(spark, rows, path):
    assert append_batch(rows.where("id < 50"), path, "a", "at")
    assert not append_batch(rows.where("id < 50"), path, "a", "at")
    assert append_batch(rows.where("id >= 50"), path, "b", "at")
    assert not append_batch(rows.where("id >= 50"), path, "b", "at")
    assert ids(read_ledger(spark, path, rows.schema, "at")) == ids(rows)
    assert {tuple(r) for r in append_ledger.batches(spark, path).collect()} == {("a", 50), ("b", 72)}


def test_equal_rows_of_two_batches_both_count(spark, rows, path):
    for batch in "ab":
        append_batch(rows, path, batch, "at")
    assert read_ledger(spark, path, rows.schema, "at").count() == 2 * rows.count()


def test_a_broken_attempt_is_unseen_and_written_over(spark, rows, path, monkeypatch):
    append_batch(rows.where("id < 10"), path, "a", "at")
    placed = rows.where("id >= 10").withColumns({"month": append_ledger.month_of("at"), "batch": F.lit("b")})
    placed.where("id % 2 = 0").write.mode("append").partitionBy("month", "batch").parquet(path)  # and then the sender died
    assert ids(read_ledger(spark, path, rows.schema, "at")) == list(range(10))
    assert append_batch(rows.where("id >= 10"), path, "b", "at")
    assert ids(read_ledger(spark, path, rows.schema, "at")) == ids(rows)


@pytest.mark.parametrize(
    ("start", "end"),
    [(None, None), ("2023-12-05", "2024-01-20"), ("2024-02-29", None), (None, "2023-11-30"), (datetime.date(2024, 1, 1), "2024-01-01"),
     ("2024-03-01", "2024-02-01"), ("no day", None), (None, "2024-13-01"), ("", "")],
)
def test_ranges_equal_the_filter_alone(spark, rows, path, start, end):
    for k in range(3):
        append_batch(rows.where(F.col("id") % 3 == k), path, f"part {k}/x=1", "at")
    assert ids(read_ledger(spark, path, rows.schema, "at", start, end)) == ids(rows.where(in_days("at", start, end)))


def test_a_range_opens_its_months_alone(spark, rows, path):
    append_batch(rows, path, "a", "at")
    found = read_ledger(spark, path, rows.schema, "at", "2023-12-05", "2024-01-20")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and ">= 2023-12" in plan and "<= 2024-01" in plan
    files = append_ledger._files(spark, path, rows.schema)
    opened = files.where(append_ledger.in_months("2023-12-05", "2024-01-20")).select("_metadata.file_path").distinct().collect()
    assert {r.file_path.split("month=")[1][:7] for r in opened} == {"2023-12", "2024-01"}
    assert files.select("month").distinct().count() > 4


def test_empty_batch_and_empty_ledger(spark, rows, path):
    assert append_batch(rows.where("id < 0"), path, "none", "at")
    assert not append_batch(rows.where("id < 0"), path, "none", "at")
    assert ids(read_ledger(spark, path, rows.schema, "at")) == []
    assert [tuple(r) for r in append_ledger.batches(spark, path).collect()] == [("none", 0)]


def test_a_month_is_not_one_file_per_task(spark, rows, path):
    append_batch(rows.repartition(16), path, "a", "at")
    files = append_ledger._files(spark, path, rows.schema).select("month", F.col("_metadata.file_path").alias("f")).distinct()
    assert max(r["count"] for r in files.groupBy("month").count().collect()) == 1
