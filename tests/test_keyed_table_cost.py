"""What a change of a stored table costs: one shuffle of its rows, files that a task can sort."""

import contextlib
import io

from pyspark.sql import functions as F

from shelfledger.operators import maintenance
from shelfledger.sources import keyed_table
from shelfledger.sources.keyed_table import KeyedTable

ROWS = "id string, a bigint, b string"


def table(spark, path, rows, files=4):
    made = KeyedTable(spark, str(path), rows.schema)
    return made, made.create(rows, files)


def test_a_merge_shuffles_the_table_once(spark, tmp_path, monkeypatch):
    rows = spark.range(400).selectExpr("CAST(id AS STRING) AS id", "id AS a", "'x' AS b")
    held, _ = table(spark, tmp_path, rows.unionByName(spark.createDataFrame([(None, 7, "x")], ROWS)))
    changes = spark.createDataFrame(
        [("5", 1, None), ("5", 2, "new"), ("77", 1, None), ("none", 1, "new"), (None, 1, "new")], "id string, seq bigint, b string"
    )
    plans, store = [], KeyedTable._store

    def watch(self, placed):
        with contextlib.redirect_stdout(io.StringIO()) as said:
            placed.explain("formatted")
        plans.append(said.getvalue().split("\n\n")[0])
        return store(self, placed)

    monkeypatch.setattr(KeyedTable, "_store", watch)
    wanted = maintenance.overwrite(held.read(), changes, ["b"])
    # Without a broadcast, as for changes of any size.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        change = held.overwrite(changes, ["b"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans[-1].count("Exchange") == 1 and plans[-1].count("- Sort") == 1 and "Join" not in plans[-1]
    order = lambda df: sorted(map(str, df.collect()))
    assert order(held.read()) == order(wanted)
    assert {(r.id, r.b) for r in held.read().where("b IS NULL OR b <> 'x'").collect()} == {("5", "new"), ("77", None)}
    assert change.removed and set(change.removed).isdisjoint(held.files())


def test_large_tables_have_more_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed_table, "FILE_ROWS", 100)
    held, made = table(spark, tmp_path, spark.range(1000).select(F.col("id").cast("string"), F.col("id").alias("a"), F.lit("x").alias("b")), 2)
    assert len(made.added) >= 9 and held.read().count() == 1000
