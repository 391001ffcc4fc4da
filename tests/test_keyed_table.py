"""Changes to a stored table rewrite the files that hold a changed key, and no others."""

import pytest
from pyspark.sql import functions as F

from shelfledger.operators import maintenance
from shelfledger.sources.keyed_table import KeyedTable

SCHEMA = "id long, name string, n long"


@pytest.fixture
def rows(spark):
    return spark.range(2000).selectExpr("id", "concat('p', id) AS name", "id % 7 AS n")


@pytest.fixture
def table(spark, rows, tmp_path):
    made = KeyedTable(spark, str(tmp_path / "table"), rows.schema)
    made.create(rows, 10)
    return made


def held(df):
    return sorted(map(str, df.collect()))


def changes(spark, ids):
    rows = [(i, f"new {i}", None, s) for s, i in enumerate(ids)] + [(i, f"last {i}", 5, 10_000) for i in list(ids)[:1]]
    return spark.createDataFrame(rows, SCHEMA + ", seq long")


def files_of(table, ids):
    found = table.read().where(F.col("id").isin(list(ids))).select(F.col("_metadata.file_path").alias("f")).distinct()
    return {r.f for r in found.collect()}


def test_created(table, rows):
    assert held(table.read()) == held(rows) and len(table.files()) == 10 and table.version() == 0


def test_upsert_of_one_percent_touches_its_files(spark, table, rows):
    some = changes(spark, range(700, 720))
    before, hit = table.files(), files_of(table, range(700, 720))
    change = table.upsert(some)
    assert set(change.removed) == hit and len(hit) <= 2 and len(change.added) <= len(hit)
    assert set(before) - hit <= set(table.files())
    assert held(table.read()) == held(maintenance.upsert(rows, some).select(*rows.columns))
    assert held(table.read(0)) == held(rows)  # readers of the version before


def test_inserts_and_updates(spark, table, rows):
    some = changes(spark, [5, 1999, 5000, 5001, 5])
    change = table.upsert(some)
    assert len(change.removed) == 2
    assert held(table.read()) == held(maintenance.upsert(rows, some))
    again = table.upsert(changes(spark, [5001]))
    assert again.version == 2 and len(again.removed) == 1


def test_overwrite_delete_and_edit(spark, table, rows):
    some = changes(spark, [3, 4, 9999])
    change = table.overwrite(some, ["n"])
    wanted = maintenance.overwrite(rows, some, ["n"])
    assert len(change.removed) == 1 and held(table.read()) == held(wanted)
    gone = spark.createDataFrame([(i,) for i in range(1000, 1300)], "id long")
    assert len(table.delete(gone).removed) <= 3
    assert held(table.read()) == held(maintenance.delete(wanted, gone))


def test_nothing_to_change(spark, table, rows):
    none = changes(spark, [])
    for change in (table.upsert(none), table.overwrite(changes(spark, [7777]), ["n"]), table.delete(none)):
        assert change.removed == [] and change.added == []
    assert held(table.read()) == held(rows)
    everything = table.read().select("id")
    table.delete(everything)
    assert table.read().count() == 0
    table.upsert(changes(spark, [1]))
    assert table.read().count() == 1


def test_two_writers_of_one_version(spark, table):
    other = KeyedTable(spark, table.path, table.schema)
    version = other.version()
    table.delete(spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(Exception, match="already exists"):
        other._commit(version + 1, other.files(version), [])
