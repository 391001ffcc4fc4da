"""Streams replayed in several micro-batches give what one batch gives."""

import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from test_ledger import EVENTS, PRODUCTS, random_case, walk

from shelfledger.operators import ledger
from shelfledger.operators.ledger import typed_events
from shelfledger.operators.ordered import split_hot
from shelfledger.operators.slot import poll_results
from shelfledger.plans import registry
from shelfledger.plans.registry import QUERIES, _stream
from shelfledger.session import ship_package
from shelfledger.streaming import state_table
from shelfledger.streaming.ledger_stream import latest_state, ledger_step, stored_history, stream_ledger
from shelfledger.streaming.runs import drain, drain_latest
from shelfledger.streaming.slot_stream import stream_slot, waiting_imports
from shelfledger.streaming.totals_stream import stream_expenses, stream_product_sales

SLOT = "session bigint, seq bigint, ts timestamp_ntz, kind string, payload string"


def replay(spark, rows, schema, path, parts):
    """A stream that reads the rows in as many micro-batches as parts."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        chunk = rows[i * size : (i + 1) * size]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option(
        "maxFilesPerTrigger", 1
    ).parquet(path)


def shown(history):
    return sorted(
        str(tuple(r))
        for r in history.select(
            "product_id", "seq", "kind", "member_sold", "quantity", "member_qty", "current_member",
            "cost_price", "stock", "applied",
        ).collect()
    )


@pytest.mark.parametrize(("seed", "hot_rows"), [(21, 10_000), (22, 10), (23, 10_000)])
def test_ledger_stream_matches_walk(spark, tmp_path, seed, hot_rows):
    shelf, events = random_case(seed, products=3, events=90)
    events.append((None, 90, "sale", "loose", 2, None, None, None))
    stream = replay(spark, events, EVENTS, str(tmp_path / "events"), 3)
    path = str(tmp_path / "ledger")
    history = stream_ledger(spark.createDataFrame(shelf, PRODUCTS), stream, ["seq"], hot_rows, path)
    rows, states = walk(shelf, events)
    assert shown(history) == sorted(map(str, rows))
    assert len(list(Path(path, "history").glob("_batch=[0-9]*"))) == 3
    moved = {r[0] for r in rows if r[0] in states}
    final = {r[0]: tuple(r)[1:] for r in latest_state(history, ["seq"]).collect()}
    assert final == {k: v for k, v in states.items() if k in moved}


def test_ledger_stream_goes_on_and_repeats_nothing(spark, tmp_path, monkeypatch):
    """Many small micro-batches with whole states between, a second run, and a step that runs twice."""
    monkeypatch.setattr(state_table, "WHOLE_EVERY", 3)
    shelf, events = random_case(31, products=3, events=80)
    products, path = spark.createDataFrame(shelf, PRODUCTS), str(tmp_path / "ledger")
    for part in (events[:40], events[40:]):
        stream = replay(spark, part, EVENTS, str(tmp_path / "events"), 5)
        history = stream_ledger(products, stream, ["seq"], path=path)
    assert shown(history) == sorted(map(str, walk(shelf, events)[0]))
    form = typed_events(stream).schema
    step = ledger_step(spark, products, form, ["seq"], path)
    step(spark.createDataFrame(events[72:], EVENTS), 9)  # the last micro-batch, as after a failure
    assert shown(stored_history(spark, path, form)) == sorted(map(str, walk(shelf, events)[0]))


def test_a_product_that_fills_a_micro_batch_is_cut(spark, tmp_path, monkeypatch):
    """A third of all rows is one product; its rows are dealt to several tasks."""
    rows = [(1 if i % 3 else 100 + i, i, "sale" if i % 2 else "restock", f"e{i}", 3, None, None, 2.5) for i in range(600)]
    shelf = [(p, 50, None, 0, 1.0, "in_stock") for p in {r[0] for r in rows}]
    cuts, cut = [], ledger.cut_blocks
    monkeypatch.setattr(ledger, "cut_blocks", lambda *a: cuts.append(cut(*a)) or cuts[-1])
    stream = replay(spark, rows, EVENTS, str(tmp_path / "events"), 2)
    history = stream_ledger(spark.createDataFrame(shelf, PRODUCTS), stream, ["seq"], 40, str(tmp_path / "ledger"))
    assert shown(history) == sorted(map(str, walk(shelf, rows)[0]))
    assert len(cuts) == 2
    for blocks in cuts:
        sizes = [r["count"] for r in blocks.where("product_id = 1").groupBy("_block").count().collect()]
        assert len(sizes) >= 4 and max(sizes) <= 100


def test_state_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state_table, "WHOLE_EVERY", 2)
    form = spark.createDataFrame([], "k long, v string").schema
    table = state_table.StateTable(spark, str(tmp_path / "t"), form, ["k"])
    at = lambda n: {tuple(r) for r in table.before(n).collect()}
    table.start(spark.createDataFrame([(1, "a"), (None, "b")], form))
    table.save(spark.createDataFrame([(1, "c")], form), 0)
    table.save(spark.createDataFrame([(2, "gone"), (None, "d")], form), 1, "v <> 'gone'")
    table.save(spark.createDataFrame([(3, "e")], form), 2)
    assert at(0) == {(1, "a"), (None, "b")} and at(1) == {(1, "c"), (None, "b")}
    assert at(2) == {(1, "c"), (None, "d")} and at(3) == {(1, "c"), (None, "d"), (3, "e")}
    table.save(spark.createDataFrame([(4, "f")], form), 2)  # the same batch again
    assert at(3) == {(1, "c"), (None, "d"), (4, "f")}


def slot_rows():
    start = datetime(2024, 1, 1)
    steps = [
        (1, 0, "poll"), (1, 1, "import"), (1, 2, "import"), (1, 10, "poll"), (1, 11, "poll"),
        (2, 0, "import"), (2, 119.999, "poll"), (3, 0, "import"), (3, 120, "poll"),
        (None, 5, "import"), (None, 6, "poll"),
    ]
    return [
        (session, seq, start + timedelta(seconds=at), kind, f"p{seq}" if kind == "import" else None)
        for seq, (session, at, kind) in enumerate(steps)
    ]


EXPECTED = {0: None, 3: "p2", 4: None, 6: "p5", 8: None, 10: "p9"}


@pytest.mark.parametrize("hot_rows", [1000, 1])
def test_slot(spark, hot_rows):
    df = spark.createDataFrame(slot_rows(), SLOT)
    assert {r.seq: r.payload for r in poll_results(df, hot_rows=hot_rows).collect()} == EXPECTED


@pytest.mark.parametrize("hot_rows", [1000, 1])
def test_slot_stream(spark, tmp_path, hot_rows):
    stream = replay(spark, slot_rows(), SLOT, str(tmp_path / "slot"), 4)
    got = {r.seq: r.payload for r in stream_slot(stream, hot_rows=hot_rows, path=str(tmp_path / "out")).collect()}
    assert got == EXPECTED


def test_waiting_imports_expire(spark, tmp_path):
    """An import that nobody polls leaves the state when its time is up; one that still counts stays."""
    start = datetime(2024, 1, 1)
    rows = [(s, i, start + timedelta(seconds=at), kind, f"p{i}") for i, (s, at, kind) in enumerate([
        (1, 0, "import"), (2, 10, "import"), (3, 200, "import"), (4, 400, "poll"), (5, 500, "import"), (6, 660, "poll"), (2, 661, "poll"), (7, 662, "import"),
    ])]
    wanted = {r.seq: r.payload for r in poll_results(spark.createDataFrame(rows, SLOT)).collect()}
    path, events = str(tmp_path / "out"), spark.createDataFrame([], SLOT)
    held = []
    for k in range(0, len(rows), 2):
        stream = replay(spark, rows[k : k + 2], SLOT, str(tmp_path / "slot"), 1)
        got = stream_slot(stream, late=60, path=path)
        held.append(sorted(r.session for r in waiting_imports(spark, path, events).collect()))
    assert {r.seq: r.payload for r in got.collect()} == wanted
    assert held == [[1, 2], [], [5], [5, 7]]
    table = spark.read.parquet(f"{path}/waiting")
    assert table.where("kind = 'expired'").count() == 3


def test_registered_streams_take_several_micro_batches(spark, tmp_path, monkeypatch):
    for name, folder in (("stream_ledger", "history"), ("stream_slot", "polls")):
        paths = []
        real = registry.staging_path
        monkeypatch.setattr(registry, "staging_path", lambda s, n, real=real, paths=paths: paths.append(real(s, n)) or paths[-1])
        QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len([p for p in Path(paths[0], folder).iterdir() if p.is_dir() and "=-1" not in p.name]) == registry.TURNS
        monkeypatch.undo()


def test_totals_stream(spark, tmp_path):
    sales = [(1, 2, 10, 4, 12), (1, 1, 5, 1, 4), (2, 3, 1, 2, -3), (None, 1, 9, 0, 9)]
    schema = (
        "product_id bigint, quantity_sold bigint, sale_price bigint, cost_price bigint, profit bigint"
    )
    stream = replay(spark, sales, schema, str(tmp_path / "sales"), 4)
    got = drain_latest(stream_product_sales(stream), "sales", ["product_id"]).collect()
    assert sorted(map(tuple, got)) == [(1, 3, 25.0, 9.0, 16.0, 2), (2, 3, 3.0, 6.0, -3.0, 1)]
    spent = [("a", 1.5, None), ("b", 2.0, None), ("a", 0.5, None)]
    stream = replay(spark, spent, "category string, amount double, expense_date date", str(tmp_path / "e"), 3)
    got = drain_latest(stream_expenses(stream), "expenses", ["category"]).collect()
    assert dict(map(tuple, got)) == {"a": 2.0, "b": 2.0}


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("stream_")])
def test_tables_of_several_part_files(spark, tmp_path, name):
    """A table as a folder of part files gives what the single file gives."""
    ship_package()
    whole = Path("/root/testdata/sf0.001")
    for table in ("lineitem", "orders", "events", "pages", "supplier", "part"):
        rows = spark.read.parquet(str(whole / f"{table}.parquet"))
        rows.repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    wanted = QUERIES[name](spark, str(whole)).collect()
    found = QUERIES[name](spark, str(tmp_path)).collect()
    assert wanted and sorted(map(str, found)) == sorted(map(str, wanted))


def test_partitioned_table(spark, tmp_path):
    rows = spark.range(6).selectExpr("id", "CAST(id % 2 AS INT) AS month")
    rows.write.partitionBy("month").parquet(str(tmp_path / "sales.parquet"))
    rows.write.parquet(str(tmp_path / "sales.parquet2"))
    found = drain(_stream(spark, str(tmp_path), "sales"), "parts").select("id", "month").collect()
    assert sorted(map(tuple, found)) == [(i, i % 2) for i in range(6)]


def test_totals_of_no_input(spark, tmp_path):
    schema = "category string, amount double, expense_date date"
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "none"))
    assert drain_latest(stream_expenses(stream), "expenses", ["category"]).collect() == []


def test_split_keeps_every_row(spark):
    df = spark.createDataFrame([(k, i) for k in (None, 1, 2) for i in range(3 if k == 2 else 6)], "k int, i int")
    split = split_hot(df, "k", 5)
    assert split.hot_rows == 12
    assert {r.k for r in split.hot.collect()} == {None, 1}
    assert split.hot.count() + split.cold.count() == df.count()
