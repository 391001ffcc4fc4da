"""What a micro-batch costs: its voids search the history once."""

from shelfledger.streaming.ledger_stream import _PLACED, stored_voids

EVENT = "product_id bigint, kind string, ref string, n bigint, member_n bigint, seq bigint"


def test_voids_search_the_history_once(spark):
    events = spark.createDataFrame([(1, "void", "a", None, None, 5), (1, "void", "b", 4, 1, 6), (1, "sale", "c", 2, None, 7), (1, None, "d", 2, None, 8)], EVENT)
    rows = [(1, "sale", "a", 3, 2, 1, 0, True), (1, "sale", "c", 9, 0, 2, 0, True)]
    history = spark.createDataFrame(rows, f"product_id bigint, kind string, ref string, n bigint, member_sold bigint, seq bigint, {_PLACED} bigint, applied boolean")
    told = stored_voids(events, history, ["seq"])
    # What is left to run reads the staged voids and joins nothing.
    assert "Join" not in str(told._jdf.queryExecution().optimizedPlan())
    assert sorted((r.seq, r.n, r.member_n) for r in told.collect()) == [(5, 3, 2), (6, 4, 1), (7, 2, None), (8, 2, None)]
