"""The import slot: a mailbox per session that a poll empties.

A poll gets the import right before it in its session, if that is fresh. An
earlier one cannot be there: either a later import replaced it, or a poll took
it, or it was already too old for that poll and has only aged since.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfledger.operators.ordered import HOT_ROWS, previous_row

# Fixed value: seconds an import stays available; the limit itself is too late.
SLOT_SECONDS = 120


def is_fresh(now, posted, seconds: float):
    return (now - posted) < F.make_dt_interval(secs=F.lit(seconds))


def poll_results(
    events: DataFrame, seconds: float = SLOT_SECONDS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Each poll with the payload it receives, or NULL.

    ``events`` has ``session, seq, ts, kind, payload``; kind is import or poll.
    """
    placed = previous_row(
        events, "session", ["ts", "seq"], ["kind", "ts", "payload"], hot_rows=hot_rows
    )
    before = F.col("previous")
    hit = (before["kind"] == "import") & is_fresh(F.col("ts"), before["ts"], seconds)
    return placed.where("kind = 'poll'").select(
        "session", "seq", "ts", F.when(hit, before["payload"]).alias("payload")
    )
