"""The import slot on a stream: one mailbox per session, emptied by a poll or by time.

Every micro-batch runs the batch rule with the imports that wait from before as
its first events, so a session of any size is cut like in a batch. What waits is
a table with a row per session. Age is measured on event times, so a replay gives
the same answers, and an import whose time is up at the latest time seen, less
``LATE_SECONDS`` for events that come out of order, leaves the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampNTZType

from shelfledger.operators.ordered import HOT_ROWS
from shelfledger.operators.slot import SLOT_SECONDS, poll_results
from shelfledger.session import stage, staging_path
from shelfledger.streaming.runs import run_to_end
from shelfledger.streaming.state_table import StateTable

LATE_SECONDS = 3600
_WAITING = "kind = 'import'"
_CLOCK = StructType().add("clock", "string").add("seen", TimestampNTZType())


def slot_step(
    spark: SparkSession, events: DataFrame, path: str, seconds: float = SLOT_SECONDS, late: float = LATE_SECONDS, hot_rows: int = HOT_ROWS
) -> Callable[[DataFrame, int], None]:
    """What a micro-batch of ``events`` does: polls go to ``path/polls``, what waits to ``path/waiting``."""
    columns = ["session", "seq", "ts", "kind", "payload"]
    form = events.select(*columns).schema
    waiting = StateTable(spark, f"{path}/waiting", form, ["session"])
    clock = StateTable(spark, f"{path}/clock", _CLOCK, ["clock"])
    waiting.start(spark.createDataFrame([], form))
    clock.start(spark.createDataFrame([], _CLOCK))
    polls = [form[c] for c in ("session", "seq", "ts", "payload")]
    spark.createDataFrame([], StructType(polls)).write.mode("ignore").parquet(f"{path}/polls/batch=-1")
    up = F.make_dt_interval(secs=F.lit(seconds + late))

    def step(batch: DataFrame, number: int) -> None:
        arrived = stage(batch.select(*columns), "arrived")
        before = stage(waiting.before(number).where(_WAITING), "waiting")
        poll_results(before.unionByName(arrived), seconds, hot_rows).write.mode("overwrite").parquet(f"{path}/polls/batch={number}")
        seen = clock.before(number).select("seen").unionByName(arrived.select(F.col("ts").alias("seen")))
        clock.save(seen.agg(F.max("seen").alias("seen")).select(F.lit("all").alias("clock"), "seen"), number)
        now = clock.before(number + 1).first()["seen"]
        # The last event of a session decides what waits: an import, or nothing.
        new = F.lit(True).alias("_new")
        every = before.withColumn("_new", F.lit(False)).unionByName(arrived.select("*", new))
        last = every.groupBy("session").agg(F.max_by(F.struct(*columns[1:]), F.struct("ts", "seq")).alias("_last"), F.max("_new").alias("_new"))
        gone = F.lit(False) if now is None else F.lit(now) - F.col("ts") >= up
        changed = last.select("session", "_last.*", "_new").withColumn("_gone", gone).where("_new OR _gone")
        # A row whose time is up is written once more, so that it counts no longer.
        waiting.save(changed.withColumn("kind", F.when(F.col("_gone"), F.lit("expired")).otherwise(F.col("kind"))), number, _WAITING)

    return step


def waiting_imports(spark: SparkSession, path: str, events: DataFrame) -> DataFrame:
    """The imports that still wait after all micro-batches."""
    form = events.select("session", "seq", "ts", "kind", "payload").schema
    return StateTable(spark, f"{path}/waiting", form, ["session"]).before(1 << 62).where(_WAITING)


def stream_slot(
    events: DataFrame, seconds: float = SLOT_SECONDS, late: float = LATE_SECONDS, hot_rows: int = HOT_ROWS, path: str | None = None
) -> DataFrame:
    """Runs a stream of imports and polls to its end; each poll with the payload it receives."""
    spark = events.sparkSession
    path = path or staging_path(spark, "slot")
    run_to_end(events, slot_step(spark, events, path, seconds, late, hot_rows), f"{path}/checkpoint")
    names = ["session", "seq", "ts", "payload"]
    return spark.read.schema(events.select(*names).schema).option("recursiveFileLookup", "true").parquet(f"{path}/polls")
