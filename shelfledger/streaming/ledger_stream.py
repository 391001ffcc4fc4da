"""The stock ledger on a stream of events.

Every micro-batch runs the batch ledger from the state that the one before left,
so a product that fills a micro-batch is cut into blocks like any other hot
product and no product's events are gathered in one place. Within a micro-batch
events are put in order, across micro-batches the order is that of the source.

The state is a table with a row per product; the history written so far holds
the shares of earlier sales, which voids look up. A micro-batch reads only what
lies before it and writes over its own folder, so one that is run again after a
failure neither loses nor repeats an event.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfledger.operators.ledger import openings, raw_history, shown_cost, typed_events
from shelfledger.operators.ordered import HOT_ROWS
from shelfledger.schemas import HISTORY, STOCK, schema
from shelfledger.session import stage, staging_path
from shelfledger.streaming.runs import run_to_end
from shelfledger.streaming.state_table import StateTable

_STATE = StructType([*schema(product_id="bigint"), *STOCK])
_PLACED = "_batch"


def _earlier(spark: SparkSession, path: str, form: StructType, batch: int) -> DataFrame:
    """History rows of the micro-batches before ``batch``."""
    rows = spark.read.schema(StructType([*form.fields]).add(_PLACED, "long")).option("basePath", path).parquet(path)
    return rows.where(F.col(_PLACED) < batch)


def stored_voids(events: DataFrame, history: DataFrame, order: Sequence[str]) -> DataFrame:
    """Gives voids of earlier micro-batches' sales their units and share.

    A sale that was taken back since has none to give. A void that finds neither
    sale nor void keeps the units it came with. Of the history, only rows that a
    void names go into the join. The voids are staged: their readers search the
    history once.
    """
    key, void = ["product_id", "ref"], F.col("kind") == "void"
    place = F.struct(_PLACED, *order)
    voids = events.where(void)
    named = history.where("kind = 'sale' OR (kind = 'void' AND applied)").join(voids.select(*key).distinct(), key, "left_semi")
    sale, taken = F.col("kind") == "sale", F.when(F.col("kind") == "void", place)
    told = named.groupBy(*key).agg(
        F.max_by(F.when(sale, F.struct(F.coalesce("n", F.lit(0)).alias("n"), "member_sold")), F.when(sale, place)).alias("_sale"),
        F.coalesce(F.max(F.when(sale, place)) > F.max(taken), F.max(taken).isNull()).alias("_stands"),
        F.lit(True).alias("_told"),
    )
    share = lambda mine, stored: F.when(F.col("_told"), F.when(F.col("_stands"), F.col("_sale")[stored])).otherwise(F.col(mine))
    resolved = voids.join(told, key, "left").withColumns({"n": share("n", "n"), "member_n": share("member_n", "member_sold")})
    told_voids = stage(resolved.select(*events.columns), "stored-voids")
    return events.where(~void | void.isNull()).unionByName(told_voids)


def ledger_step(
    spark: SparkSession, products: DataFrame, form: StructType, order: Sequence[str], path: str, hot_rows: int = HOT_ROWS
) -> Callable[[DataFrame, int], None]:
    """What a micro-batch does; ``form`` is the schema of its typed events."""
    state = StateTable(spark, f"{path}/state", _STATE, ["product_id"])
    state.start(openings(products).select("product_id", "_open.*"))
    output = StructType([*form.fields, *HISTORY.fields])
    # The folder exists before the first micro-batch.
    spark.createDataFrame([], output).write.mode("ignore").parquet(f"{path}/history/{_PLACED}=-1")

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        arrived = stage(typed_events(batch), "arrived")
        shelf = state.before(number).join(arrived.select("product_id").distinct(), "product_id", "left_semi")
        shelf = shelf.withColumnsRenamed({"product_id": "id", "current_member": "member_id"})
        if not arrived.where("kind = 'void'").isEmpty():
            arrived = stored_voids(arrived, _earlier(session, f"{path}/history", output, number), order)
        here = f"{path}/history/{_PLACED}={number}"
        raw_history(shelf, arrived, order, hot_rows).select(*output.names).write.mode("overwrite").parquet(here)
        state.save(latest_state(session.read.schema(output).parquet(here), order), number)

    return step


def stream_ledger(
    products: DataFrame, events: DataFrame, order: Sequence[str], hot_rows: int = HOT_ROWS, path: str | None = None
) -> DataFrame:
    """Runs a stream of events to its end and gives history rows with the batch ledger's columns.

    ``products`` is the static catalogue that gives each product's first state.
    With a ``path`` that outlives the session a later run goes on where this one
    ended. The source's rate options bound a micro-batch.
    """
    spark = events.sparkSession
    path = path or staging_path(spark, "ledger")
    form = typed_events(events).schema
    run_to_end(events, ledger_step(spark, products, form, order, path, hot_rows), f"{path}/checkpoint")
    return stored_history(spark, path, form)


def stored_history(spark: SparkSession, path: str, form: StructType) -> DataFrame:
    """The history that the micro-batches wrote; ``form`` is the schema of their typed events."""
    output = StructType([*form.fields, *HISTORY.fields])
    rows = spark.read.schema(output).option("recursiveFileLookup", "true").parquet(f"{path}/history")
    return rows.withColumn("cost_price", shown_cost(F.col("cost_price")))


def latest_state(history: DataFrame, order: Sequence[str]) -> DataFrame:
    """State of each product after the last event in the history."""
    state = F.max_by(F.struct(*STOCK.names), F.struct(*order)).alias("_last")
    known = history.where(F.col("quantity").isNotNull())
    return known.groupBy("product_id").agg(state).select("product_id", "_last.*")
