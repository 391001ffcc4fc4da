"""Running a stream to the end of its input."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfledger.session import staging_path


def run_to_end(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand all available input to ``step``, micro-batch by micro-batch."""
    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def drain(stream: DataFrame, name: str, **options: str) -> DataFrame:
    """Process all available input and read back the appended rows."""
    spark = stream.sparkSession
    path = staging_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .options(path=path, checkpointLocation=f"{path}-checkpoint", **options)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_latest(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Process all available input of an aggregate and read back its last rows.

    Each micro-batch writes the rows it changed to a folder of its own, over
    what a failed attempt may have left there. Input without a file gives no rows.
    """
    spark = stream.sparkSession
    path = staging_path(spark, name)
    # The folder exists even if no micro-batch writes to it.
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/batch=-1")

    def save(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.schema(f"{stream.schema.toDDL()}, batch BIGINT").option("basePath", path).parquet(path)
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.where("_last IS NOT NULL").select(*keys, "_last.*").select(*stream.columns)
