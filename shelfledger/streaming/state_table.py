"""State between micro-batches as a table of files, one row per key.

Micro-batch ``n`` writes the rows that it changed; every ``WHOLE_EVERY`` batches,
and before the first, all rows are written. Reading goes back to the last whole
batch and takes the newest row of a key. A batch that is run again after a
failure reads only what lies before it and writes over its own rows, so it comes
to the same state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WHOLE_EVERY = 20
FIRST = -1


class StateTable:
    """Rows of ``schema`` under ``path``; ``keys`` name a row, a NULL key is one like any other."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, list(keys)

    def _write(self, rows: DataFrame, batch: int, whole: bool, mode: str = "overwrite") -> None:
        rows.select(*self.schema.names).write.mode(mode).parquet(f"{self.path}/whole={int(whole)}/batch={batch}")

    def start(self, rows: DataFrame) -> None:
        """The rows before the first micro-batch; a table that was started before stays as it is."""
        self._write(rows, FIRST, True, "ignore")

    def before(self, batch: int) -> DataFrame:
        """The newest row of every key, as the batches before ``batch`` left it."""
        placed = StructType([*self.schema.fields]).add("whole", "integer").add("batch", "long")
        rows = self.spark.read.schema(placed).parquet(self.path).where(F.col("batch") < batch)
        last = rows.where("whole = 1").agg(F.max("batch")).first()[0]
        base = FIRST if last is None else last
        rows = rows.where((F.col("batch") > base) | ((F.col("batch") == base) & (F.col("whole") == 1)))
        values = [c for c in self.schema.names if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "batch").alias("_row"))
        return newest.select(*self.keys, "_row.*").select(*self.schema.names)

    def save(self, changed: DataFrame, batch: int, keep: str = "true") -> None:
        """The rows that ``batch`` changed; a whole batch drops those that ``keep`` does not hold for."""
        self._write(changed, batch, False)
        if batch % WHOLE_EVERY == WHOLE_EVERY - 1:
            self._write(self.before(batch + 1).where(keep), batch, True)
