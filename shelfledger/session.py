"""Session settings and the shared staging folder."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "shelfledger", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the reports assume; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # The JVM does not compile larger methods; wide parsing stages run several
        # times faster as separately compiled expressions than interpreted.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package() -> None:
    """Send this package's task functions to the Python workers by value.

    Workers, and the helper process of a stateful stream on the driver, then need
    no copy of the package. Not needed where it is installed on all machines.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__package__])


def staging_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none gets one of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_root(spark.sparkContext.applicationId)


@cache
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"shelfledger-{application}-")


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the staging folder and read it back.

    Cuts the lineage on storage that outlives executors, keeps the result
    columnar, and fixes values that would differ between two runs of a plan.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Actions within read long texts and send them to Python a few MB, or one text, at a time.

    With Spark's own sizes a task holds 4096 rows of a file on the heap, in a buffer
    that doubles, and outside it an Arrow batch of 64 MB in buffers that grow to 192 MB.
    Texts of 100 KB in one large row group then end a JVM of 2 tasks and 1.8 GB.
    """
    held = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.parquet.columnarReaderBatchSize": "16"}
    before = {name: spark.conf.get(name) for name in held}
    for name, value in held.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
