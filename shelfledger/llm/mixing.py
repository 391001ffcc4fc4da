"""Mixing sources to target weights by capped water-filling.

Sources share the words of the corpus by weight. A source whose share would pass
``max_epochs`` times its own words is clamped there, and the excess goes to the
others by weight, until none is above. A source is then repeated whole as often
as its target holds it; the fractional repetition takes its documents in the
order of a seeded digest up to the target, rounding at the last document.

Order within a source is that of md5(seed, id, md5 of the text), so rows equal in
id and text are taken or left together. Null texts have no words; a null source
is a source of its own, ranked last. Sizes and cuts come from sums per (source,
digest prefix); only the rows of one prefix per source are ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfledger.session import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Weight by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Leading hex digits of a digest that make a bucket.
PREFIX = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(seed: str = SEED) -> Column:
    """The place of a row in its source's order."""
    return F.md5(
        F.concat_ws(
            ":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))
        )
    )


def measure(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size and place of every row."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), digest(seed).alias("place"))


def fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight), one row per source.

    ``sources`` must be a stored table: each round of clamping reads it once and
    hands two sums to the driver. The level only rises, so a clamped source stays
    clamped and the rounds end.
    """
    cap = F.col("source_size") * max_epochs
    level, clamped = 0.0, -1
    while True:
        over = cap < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(over, cap).otherwise(0)).alias("fixed"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(over.cast("int")).alias("clamped"),
        ).first()
        if not row.total or row.clamped == clamped:
            break
        level, clamped = (row.total - row.fixed) / row.weight, row.clamped
    share = F.lit(level) * F.col("weight")
    return sources.withColumn("target", F.when(cap < share, cap.cast("double")).otherwise(share))


def plan(measured: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, target, whole, cut.

    A row of the source is taken ``whole`` times, and once more if its place is not
    above ``cut``. ``measured`` must be a stored table.
    """
    totals = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    sources = fill(stage(totals.withColumn("weight", weight), "mix-sources"), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs)))
    sources = sources.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("int"))
    sources = stage(
        sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).drop("weight"), "mix-targets"
    )

    bucket = F.substring("place", 1, PREFIX)
    in_order = Window.partitionBy("source").orderBy("bucket")
    sums = measured.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    edge = (
        sums.withColumn("before", F.sum("bucket_size").over(in_order) - F.col("bucket_size"))
        .join(sources.select(F.col("source").alias("of"), "rest"), F.col("source").eqNullSafe(F.col("of")))
        .where("before <= rest and rest < before + bucket_size")
        .select(F.col("of"), F.col("bucket").alias("edge"), "before", "rest")
    )
    along = Window.partitionBy("of", "edge").orderBy("place")
    cuts = (
        measured.join(edge, F.col("source").eqNullSafe(F.col("of")) & (bucket == F.col("edge")))
        .withColumn("upto", F.col("before") + F.sum("size").over(along))
        .groupBy("of", "edge")
        .agg(F.max(F.when(F.col("upto") - F.col("size") / 2 <= F.col("rest"), F.col("place"))).alias("last"))
        .select("of", F.coalesce("last", "edge").alias("cut"))
    )
    return sources.drop("rest").join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def _repetitions(place: Column) -> Column:
    return F.col("whole") + F.coalesce((place <= F.col("cut")).cast("int"), F.lit(0))


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    measured = stage(measure(docs, seed), "mix-sizes")
    sources = stage(plan(measured, weights, max_epochs), "mix-plan").withColumnRenamed("source", "of")
    return measured.join(sources, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "size", "source_size", "target", (_repetitions(F.col("place")) * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every row as often as it is taken, with the columns of ``docs``."""
    measured = stage(measure(docs, seed), "mix-sizes")
    sources = stage(plan(measured, weights, max_epochs).select("source", "whole", "cut"), "mix-plan")
    sources = sources.withColumnRenamed("source", "of")
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("from"), digest(seed).alias("place"))
    return (
        rows.join(sources, F.col("from").eqNullSafe(F.col("of")))
        .select("row", F.explode(F.array_repeat(F.lit(1), _repetitions(F.col("place")))))
        .select("row.*")
    )
