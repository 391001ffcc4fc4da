"""Exact duplicates: group by a 128-bit content hash and compare the bytes in each group.

Texts are equal when they are identical; a null text counts as empty. Of equal
texts the row with the largest ``doc_id`` stays (a null id is smaller than any
other). The text itself is part of the grouping key, so a hash collision cannot
join two texts, and every task reduces its copies to one row before the shuffle:
a text held by a third of all rows costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("hash"), F.sha2(text, 256).alias("text_sha256")
    )


def copy_groups(docs: DataFrame) -> DataFrame:
    """One row per text held by several rows: hash, text_sha256, keep_id, group_size.

    No row for a text that occurs once or for an empty table; keep_id is null only
    where every row of the group has a null id.
    """
    return (
        _hashed(docs)
        .groupBy("hash", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("hash", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )


def mark_copies(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows that repeat both the id and the text of the one that stays are marked
    alike; :func:`drop_copies` keeps one of them. Null and empty texts form one
    group. Other columns of ``docs`` are not read.
    """
    found = copy_groups(docs)
    return (
        _hashed(docs)
        .select("doc_id", "hash", "text_sha256")
        .join(found, ["hash", "text_sha256"], "left")
        .select(
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            "text_sha256",
        )
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all columns of ``docs`` and one row per text.

    Rows equal in text and id are told apart by their other columns, read as JSON:
    the largest stays.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    text = F.coalesce("text", F.lit(""))
    rank = F.struct(
        F.col("doc_id").isNotNull(),
        F.col("doc_id"),
        F.col("text").isNotNull(),
        F.to_json(F.struct(*others)) if others else F.lit(""),
    )
    rest = F.struct("doc_id", F.col("text").isNull().alias("no_text"), F.struct(*others).alias("others")) if others else (
        F.struct("doc_id", F.col("text").isNull().alias("no_text"))
    )
    best = (
        docs.select(F.unhex(F.md5(text)).alias("hash"), text.alias("text"), rank.alias("rank"), rest.alias("rest"))
        .groupBy("hash", "text")
        .agg(F.max_by("rest", "rank").alias("rest"))
    )
    columns = {
        "doc_id": F.col("rest.doc_id"),
        "text": F.when(~F.col("rest.no_text"), F.col("text")),
    }
    return best.select(*[columns.get(c, F.col(f"rest.others.`{c}`")).alias(c) for c in docs.columns])
