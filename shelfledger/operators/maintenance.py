"""Table maintenance: a table and its changes give the next snapshot.

A parquet table has no row update, so each function returns the whole next
table, to be written to a new path. Changes are reduced to the last one per key
by an aggregate, which combines before the shuffle: a key rewritten many times
costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.functions.coerce import float_or, text_or


def latest(changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Last change per key by ``order``; the order columns stay."""
    rest = [c for c in changes.columns if c != key]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    last = changes.groupBy(key).agg(row)
    return last.select(key, *[F.col("_last")[c].alias(c) for c in rest]).select(*changes.columns)


def upsert(
    table: DataFrame, changes: DataFrame, key: str = "id", order: Sequence[str] = ("seq",)
) -> DataFrame:
    """Insert or replace by key; the last write wins."""
    last = latest(changes, key, order).select(*table.columns)
    kept = table.join(last.select(key), key, "left_anti").select(*table.columns)
    return kept.unionByName(last)


def overwrite(
    table: DataFrame,
    changes: DataFrame,
    columns: Sequence[str],
    key: str = "id",
    order: Sequence[str] = ("seq",),
) -> DataFrame:
    """Replace ``columns`` of the rows whose key has a change; other keys are ignored.

    A changed value may be NULL, so a flag and not the value says what was hit.
    """
    joined = table.join(last_values(changes, columns, key, order), key, "left")
    return overwritten(joined, table.columns, columns)


def last_values(changes: DataFrame, columns: Sequence[str], key: str = "id", order: Sequence[str] = ("seq",)) -> DataFrame:
    """What :func:`overwrite` puts beside the rows of a table, one row per key."""
    return latest(changes, key, order).select(
        F.col(key), F.struct(*columns).alias("_new"), F.lit(True).alias("_hit")
    )


def overwritten(joined: DataFrame, names: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The columns ``names`` of rows beside their :func:`last_values`, with these in place."""
    hit = F.col("_hit").isNotNull()
    return joined.select(
        *[
            F.when(hit, F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in names
        ]
    )


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows.select(*table.columns))


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Add rows to a table; columns that they do not have stay NULL, further ones are left out."""
    kept = [c for c in table.columns if c in rows.columns]
    return table.unionByName(rows.select(*kept), allowMissingColumns=True)


def delete(table: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    """Drop the rows whose key occurs in ``removed``; ledgers keep their dangling ids."""
    return table.join(removed.select(key), key, "left_anti").select(*table.columns)


def unlink_members(products: DataFrame, removed: DataFrame) -> DataFrame:
    """Clear the member of products whose member is removed; ``member_qty`` stays."""
    gone = removed.select(F.col("id").alias("member_id")).distinct().withColumn(
        "_gone", F.lit(True)
    )
    joined = products.join(gone, "member_id", "left")
    cleared = F.when(F.col("_gone").isNull(), F.col("member_id")).alias("member_id")
    return joined.select(*[cleared if c == "member_id" else F.col(c) for c in products.columns])


def delete_members(
    members: DataFrame, products: DataFrame, removed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    return delete(members, removed), unlink_members(products, removed)


def edit_sales(sales: DataFrame, edits: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Apply the edits of each sale in turn; stock is not touched.

    An edit sets the price unless it is unreadable or 0, the payment method
    unless it is empty, and the notes unless they are missing. The stored profit
    of an edited sale is price - cost x quantity, with the price not multiplied;
    ``profit_line`` holds (price - cost) x quantity beside it.
    """
    return edited_sales(sales.join(last_edits(edits, order), "id", "left"), sales.columns)


def last_edits(edits: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """What the edits of each sale come to, one row per sale."""
    sequence = F.struct(*order)
    price = F.nullif(float_or(F.col("sale_price"), None), F.lit(0.0))
    payment = text_or(F.col("payment_method"), None)
    notes = F.col("notes")

    def last_given(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), sequence))

    # Each field keeps its own last usable value, as a run of edits would leave it.
    return edits.groupBy("id").agg(
        last_given(price).alias("_price"),
        last_given(payment).alias("_payment"),
        last_given(notes).alias("_notes"),
        F.lit(True).alias("_hit"),
    )


def edited_sales(joined: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns ``names`` of sales beside their :func:`last_edits`, edited, and ``profit_line``."""
    new_price = F.coalesce("_price", F.col("sale_price").cast("double"))
    unit_cost = F.coalesce(F.col("cost_price").cast("double"), F.lit(0.0))
    line = (new_price - unit_cost) * F.col("quantity_sold")
    edited = {
        "sale_price": new_price,
        "profit": F.when(F.col("_hit").isNotNull(), new_price - unit_cost * F.col("quantity_sold"))
        .otherwise(F.col("profit").cast("double")),
        "payment_method": F.coalesce(F.col("_payment"), F.col("payment_method")),
        "notes": F.coalesce(F.col("_notes"), F.col("notes")),
    }
    return joined.select(
        *[edited[c].alias(c) if c in edited else F.col(c) for c in names],
        line.alias("profit_line"),
    )
