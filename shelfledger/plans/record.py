"""From request rows to ledger rows and the next catalogue snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.operators import validation as check
from shelfledger.operators.ledger import (
    changed_products,
    ledger_history,
    merge_events,
    restock_events,
    sale_events,
)
from shelfledger.session import stage


def accepted_sales(sale_requests: DataFrame, now: Column | None = None) -> DataFrame:
    return check.normal_sales(check.accepted(check.check_sales(sale_requests)), now)


def request_events(
    sale_requests: DataFrame,
    restock_requests: DataFrame,
    voids: DataFrame | None = None,
    now: Column | None = None,
) -> DataFrame:
    """Accepted requests as ledger events; ``seq`` gives their order of arrival.

    ``voids`` are void requests as :func:`checked_voids` gives them. Staged, since
    the ledger reads its events several times and raw text is read once.
    """
    sales = accepted_sales(sale_requests, now)
    restocks = check.normal_restocks(check.accepted(check.check_restocks(restock_requests)), now)
    events = merge_events(sale_events(sales), restock_events(restocks))
    if voids is None:
        return stage(events, "events")
    taken = check.accepted(voids).select(
        "product_id", "seq", F.lit("void").alias("kind"), F.col("sale_id").alias("ref"), "n", "member_n"
    )
    return stage(merge_events(events, taken), "events")


def checked_voids(
    void_requests: DataFrame, sale_requests: DataFrame, stored: DataFrame, now: Column | None = None
) -> DataFrame:
    """Void requests with the sale they take back, or the reason why not.

    Staged, since the events, the sale rows and the rejects all read it.
    """
    return stage(check.check_voids(void_requests, accepted_sales(sale_requests, now), stored), "voids")


def without_voided(sales: DataFrame, voids: DataFrame) -> DataFrame:
    """Sale rows, stored or new, less those that accepted voids take back."""
    gone = check.accepted(voids).select(F.col("sale_id").alias("id"))
    return sales.join(gone, "id", "left_anti").select(*sales.columns)


_SHOWN = {"ref": "id", "n": "quantity_sold", "sale_cost": "cost_price"}
_SALE_ROW = [
    "id", "product_id", "product_name", "quantity_sold", "sale_price", "cost_price", "profit", "payment_method", "notes", "sold_at",
    "member_id", "member_qty_sold", "sold_out",
]


def recorded_sales(
    products: DataFrame, events: DataFrame, order: Sequence[str] = ("seq",), columns: Sequence[str] | None = None
) -> DataFrame:
    """Sale rows to append, with the member split and whether the sale emptied the stock.

    Price, notes and the other columns travel through the ledger with their
    event, so nothing is joined back; ``columns`` names those that are wanted,
    by default all.
    """
    passed = ["ref", "product_name", "n", "sale_price", "sale_cost", "profit", "payment_method", "notes", "sold_at"]
    history = ledger_history(products, events, list(order), keep=[c for c in passed if columns is None or _SHOWN.get(c, c) in columns])
    sold = history.where("kind = 'sale'").select(
        *[F.col(c).alias(_SHOWN.get(c, c)) for c in history.columns if c in passed],
        "product_id",
        F.col("current_member").alias("member_id"),
        F.col("member_sold").alias("member_qty_sold"),
        "sold_out",
    )
    return sold.select(*(columns or _SALE_ROW))


def next_products(
    products: DataFrame, events: DataFrame, order: Sequence[str] = ("seq",), now: Column | None = None
) -> DataFrame:
    """The catalogue after the events: stock, member and cost of each product.

    Only products that an event moved change; those get a new ``updated_at``.
    """
    stamp = (now if now is not None else F.current_timestamp()).alias("updated_at")
    state = changed_products(products, events, list(order)).withColumnRenamed("product_id", "id")
    moved = [c for c in (*[c for c in state.columns if c != "id"], "updated_at") if c in products.columns]
    new = state.select("*", stamp).select("id", F.struct(*moved).alias("_new"))
    hit = F.col("_new").isNotNull()
    joined = products.join(new, "id", "left")
    return joined.select(
        *[F.when(hit, F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in moved else F.col(c) for c in products.columns]
    )
