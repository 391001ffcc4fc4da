"""Request validation: rows that may be applied, and rejects with a reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfledger.functions.coerce import (
    as_text,
    empty_to_null,
    float_or,
    given,
    int_or,
    is_truthy,
    leading_int,
    plain_number,
    starts_within,
    text_or,
)

REASON = "reject_reason"

# Reply texts.
NAME_REQUIRED = "Name required"
MISSING_REQUIRED = "Missing required fields"
MISSING_FIELDS = "Missing fields"
AMOUNT_REQUIRED = "Amount required"
URL_REQUIRED = "URL required"
SALE_NOT_FOUND = "Sale not found"
NOT_FOUND = "Not found"
OUT_OF_RANGE = "Number out of range"
NO_PRODUCT_ON_PAGE = "Could not extract product info from this page."

# Products of a price and a number of units, and exact sums of them, hold up to these sizes.
MOST_UNITS, MOST_MONEY = 10**12, 10.0**15


def with_reason(rows: DataFrame, valid: Column, reason: str, fits: Column | None = None) -> DataFrame:
    """Adds the reason of the rows that are not ``valid``, or whose numbers do not fit.

    A generated column, so that a filter on it stays above: below, it would work out
    every column that it hangs on once more.
    """
    late = F.lit(None).cast("string") if fits is None else F.when(~fits, F.lit(OUT_OF_RANGE))
    found = F.when(valid, late).otherwise(F.lit(reason))
    return rows.select(*[c for c in rows.columns if c != REASON], F.explode(F.array(found)).alias(REASON))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col(REASON).isNull()).drop(REASON)


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.col(REASON).isNotNull())


def in_range(rows: DataFrame, units: tuple[str, ...] = (), money: tuple[str, ...] = ()) -> Column:
    """Whether the numbers that the columns present start with are of a size that rows can hold."""
    fits = [starts_within(F.col(c), MOST_UNITS) for c in units if c in rows.columns]
    fits += [starts_within(F.col(c), MOST_MONEY) for c in money if c in rows.columns]
    return reduce(lambda a, b: a & b, fits, F.lit(True))


def check_named(rows: DataFrame) -> DataFrame:
    """Products and members need a name."""
    fits = in_range(rows, ("quantity", "member_qty"), ("price", "cost_price"))
    return with_reason(rows, given(rows, "name"), NAME_REQUIRED, fits)


def check_sales(rows: DataFrame) -> DataFrame:
    """A sale needs a name, a quantity and a price; the price may be 0 or empty."""
    complete = (
        given(rows, "product_name") & given(rows, "quantity_sold") & F.col("sale_price").isNotNull()
    )
    fits = in_range(rows, ("quantity_sold",), ("sale_price", "cost_price"))
    return with_reason(rows, complete, MISSING_REQUIRED, fits)


def check_restocks(rows: DataFrame) -> DataFrame:
    complete = given(rows, "product_id") & given(rows, "quantity_added")
    fits = in_range(rows, ("quantity_added", "member_qty"), ("cost_per_unit",))
    return with_reason(rows, complete, MISSING_FIELDS, fits)


def check_expenses(rows: DataFrame) -> DataFrame:
    return with_reason(rows, given(rows, "amount"), AMOUNT_REQUIRED, in_range(rows, money=("amount",)))


def check_edits(rows: DataFrame, sales: DataFrame) -> DataFrame:
    """An edit needs an existing sale and a price that rows can hold."""
    return check_existing(rows, sales, "id", NOT_FOUND, in_range(rows, money=("sale_price",)))


def check_voids(voids: DataFrame, recorded: DataFrame, stored: DataFrame) -> DataFrame:
    """A void takes back a stored sale or one recorded before it, once.

    Adds the reason and the sale's ``product_id``, and for a stored sale its ``n``
    and ``member_n``. ``voids`` has id, seq and sale_id; ``recorded`` are the sales
    of the same batch with their ``seq``.
    """
    nothing = F.lit(None).cast("bigint")
    now = recorded.select(
        F.col("id").alias("sale_id"), "product_id", nothing.alias("n"), nothing.alias("member_n"),
        F.col("seq").alias("_since"), F.lit(False).alias("_stored"),
    )
    before = stored.select(
        F.col("id").alias("sale_id"), "product_id", F.col("quantity_sold").alias("n"),
        F.coalesce("member_qty_sold", F.lit(0)).alias("member_n"),
        F.lit(None).cast(recorded.schema["seq"].dataType).alias("_since"), F.lit(True).alias("_stored"),
    )
    wanted = voids.select("sale_id")
    found = now.join(wanted, "sale_id", "left_semi").unionByName(before.join(wanted, "sale_id", "left_semi"))
    met = voids.join(found, "sale_id", "left")
    usable = F.coalesce(F.col("_stored") | (F.col("_since") < F.col("seq")), F.lit(False))
    # Of the voids that find their sale the first counts; all others stand alone, however many name the same.
    marked = met.withColumn("_usable", usable)
    alone = F.when(~F.col("_usable"), F.col("id"))
    turn = Window.partitionBy("sale_id", "_usable", alone).orderBy(F.col("seq").asc_nulls_last())
    valid = F.col("_usable") & F.col("seq").isNotNull() & (F.rank().over(turn) == 1)
    placed = marked.withColumn("_valid", valid)
    return with_reason(placed, F.col("_valid"), SALE_NOT_FOUND).drop("_since", "_stored", "_usable", "_valid")


def check_imports(rows: DataFrame) -> DataFrame:
    """An import needs a URL."""
    return with_reason(rows, given(rows, "url"), URL_REQUIRED)


def check_extracted(rows: DataFrame) -> DataFrame:
    return with_reason(rows, is_truthy(F.col("name")), NO_PRODUCT_ON_PAGE)


def check_existing(
    changes: DataFrame, existing: DataFrame, key: str, reason: str, fits: Column | None = None
) -> DataFrame:
    """Changes whose key is not among the existing rows are rejected, and those whose numbers do not fit.

    The table is first cut down to the changed keys, so that it is not shuffled
    for a change set small enough to broadcast.
    """
    touched = existing.select(key).join(changes.select(key), key, "left_semi")
    known = touched.distinct().withColumn("_known", F.lit(True))
    marked = changes.join(known, key, "left")
    return with_reason(marked, F.col("_known").isNotNull(), reason, fits).drop("_known")


def _moment(text: Column, now: Column | None) -> Column:
    """A given time, NULL if unreadable; a missing one is ``now``."""
    stamp = now if now is not None else F.current_timestamp()
    return F.when(is_truthy(text), empty_to_null(text).try_cast("timestamp")).otherwise(stamp.cast("timestamp"))


def normal_sales(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Typed sale events from raw request text."""
    typed = rows.select(
        *_kept(rows, "id", "seq"),
        F.when(given(rows, "product_id"), plain_number(F.col("product_id"), "bigint")).alias("product_id"),
        "product_name",
        int_or(F.col("quantity_sold"), 1).alias("quantity_sold"),
        float_or(F.col("sale_price"), 0.0).alias("sale_price"),
        float_or(F.col("cost_price"), 0.0).alias("cost_price"),
        empty_to_null(F.col("notes")).alias("notes"),
        empty_to_null(F.col("payment_method")).alias("payment_method"),
        _moment(F.col("sold_at"), now).alias("sold_at"),
    )
    margin = F.col("sale_price") - F.col("cost_price")
    return typed.withColumn("profit", margin * F.col("quantity_sold"))


def normal_restocks(rows: DataFrame, now: Column | None = None) -> DataFrame:
    quantity = int_or(F.col("quantity_added"), 0)
    return rows.select(
        *_kept(rows, "id", "seq"),
        plain_number(F.col("product_id"), "bigint").alias("product_id"),
        text_or(F.col("product_name"), "").alias("product_name"),
        quantity.alias("quantity_added"),
        float_or(F.col("cost_per_unit"), None).alias("cost_per_unit"),
        empty_to_null(F.col("notes")).alias("notes"),
        F.when(given(rows, "member_id"), leading_int(F.col("member_id"))).alias("member_id"),
        F.least(int_or(F.col("member_qty"), 0), quantity).alias("member_qty"),
        _moment(F.col("restocked_at"), now).alias("restocked_at"),
    )


def normal_expenses(rows: DataFrame, today: Column | None = None) -> DataFrame:
    """Typed expenses; the category, the payment method and the day have defaults."""
    day = empty_to_null(F.col("expense_date")).try_cast("date")
    return rows.select(
        *_kept(rows, "id", "seq"),
        text_or(F.col("category"), "Other").alias("category"),
        float_or(F.col("amount"), 0.0).alias("amount"),
        text_or(F.col("payment_method"), "Cash").alias("payment_method"),
        empty_to_null(F.col("notes")).alias("notes"),
        F.when(is_truthy(F.col("expense_date")), day).otherwise(_today(today)).alias("expense_date"),
    )


def normal_products(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Typed product rows from raw request text; ``images`` is an array of strings."""
    stamp = now if now is not None else F.current_timestamp()
    return rows.select(
        *_kept(rows, "id", "seq"),
        "name",
        text_or(F.col("category"), "Other").alias("category"),
        empty_to_null(F.col("subcategory")).alias("subcategory"),
        empty_to_null(F.col("description")).alias("description"),
        plain_number(F.col("price"), "double").alias("price"),
        text_or(F.col("price_unit"), "each").alias("price_unit"),
        empty_to_null(F.col("sku")).alias("sku"),
        text_or(F.col("source"), "Other").alias("source"),
        text_or(F.col("stock"), "in_stock").alias("stock"),
        F.coalesce(F.col("images"), F.array().cast("array<string>")).alias("images"),
        given(rows, "featured").cast("int").alias("featured"),
        F.coalesce(plain_number(F.col("sort_order"), "int"), F.lit(0)).alias("sort_order"),
        int_or(F.col("quantity"), 0).alias("quantity"),
        empty_to_null(F.col("source_url")).alias("source_url"),
        plain_number(F.col("cost_price"), "double").alias("cost_price"),
        plain_number(F.col("coverage_sqft"), "double").alias("coverage_sqft"),
        plain_number(F.col("member_id"), "bigint").alias("member_id"),
        int_or(F.col("member_qty"), 0).alias("member_qty"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
    )


def normal_members(rows: DataFrame, now: Column | None = None) -> DataFrame:
    stamp = now if now is not None else F.current_timestamp()
    return rows.select(
        *_kept(rows, "id", "seq"),
        "name",
        empty_to_null(F.col("phone")).alias("phone"),
        empty_to_null(F.col("notes")).alias("notes"),
        stamp.alias("created_at"),
    )


def normal_settings(rows: DataFrame) -> DataFrame:
    """Any value becomes text; a missing one becomes the word ``null``."""
    value = F.coalesce(as_text(F.col("value")), F.lit("null"))
    return rows.select(*_kept(rows, "seq"), "key", value.alias("value"))


def _kept(rows: DataFrame, *names: str) -> list[str]:
    return [name for name in names if name in rows.columns]


def _today(today: Column | None) -> Column:
    return today if today is not None else F.current_date()
