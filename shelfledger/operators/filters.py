"""Optional predicates: a parameter that is absent or empty adds nothing."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.functions.text import contains_pattern


def all_of(predicates: Iterable[Column | None]) -> Column:
    """Conjunction of the predicates that are present; true when none is."""
    return reduce(lambda a, b: a & b, (p for p in predicates if p is not None), F.lit(True))


def category_is(category: str | None) -> Column | None:
    # Fixed value: 'All' stands for no filter.
    return F.col("category") == category if category and category != "All" else None


def search_matches(term: str | None, *columns: str) -> Column | None:
    if not term:
        return None
    return reduce(lambda a, b: a | b, (contains_pattern(F.col(c), term) for c in columns))


def stock_is(band: str | None) -> Column | None:
    return F.col("stock") == band if band else None


def featured_is(flag: str | None) -> Column | None:
    """Active for the text ``1`` only."""
    return F.col("featured") == 1 if flag == "1" else None


def on_or_after(column: str, day: str | date | None) -> Column | None:
    return F.to_date(column) >= as_day(day) if day else None


def on_or_before(column: str, day: str | date | None) -> Column | None:
    return F.to_date(column) <= as_day(day) if day else None


def in_days(column: str, start: str | date | None, end: str | date | None) -> Column:
    """Inclusive range of days; a missing or unreadable time is outside any given bound."""
    return all_of([on_or_after(column, start), on_or_before(column, end)])


def as_day(day: str | date) -> Column:
    return F.lit(day).try_cast("date") if isinstance(day, str) else F.lit(day)


def in_stock(quantity: str = "quantity") -> Column:
    return F.col(quantity) > 0


def of_product(product_id: int | None) -> Column:
    """No filter only without an id; 0 is an id."""
    return F.col("product_id") == product_id if product_id is not None else F.lit(True)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The 0 or 1 rows with this key."""
    return df.where(F.col(key) == F.lit(value))


def lookup_many(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key occurs in the one-column frame ``keys``."""
    wanted = keys.select(F.col(keys.columns[0]).alias(key))
    return df.join(wanted, key, "left_semi")
