"""Catalogue search, categories and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfledger.functions.coerce import empty_to_null
from shelfledger.operators.filters import (
    all_of,
    category_is,
    featured_is,
    search_matches,
    stock_is,
)

# Settings written when missing, and the key no listing may show.
DEFAULT_SETTINGS = {
    "business_name": "Your Business Name",
    "business_phone": "(555) 123-4567",
    "business_email": "contact@yourbusiness.com",
    "business_address": "123 Main St, Your City, State",
    "business_hours": "Mon–Fri 8am–6pm, Sat 9am–4pm",
    "hero_tagline": "Quality flooring, vanities & tools for your home projects.",
    "service_area": "Serving the local area",
}
SECRET_SETTING = "employee_password"
ALL_CATEGORIES = "All"


def with_member_name(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Adds ``member_name``, NULL for a missing or dangling member.

    No broadcast hint: Spark broadcasts the register while its size is below
    ``autoBroadcastJoinThreshold`` and otherwise sorts, splitting skewed ids.
    """
    names = members.select(F.col("id").alias("member_id"), F.col("name").alias("member_name"))
    return rows.join(names, "member_id", "left")


def search_products(
    products: DataFrame,
    members: DataFrame,
    category: str | None = None,
    search: str | None = None,
    stock: str | None = None,
    featured: str | None = None,
) -> DataFrame:
    wanted = all_of(
        [
            category_is(category),
            search_matches(search, "name", "description", "subcategory"),
            stock_is(stock),
            featured_is(featured),
        ]
    )
    found = with_member_name(products.where(wanted), members)
    return found.select(*products.columns, "member_name").orderBy(
        F.desc("featured"), F.asc("sort_order"), F.desc("created_at"), F.asc("id")
    )


def categories(products: DataFrame) -> DataFrame:
    """``All`` and then each category in byte order, with its position."""
    names = products.select("category").distinct().withColumn("section", F.lit(1))
    head = products.sparkSession.range(1).select(
        F.lit(ALL_CATEGORIES).alias("category"), F.lit(0).alias("section")
    )
    return head.unionByName(names).orderBy("section", "category")


def settings_object(settings: DataFrame) -> DataFrame:
    """Settings that may be listed, one key and value per row."""
    return settings.where(F.col("key") != SECRET_SETTING).select("key", "value")


def settings_entries(settings: DataFrame) -> DataFrame:
    """The listed settings as entries of one object, one JSON object of one field each.

    The object is the union of its entries; no task has to hold it whole.
    """
    entry = F.to_json(F.create_map("key", "value"))
    return settings_object(settings).select("key", entry.alias("json"))


def setting_or_default(settings: DataFrame, key: str, default: str) -> DataFrame:
    """One row: the stored value, or the default when it is missing or empty."""
    stored = settings.where(F.col("key") == key).agg(F.max("value").alias("value"))
    value = F.coalesce(empty_to_null(F.col("value")), F.lit(default))
    return stored.select(F.lit(key).alias("key"), value.alias("value"))


def with_default_settings(settings: DataFrame, defaults: DataFrame) -> DataFrame:
    """Adds the defaults whose key is not stored yet."""
    missing = defaults.join(settings.select("key"), "key", "left_anti")
    return settings.select("key", "value").unionByName(missing.select("key", "value"))


def default_settings(spark) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_SETTINGS.items()), "key string, value string")
