"""Declared schemas of the retail tables."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_TYPES = {
    "bigint": LongType(),
    "int": IntegerType(),
    "double": DoubleType(),
    "string": StringType(),
    "boolean": BooleanType(),
    "date": DateType(),
    "timestamp": TimestampType(),
    "strings": ArrayType(StringType()),
}


def schema(**columns: str) -> StructType:
    """Schema from ``name="type"``; a trailing ``!`` means never NULL."""
    return StructType(
        [
            StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!"))
            for name, kind in columns.items()
        ]
    )


PRODUCTS = schema(
    id="bigint!", name="string!", category="string", subcategory="string",
    description="string", price="double", price_unit="string", sku="string",
    source="string", stock="string", images="strings", featured="int", sort_order="int",
    quantity="bigint", source_url="string", cost_price="double", coverage_sqft="double",
    member_id="bigint", member_qty="bigint", created_at="timestamp", updated_at="timestamp",
)
SETTINGS = schema(key="string!", value="string")
MEMBERS = schema(
    id="bigint!", name="string!", phone="string", notes="string", created_at="timestamp"
)
SALES = schema(
    id="string!", product_id="bigint", product_name="string!", quantity_sold="bigint!",
    sale_price="double!", cost_price="double!", profit="double", payment_method="string",
    notes="string", sold_at="timestamp", member_id="bigint", member_qty_sold="bigint",
)
RESTOCKS = schema(
    id="string!", product_id="bigint!", product_name="string!", quantity_added="bigint!",
    cost_per_unit="double", notes="string", restocked_at="timestamp", member_id="bigint",
    member_qty="bigint",
)
EXPENSES = schema(
    id="bigint!", category="string!", amount="double!", payment_method="string",
    notes="string", expense_date="date",
)
PAGES = schema(page_id="bigint", url="string", html="string")

# A product's stock, what an event did, and how a block of events hangs on its first state.
STOCK = schema(
    quantity="bigint", member_qty="bigint", current_member="bigint", cost_price="double",
    stock="string",
)
HISTORY = StructType(
    [
        *schema(member_sold="bigint", owner_sold="bigint"),
        *STOCK,
        *schema(sold_out="boolean", applied="boolean"),
    ]
)
FINAL = StructType(
    [
        *STOCK,
        *schema(
            known="boolean", added="bigint", cap="bigint", exact="boolean", touched="boolean",
            scale="double", offset="double",
        ),
    ]
)
# What a fold gives: the last state of a group, or the member units of a linked sale.
FOLDED = StructType([*FINAL, *schema(_link="string", member_sold="bigint")])

TABLES = {
    "products": PRODUCTS,
    "settings": SETTINGS,
    "members": MEMBERS,
    "sales": SALES,
    "restocks": RESTOCKS,
    "expenses": EXPENSES,
    "pages": PAGES,
}
