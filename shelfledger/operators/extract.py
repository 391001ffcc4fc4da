"""Product extraction from archived HTML pages.

Finding elements needs an HTML reader and runs in one Arrow pass over the pages;
everything after it is column expressions, without a shuffle. ``static`` reads a
page as delivered, ``rendered`` prefers what a browser would show.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from shelfledger.functions.coerce import leading_float
from shelfledger.functions.json_blocks import read_block
from shelfledger.functions.page_elements import page_elements
from shelfledger.functions.text import (
    MAX_IMAGES,
    PRICE_PATTERN,
    category_of_crumbs,
    collapse_space,
    price_of_text,
    store_of_url,
    strip_tags,
    title_head,
    trim_space,
    usable_images,
)
from shelfledger.operators.validation import check_extracted

STATIC, RENDERED = "static", "rendered"

_TEXTS = [
    "h1", "og_title", "og_description", "og_image", "description",
    "static_price", "rendered_price", "rendered_price_content",
]
_LISTS = ["json_ld", "broken_ld", "gallery", "crumbs"]
ELEMENTS = StructType(
    [StructField(name, StringType()) for name in _TEXTS]
    + [StructField(name, ArrayType(StringType())) for name in _LISTS]
)
_ARROW = [pa.string()] * len(_TEXTS) + [pa.list_(pa.string())] * len(_LISTS)


def find_elements(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and the raw texts of the elements in each page."""
    base = pages.select("page_id", "url", "html")
    schema = StructType([base.schema["page_id"], base.schema["url"], *ELEMENTS.fields])
    return base.mapInArrow(_find, schema)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            page = page_elements(html)
            # A browser shows image addresses resolved against the page.
            page["gallery"] = [
                _resolve(url, src) if src else lazy for src, lazy in page["gallery"]
            ]
            blocks = [read_block(text) for text in page["json_ld"]]
            page["json_ld"] = [block for block, _ in blocks]
            page["broken_ld"] = [f"block {i}: {why}" for i, (_, why) in enumerate(blocks, 1) if why]
            found.append(page)
        columns = [
            pa.array([page[name] for page in found], kind)
            for name, kind in zip(ELEMENTS.names, _ARROW)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *columns], names=["page_id", "url", *ELEMENTS.names]
        )


def _resolve(base: str | None, address: str) -> str:
    try:
        return urljoin(base or "", address)
    except ValueError:
        return address


# --- structured data ----------------------------------------------------------------


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _type_of(value: Column) -> Column:
    """Type name of a variant; NULL when the value is absent."""
    return F.schema_of_variant(value)


def _is_array(value: Column) -> Column:
    return F.coalesce(_type_of(value).startswith("ARRAY"), F.lit(False))


def _is_text(value: Column) -> Column:
    return F.coalesce(_type_of(value) == "STRING", F.lit(False))


def _given(value: Column) -> Column:
    """Present and neither null, false, zero nor empty text."""
    kind = _type_of(value)
    number = _get(value, "$", "double")
    return (
        F.when(value.isNull() | F.is_variant_null(value), F.lit(False))
        .when(kind == "STRING", _get(value, "$", "string") != "")
        .when(kind == "BOOLEAN", _get(value, "$", "boolean"))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.coalesce(number != 0, F.lit(True)))
        .otherwise(F.lit(True))
    )


def _member(value: Column, name: str) -> Column:
    return _get(value, f'$["{name}"]', "variant")


def _items(block: Column) -> Column:
    """Items of a block: the array, the graph's array, or the value itself."""
    graph = _member(block, "@graph")
    alone = F.array(block)
    return (
        F.when(_is_array(block), _get(block, "$", "array<variant>"))
        .when(~_given(graph), alone)
        # A graph that is no array holds no item.
        .otherwise(F.coalesce(_get(graph, "$", "array<variant>"), F.array().cast("array<variant>")))
    )


_FOUND = "struct<name:string,description:string,price:double,images:array<string>,failed:boolean>"


def _empty_found() -> Column:
    return F.struct(
        F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("double").alias("price"),
        F.lit(None).cast("array<string>").alias("images"),
        F.lit(False).alias("failed"),
    )


def _price_of(value: Column) -> Column:
    """Number as it is, text by its leading number; anything else is not a number."""
    number = F.when(~_is_text(value), _get(value, "$", "double"))
    return F.coalesce(
        F.when(F.coalesce(_type_of(value) == "BOOLEAN", F.lit(False)), F.lit(None)).otherwise(
            F.coalesce(number, leading_float(F.when(_is_text(value), _get(value, "$", "string"))))
        ),
        F.lit(float("nan")),
    )


def _image_texts(value: Column) -> Column:
    many = F.when(_is_array(value), _get(value, "$", "array<variant>")).otherwise(F.array(value))
    texts = F.filter(many, _is_text)
    return F.slice(F.transform(texts, lambda v: _get(v, "$", "string")), 1, MAX_IMAGES)


def _take_item(found: Column, item: Column) -> Column:
    """Fields of one item over those found before.

    A null item, or a name or description that is not text, ends its block with
    what was set up to there.
    """
    void = item.isNull() | F.is_variant_null(item)
    kind = _member(item, "@type")
    product = _is_text(kind) & (_get(kind, "$", "string") == "Product")
    name, text = _member(item, "name"), _member(item, "description")
    offers, image = _member(item, "offers"), _member(item, "image")
    bad_name = _given(name) & ~_is_text(name)
    bad_text = _given(text) & ~_is_text(text)
    offer = F.when(_is_array(offers), F.get(_get(offers, "$", "array<variant>"), F.lit(0))).otherwise(
        offers
    )
    price = _member(offer, "price")
    clean_name = F.when(_given(name), collapse_space(_get(name, "$", "string"))).otherwise("")
    clean_text = collapse_space(strip_tags(_get(text, "$", "string")))
    reached = ~bad_text

    def updated(name_, description_, price_, images_, failed_) -> Column:
        return F.struct(
            name_.alias("name"),
            description_.alias("description"),
            price_.alias("price"),
            images_.alias("images"),
            failed_.alias("failed"),
        )

    taken = updated(
        clean_name,
        F.when(_given(text) & ~bad_text, clean_text).otherwise(found["description"]),
        F.when(reached & _given(offers) & _given(price), _price_of(price)).otherwise(found["price"]),
        F.when(reached & _given(image), _image_texts(image)).otherwise(found["images"]),
        bad_text,
    )
    stopped = updated(
        found["name"], found["description"], found["price"], found["images"], F.lit(True)
    )
    return (
        F.when(found["failed"], found)
        .when(void, stopped)
        .when(~product, found)
        .when(bad_name, stopped)
        .otherwise(taken)
    )


def structured_product(blocks: Column) -> Column:
    """Fields from the structured-data blocks in order, up to the first that names a product.

    Blocks come as :mod:`json_blocks` cuts them down; a NULL one could not be read.
    """

    def take_block(found: Column, block: Column) -> Column:
        value = F.try_parse_json(block)
        fresh = found.withField("failed", F.lit(False))
        named = F.coalesce(found["name"] != "", F.lit(False))
        return F.when(named | value.isNull(), fresh).otherwise(
            F.aggregate(_items(value), fresh, _take_item).cast(_FOUND)
        )

    return F.aggregate(blocks, _empty_found().cast(_FOUND), take_block)


# --- page fallbacks -------------------------------------------------------------------


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def extract_products(pages: DataFrame, variant: str = RENDERED) -> DataFrame:
    """One product per page; pages without a name keep an empty or NULL name."""
    found = find_elements(pages).withColumn("ld", structured_product(F.col("json_ld")))
    ld, c = F.col("ld"), F.col
    name, text = _filled(ld["name"]), _filled(ld["description"])
    # An empty list counts as no list.
    images = F.when(F.size(ld["images"]) > 0, ld["images"])
    crumbs = F.filter(
        F.transform(c("crumbs"), trim_space), lambda t: (t != "") & (F.lower(t) != "home")
    )
    if variant == STATIC:
        name = F.coalesce(name, collapse_space(F.coalesce(_filled(c("og_title")), c("h1"), F.lit(""))))
        text = F.coalesce(
            text,
            collapse_space(
                F.coalesce(_filled(c("og_description")), _filled(c("description")), F.lit(""))
            ),
        )
        images = F.coalesce(images, F.when(c("og_image") != "", F.array("og_image")))
        shown = trim_space(c("static_price"))
    else:
        name = F.coalesce(name, _filled(collapse_space(c("h1"))), title_head(c("og_title")))
        text = F.coalesce(text, c("og_description"), c("description"))
        gallery = usable_images(F.filter(c("gallery"), lambda u: u != ""))
        images = F.coalesce(
            images,
            F.when(c("og_image").isNotNull(), F.array("og_image")),
            F.when(F.size(gallery) > 0, gallery),
        )
        shown = F.coalesce(_filled(c("rendered_price_content")), c("rendered_price"))
        # What the structured data left, were it empty.
        text, images = F.coalesce(text, ld["description"]), F.coalesce(images, ld["images"])
    given = F.when(~F.isnan(ld["price"]), ld["price"])
    price = (
        F.when(given != 0, given)
        .when(F.coalesce(shown.rlike(PRICE_PATTERN), F.lit(False)), price_of_text(shown))
        .otherwise(given)
    )
    return found.select(
        "page_id",
        "url",
        store_of_url(c("url")).alias("source"),
        name.alias("name"),
        text.alias("description"),
        price.alias("price"),
        images.alias("images"),
        category_of_crumbs(crumbs).alias("category"),
    )


def broken_blocks(pages: DataFrame) -> DataFrame:
    """Structured data that is no JSON: a row per such block with the reason."""
    return find_elements(pages).select("page_id", "url", F.explode("broken_ld").alias("reason"))


def checked_products(pages: DataFrame, variant: str = RENDERED) -> DataFrame:
    """Extracted products with a reject reason where the page gave no name."""
    return check_extracted(extract_products(pages, variant))
