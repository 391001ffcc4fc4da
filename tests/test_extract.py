import json

import pytest
from pyspark.sql import functions as F

from shelfledger.functions.json_blocks import read_block
from shelfledger.functions.page_elements import page_elements
from shelfledger.operators.extract import RENDERED, STATIC, broken_blocks, checked_products, extract_products, structured_product
from shelfledger.operators.validation import accepted, rejected

NBSP = " "


def ld(value):
    text = value if isinstance(value, str) else json.dumps(value)
    return f'<script type="application/ld+json">{text}</script>'


def product(**fields):
    return {"@type": "Product", **fields}


PAGES = {
    1: ld(product(name=" A\n  b ", description="<p>Fine" + NBSP + " oak</p>", offers=[{"price": "12.50"}, {"price": 3}], image=["http://x/1", 7, {"url": "u"}, "http://x/2"])) + "<h1>Other</h1>",
    2: ld([{"@type": "Thing", "name": "no"}, product(name="Two", offers={"price": 8})]),
    3: ld({"@graph": [product(name="One", description="first"), product(name="Last")]}),
    4: ld("{broken") + ld(product(name="Good")),
    5: ld(product(name="", description="kept")) + ld(product(name="Later")),
    6: ld(product(name="Zero", offers={"price": 0})) + '<b class="ProductPrice">$1,299.00</b>',
    7: '<meta property="og:title" content=" Sink | Shop "><meta property="og:description" content="a  b"><meta property="og:image" content="http://i/og.jpg">',
    8: '<h1>Tile</h1><div class="price__value">1,234,567</div>',
    9: '<h1>Tile</h1><div class="price__value">Call us</div>',
    10: '<h1>Saw</h1><meta itemprop="price" content="49.95">',
    11: '<h1>G</h1><div class="media"><p><img src="/a.jpg"><img src="http://h/placeholder.png"><img src="data:x"><img data-src="http://h/b.jpg"></div><img src="http://h/out.jpg">',
    12: '<h1>F</h1><nav aria-label="Breadcrumb trail"><a>Home</a><a> Vinyl Plank </a></nav>',
    13: '<h1>V</h1><ul class="breadcrumbs"><li><a>Bath</a><li><a>Sinks</a></ul>',
    14: '<h1>T</h1><div aria-label="breadcrumb"><a>Hardware</a></div>',
    15: '<h1>O</h1><div class="breadcrumb"><a>Garden</a></div>',
    16: "<p>nothing here</p>",
    17: ld(product(name=5)) + "<h1>Head &amp; tail</h1>",
    18: ld([product(name="Cut", description=5, image="http://x/never")]),
    19: ld(product(name="Single", image="http://x/one")),
    20: ld("null") + "<h1>Null block</h1>",
    21: ld(product(name="Neg", offers={"price": "abc"})) + '<i class="pip-price">,</i>',
    22: '<h1 class="x"> </h1><h1>Second</h1><meta property="og:title" content="Og title">',
    23: ld(product(name="Objects", image=[{"url": "x"}])) + '<div class="gallery"><img src="http://g/1"></div>',
}


def run(spark, variant):
    rows = [(i, "https://www.homedepot.com/p/1" if i == 1 else "https://shop.example/p", h) for i, h in PAGES.items()]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r.page_id: r for r in extract_products(df, variant).collect()}


def test_rendered(spark):
    got = run(spark, RENDERED)
    assert (got[1].name, got[1].description, got[1].price) == ("A b", "Fine oak", 12.5)
    assert got[1].images == ["http://x/1", "http://x/2"] and got[1].source == "Home Depot"
    assert (got[2].name, got[2].price, got[2].source) == ("Two", 8.0, "Other")
    assert (got[3].name, got[3].description) == ("Last", "first")
    assert got[4].name == "Good"
    assert (got[5].name, got[5].description) == ("Later", "kept")
    assert got[6].price == 1299.0
    assert (got[7].name, got[7].description, got[7].images) == ("Sink", "a  b", ["http://i/og.jpg"])
    assert got[8].price == 1234.0
    assert got[9].price is None
    assert got[10].price == 49.95
    assert got[11].images == ["https://shop.example/a.jpg", "http://h/b.jpg"]
    assert [got[i].category for i in (12, 13, 14, 15, 16)] == ["Flooring", "Vanity", "Tools", "Other", None]
    assert got[17].name == "Head & tail"
    assert (got[18].name, got[18].images) == ("Cut", None)
    assert got[19].images == ["http://x/one"]
    assert got[20].name == "Null block"
    assert got[21].price is None
    assert got[22].name == "Og title"
    assert got[23].images == ["http://g/1"]


def test_static(spark):
    got = run(spark, STATIC)
    assert (got[7].name, got[7].description) == ("Sink | Shop", "a b")
    assert got[6].price == 1299.0
    assert got[8].price == 1234.0
    assert got[10].price is None
    assert got[11].images is None
    assert got[22].name == "Og title"
    assert got[13].category == "Vanity"


def test_reject_without_name(spark):
    rows = [(16, "http://x", PAGES[16]), (8, "http://x", PAGES[8])]
    checked = checked_products(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert [r.page_id for r in accepted(checked).collect()] == [8]
    assert [r.page_id for r in rejected(checked).collect()] == [16]


def test_property_and_name_are_told_apart():
    page = page_elements('<meta property="description" content="p"><meta name="og:title" content="n">')
    assert page["description"] is None and page["og_title"] is None


@pytest.mark.parametrize(
    ("text", "name", "price", "images"),
    [
        ('{"@type":"Product","name":"a","name":"b"}', "b", None, None),
        ('{"name":"a","@type":"Product","@type":"Thing"}', None, None, None),
        ('{"@type":"Product","name":"a","offers":[{"price":1}],"offers":{"price":2}}', "a", 2.0, None),
        ('{"@graph":[{"@type":"Product","name":"x"}],"@graph":[{"@type":"Product","name":"y"}]}', "y", None, None),
        ('{"@graph":[],"@type":"Product","name":"no"}', None, None, None),
        ('{"@graph":"text","@type":"Product","name":"no"}', None, None, None),
        ('{"@graph":0,"@type":"Product","name":"yes"}', "yes", None, None),
        ('\u00a0\ufeff {"@type":"Product","name":"t"} \u3000', "t", None, None),
        ('[{"@type":"Product","name":"a"},null,{"@type":"Product","name":"b"}]', "a", None, None),
        ('[[], 1, "x", true, {"@type":"Product","name":"c","image":[1,"p",{},"q"]}]', "c", None, ["p", "q"]),
        ('{"@type":"Product","name":"n","offers":{"price":' + "9" * 400 + "}}", "n", 1.7976931348623157e308, None),
        ('{"@type":"Product","name":"n","offers":"free"}', "n", None, None),
        ('{"@type":["Product"],"name":"n"}', None, None, None),
        ('{"@type":"Product","name":"half \\ud800 pair \\ud83d\\ude42"}', "half \ufffd pair 🙂", None, None),
        ('{"@type":"Product","name":"big","x":"' + "y" * 20_000_000 + '","offers":{"price":"3"}}', "big", 3.0, None),
    ],
)
def test_blocks_of_structured_data(spark, text, name, price, images):
    block, why = read_block(text)
    assert why is None and len(block) < 500
    found = spark.createDataFrame([([block],)], "b array<string>").select(structured_product(F.col("b")).alias("p")).first().p
    assert (found.name or None, found.price, found.images or None) == (name, price, images)


@pytest.mark.parametrize("text", ["", "{", '{"a":1,}', '{"a":NaN}', "[Infinity]", "{'a':1}", '"\x01"', "[1] 2", "\u00a0", "[" * 200_000])
def test_broken_blocks_have_a_reason(text):
    block, why = read_block(text)
    assert block is None and why


def test_broken_blocks_are_listed(spark):
    html = '<script type="application/ld+json">{"a":}</script><script type="application/ld+json">{}</script>'
    rows = spark.createDataFrame([(1, "u", html), (2, "u", None), (3, "u", "<p>")], "page_id bigint, url string, html string")
    assert [tuple(r) for r in broken_blocks(rows).collect()] == [(1, "u", "block 1: Expecting value at 5")]
