"""Request rows over the star schema: raw text as a client would send it.

They exercise the lenient parsing, the defaults and the rejects on every row of
the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfledger.sources.retail_views import LINE_ID, star

_PRICE = "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING)"
_UNITS = "CAST(CAST(l_quantity AS BIGINT) AS STRING)"


def _arrival(rank: int) -> str:
    return (
        "named_struct('day', CAST(l_shipdate AS DATE), 'order_id', l_orderkey, "
        f"'line_no', l_linenumber, 'rank', {rank}) AS seq"
    )


def sale_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir, "lineitem").selectExpr(
        LINE_ID,
        _arrival(0),
        "CASE WHEN l_suppkey % 13 = 0 THEN '' ELSE CAST(l_partkey AS STRING) END AS product_id",
        "CASE WHEN l_linenumber = 7 THEN '' ELSE concat('Part ', CAST(l_partkey AS STRING)) END"
        " AS product_name",
        "CASE WHEN l_suppkey % 2 = 0 THEN 'number' ELSE 'string' END AS product_id_type",
        "CASE WHEN l_linenumber = 6 AND l_suppkey % 17 = 0 THEN '99999999999999999999' "
        f"WHEN l_linenumber = 1 THEN concat(' ', {_UNITS}, ' pcs') WHEN l_linenumber = 2 THEN '0' "
        f"WHEN l_linenumber = 3 THEN concat({_UNITS}, '.7') WHEN l_linenumber = 4 THEN 'many' "
        f"ELSE {_UNITS} END AS quantity_sold",
        "CASE WHEN l_linenumber = 2 AND l_suppkey % 3 = 0 THEN 'number' ELSE 'string' END AS quantity_sold_type",
        "CASE WHEN l_linenumber = 4 AND l_suppkey % 19 = 1 THEN '20000000000.125' "
        "WHEN l_linenumber = 4 AND l_suppkey % 19 = 2 THEN '1e40' "
        f"WHEN l_linenumber = 5 THEN '' WHEN l_returnflag = 'R' THEN NULL "
        f"WHEN l_linenumber = 6 THEN concat({_PRICE}, ' USD') ELSE {_PRICE} END AS sale_price",
        f"CASE WHEN l_linestatus = 'F' THEN {_PRICE} END AS cost_price",
        "CASE WHEN l_tax > 0 THEN 'taxed' ELSE '' END AS notes",
        "CASE WHEN l_linestatus = 'F' THEN 'Cash' END AS payment_method",
        "CASE WHEN l_linenumber = 1 THEN '' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END"
        " AS sold_at",
    )


def restock_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir, "lineitem").selectExpr(
        LINE_ID,
        _arrival(1),
        "CASE WHEN l_suppkey % 13 = 0 THEN '' ELSE CAST(l_partkey AS STRING) END AS product_id",
        "CASE WHEN l_linenumber <> 7 THEN concat('Part ', CAST(l_partkey AS STRING)) END"
        " AS product_name",
        "CASE WHEN l_suppkey % 2 = 0 THEN 'number' ELSE 'string' END AS product_id_type",
        f"CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN '0' WHEN 3 THEN concat('-', {_UNITS}) "
        f"ELSE {_UNITS} END AS quantity_added",
        "CASE WHEN l_linenumber = 2 AND l_suppkey % 3 = 0 THEN 'number' ELSE 'string' END AS quantity_added_type",
        f"CASE WHEN l_linestatus = 'F' THEN {_PRICE} ELSE '0' END AS cost_per_unit",
        "CASE WHEN l_tax > 0 THEN 'taxed' ELSE '' END AS notes",
        "CASE WHEN l_linenumber = 4 THEN '' ELSE CAST(l_suppkey AS STRING) END AS member_id",
        "CASE WHEN l_linenumber = 5 THEN 'all' ELSE '12' END AS member_qty",
        "CASE WHEN l_linenumber = 6 THEN '' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS restocked_at",
    )


def void_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voids of the lines with flag A and status O, 30 days later; some come twice or name no sale."""
    lines = star(spark, sf_dir, "lineitem").where("l_returnflag = 'A' AND l_linestatus = 'O'")
    sent = lines.selectExpr(
        "*", "explode(CASE WHEN l_linenumber = 2 THEN array(2, 3) ELSE array(2) END) AS rank"
    )
    return sent.selectExpr(
        "concat('void-', rank, '-', " + LINE_ID.removesuffix(" AS id") + ") AS id",
        "named_struct('day', date_add(CAST(l_shipdate AS DATE), 30), 'order_id', l_orderkey, "
        "'line_no', l_linenumber, 'rank', rank) AS seq",
        "CASE WHEN l_linenumber = 5 THEN 'none' ELSE " + LINE_ID.removesuffix(" AS id") + " END AS sale_id",
    )


def expense_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        star(spark, sf_dir, "orders")
        .selectExpr(
            "-1 - o_orderkey AS id",
            "CASE WHEN o_orderpriority LIKE '1%' THEN '' ELSE o_orderpriority END AS category",
            "CASE WHEN o_orderpriority LIKE '2%' THEN '' WHEN o_orderpriority LIKE '3%' THEN '0' "
            "WHEN o_custkey % 50 = 1 THEN '-1e99' "
            "ELSE CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS STRING) END AS amount",
            "CASE WHEN o_custkey % 2 = 0 THEN 'number' ELSE 'string' END AS amount_type",
            "CASE WHEN o_orderpriority LIKE '4%' THEN 'Card' END AS payment_method",
            "CASE WHEN o_orderpriority LIKE '5%' THEN '' ELSE o_orderstatus END AS notes",
            "CASE WHEN o_orderpriority LIKE '4%' THEN '' "
            "ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS expense_date",
        )
    )


def product_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes per part; the second leaves out most fields for half of them.

    Parts are dealt by key first: millions of them fit one row group of a file, and
    one task would parse and sort all their requests.
    """
    sent = star(spark, sf_dir, "part").repartition("p_partkey").selectExpr("*", "explode(array(1L, 2L)) AS seq")
    return sent.selectExpr(
        "p_partkey AS id",
        "seq",
        "CASE WHEN p_brand = 'Brand#1' THEN '' ELSE concat(upper(p_name), ' ', seq) END AS name",
        "CASE WHEN p_type = 'LARGE' THEN '' ELSE p_type END AS category",
        "CASE WHEN seq = 2 THEN '' ELSE p_brand END AS subcategory",
        "CASE WHEN p_size > 25 THEN p_name END AS description",
        "CASE WHEN p_size > 40 THEN '' ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) END"
        " AS price",
        "CASE WHEN p_size > 30 THEN 'box' END AS price_unit",
        "concat('SKU-', CAST(p_partkey AS STRING)) AS sku",
        "'' AS source",
        "CASE WHEN p_size < 6 THEN 'low_stock' ELSE '' END AS stock",
        "CASE WHEN p_size > 25 THEN array(concat('http://img/', CAST(p_partkey AS STRING))) END AS images",
        "CASE WHEN p_size > 20 THEN 'yes' WHEN p_size > 10 THEN 'false' ELSE '' END AS featured",
        "CASE WHEN p_size > 15 THEN 'string' ELSE 'boolean' END AS featured_type",
        "CAST(p_size % 5 AS STRING) AS sort_order",
        "CASE WHEN p_size > 35 THEN concat(CAST(p_size AS STRING), ' left') "
        "WHEN p_size > 30 THEN '0x1F' ELSE CAST(p_size AS STRING) END AS quantity",
        "CAST(NULL AS STRING) AS source_url",
        "'' AS cost_price",
        "'20.5' AS coverage_sqft",
        "CASE WHEN p_size > 25 THEN '3' ELSE '' END AS member_id",
        "CASE WHEN p_size > 25 THEN '2' END AS member_qty",
    )


def sale_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two edits of each sale with return flag N and line status O."""
    lines = star(spark, sf_dir, "lineitem").where("l_returnflag = 'N' AND l_linestatus = 'O'")
    sent = lines.selectExpr(
        "*", "explode(CASE WHEN l_linenumber > 3 THEN array(1L, 2L) ELSE array(1L) END) AS seq"
    )
    return sent.selectExpr(
        LINE_ID,
        "seq",
        "CASE WHEN seq = 2 THEN CASE WHEN l_linenumber = 4 THEN '0' WHEN l_linenumber = 5 THEN '1e12' "
        "WHEN l_linenumber = 7 THEN '1e300' ELSE '99.5 each' END "
        f"ELSE {_PRICE} END AS sale_price",
        "CASE WHEN seq = 2 THEN '' WHEN l_linenumber = 5 THEN 'Check' END AS payment_method",
        "CASE WHEN seq = 2 AND l_linenumber = 6 THEN '' WHEN l_linenumber <> 1 "
        "THEN concat('edit ', seq) END AS notes",
    )


def member_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members for every nation key and customer: updates and inserts by id."""
    return star(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        "CAST(1 AS BIGINT) AS seq",
        "CASE WHEN c_nationkey = 3 THEN '' ELSE c_name END AS name",
        "CASE WHEN c_nationkey > 10 THEN '' ELSE CAST(c_nationkey AS STRING) END AS phone",
        "CAST(NULL AS STRING) AS notes",
    )


_LD = '<script type="application/ld+json">'
# One kind of shop page each; `{name}`, `{price}` and `{id}` are columns of the part.
_SHOP_PAGES = (
    _LD + '{"@type":"Product","name":"  {name}   big ","description":"<b>{name}</b>  here","offers":{"price":{price}},'
    '"image":"http://img/{id}.png"}</script>',
    _LD + '[{"@type":"Organization","name":"Org"},{"@type":"Product","name":"{name}","offers":[{"price":"12.50 USD"},{"price":99}],'
    '"image":["http://a/1","http://a/2",7,"http://a/3","4","5","6","7"]}]</script>',
    _LD + '{"@graph":[{"@type":"WebPage"},{"@type":"Product","name":"{name}","description":"d","offers":{"price":0},'
    '"image":{"url":"x"}}]}</script><span class="price__value">$1,299.00</span>',
    '<meta property="description" content="trap"><meta name="description" content="a  page">' + _LD
    + '{"@type": broken</script>' + _LD + '{"@type":"Product","name":"{name}"}</script>',
    '<meta property="og:title" content="{name} | Shop"><meta property="og:description" content="og text">'
    '<meta property="og:image" content="http://og/{id}"><b class="Price">now 1,234,567</b>',
    '<h1>{name} <i>new</i></h1><meta itemprop="price" content="45.5"><div class="media"><img src="http://g/1">'
    '<img src="http://g/placeholder"><img data-src="http://g/2"><img src="data:x"></div>',
    '<nav class="breadcrumb"><a>Home</a> <a>{crumb}</a></nav><h1>{name}</h1>',
    _LD + '{"@type":"Product","name":""}</script>' + _LD
    + '{"@type":"Product","name":"{name}","offers":{"price":true}}</script><i data-testid="price">Call us</i>',
    "<p>{name}</p>",
    '<h1>{name}</h1><ul class="carousel">' + "".join(f'<img src="http://c/{i}">' for i in range(8)) + "</ul>",
)


def shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a shop for every part, of ten kinds and three stores."""
    html = F.element_at(F.array(*map(F.lit, _SHOP_PAGES)), (F.col("p_partkey") % 10 + 1).cast("int"))
    crumb = F.element_at(F.array(*map(F.lit, ("Garden", "Vinyl Plank", "Bath & Sinks"))), F.col("p_size") % 3 + 1)
    values = {
        "{name}": F.col("p_name"), "{price}": F.col("p_retailprice").cast("decimal(12,2)").cast("string"),
        "{id}": F.col("p_partkey").cast("string"), "{crumb}": crumb,
    }
    for mark, value in values.items():
        html = F.replace(html, F.lit(mark), value)
    host = F.element_at(F.array(*map(F.lit, ("www.homedepot.com", "www.lowes.com", "example.org"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return star(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://"), host, F.lit("/p/"), "p_partkey").alias("url"), html.alias("html")
    )


# Blocks with repeated names, broken text, and more text than a value of a column may have.
_BLOCK_PAGES = (
    _LD + '{"@type":"Thing","name":"wrong","offers":{"price":1,"price":"{price}"},"@type":"Product","name":"{name}"}</script>',
    _LD + '{"@type":"Product","name":"{name}",}</script>' + _LD + '{"@type":"Product","name":"{name} ok"}</script>',
    _LD + '[1,{"@type":"Product","@type":"Other","name":"x"},{"@type":"Product","name":"a","image":["i1"],"name":"{name}","image":"i2"}]</script>',
    "<h1>{name}</h1>" + _LD + '{"@type":"Product","name":"x","offers":{"price":NaN}}</script>' + _LD + "not {even</script>",
    _LD + '{"@type":"Product","reviews":[{"text":"{long}"}],"offers":[{"price":{price},"more":{"a":[1,2]}}],"name":"{name}"}</script>',
)


def block_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for every part, of five kinds, with structured data that is hard to read."""
    html = F.element_at(F.array(*map(F.lit, _BLOCK_PAGES)), (F.col("p_partkey") % 5 + 1).cast("int"))
    values = {
        "{name}": F.col("p_name"), "{price}": F.col("p_retailprice").cast("decimal(12,2)").cast("string"),
        "{long}": F.repeat(F.lit("so long "), F.lit(500)),
    }
    for mark, value in values.items():
        html = F.replace(html, F.lit(mark), value)
    return star(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://example.org/"), "p_partkey").alias("url"), html.alias("html")
    )
