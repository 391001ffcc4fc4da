"""The named queries over the star schema; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfledger.functions.coerce import array_json
from shelfledger.operators import catalog, ledger, maintenance, members, sales, slot
from shelfledger.operators import validation as check
from shelfledger.operators.extract import RENDERED, STATIC, broken_blocks, checked_products
from shelfledger.operators.filters import lookup_many
from shelfledger.plans import day_cube, pnl, product_pl, record
from shelfledger.session import stage, staging_path
from shelfledger.sources import append_ledger
from shelfledger.sources import requests as req
from shelfledger.sources import retail_views as view
from shelfledger.sources.keyed_table import KeyedTable
from shelfledger.sources.tables import json_rows, keyed_json, row_count, seed_if_empty
from shelfledger.streaming import ledger_stream, slot_stream, totals_stream
from shelfledger.streaming.runs import drain, drain_latest

Query = Callable[[SparkSession, str], DataFrame]

START, END = "1996-01-01", "1998-12-31"
SLOT_TTL = 43_200
TODAY = date(2002, 1, 1)

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# --- catalogue ----------------------------------------------------------------------


@query
def catalog_search(spark, d):
    return catalog.search_products(view.products(spark, d), view.members(spark, d), search="RinG")


@query
def catalog_category(spark, d):
    return catalog.search_products(
        view.products(spark, d), view.members(spark, d), category="Flooring", stock="in_stock"
    )


@query
def catalog_featured(spark, d):
    return catalog.search_products(
        view.products(spark, d), view.members(spark, d), category="All", search="bl_e", featured="1"
    )


@query
def product_lookup(spark, d):
    """Catalogue rows of the products that were restocked with a member share."""
    fronted = view.restocks(spark, d).where("member_qty > 0").select("product_id")
    return lookup_many(view.products(spark, d), "id", fronted)


@query
def categories(spark, d):
    return catalog.categories(view.products(spark, d))


# --- settings -----------------------------------------------------------------------


def _settings(spark, d):
    last = maintenance.latest(view.settings_writes(spark, d), "key", ["written_at", "seq"])
    return last.select("key", "value")


@query
def settings_object(spark, d):
    return catalog.settings_object(_settings(spark, d))


@query
def settings_map(spark, d):
    """The settings object, read back to keys and values."""
    entries = catalog.settings_entries(_settings(spark, d))
    return entries.select(F.explode(F.from_json("json", "map<string, string>")))


@query
def settings_defaults(spark, d):
    """Every part key is a setting with its name as the default."""
    parts = view.star(spark, d, "part").selectExpr("CAST(p_partkey AS STRING) AS key", "p_name AS value")
    return catalog.with_default_settings(_settings(spark, d), parts)


@query
def settings_fallback(spark, d):
    known = catalog.setting_or_default(_settings(spark, d), "7", "none")
    return known.unionByName(
        catalog.setting_or_default(_settings(spark, d), "business_name", "Your Business Name")
    )


@query
def settings_upsert(spark, d):
    """Later writes over the table left by the sign-ups' writes."""
    events = view.star(spark, d, "events")
    writes = events.selectExpr(
        "CAST(user_id AS STRING) AS key", "props AS value", "ts", "event_id AS seq", "event_type"
    )
    first = maintenance.latest(writes.where("event_type = 'signup'"), "key", ["ts", "seq"])
    rest = writes.where("event_type <> 'signup'")
    later = check.normal_settings(rest)
    return maintenance.upsert(first.select("key", "value"), later, "key", ["seq"])


# --- sales, products, expenses ----------------------------------------------------------


@query
def sales_by_product(spark, d):
    return sales.product_sales(view.sales(spark, d))


@query
def sales_by_product_map(spark, d):
    """The same as keyed JSON, read back to columns."""
    entries = keyed_json(sales.product_sales(view.sales(spark, d)), "product_id")
    shape = "units_sold bigint, revenue double, cogs double, transactions bigint, profit double"
    return entries.select("key", F.from_json("json", shape).alias("r")).select("key", "r.*")


@query
def sales_ledger(spark, d):
    return sales.sales_ledger(view.sales(spark, d))


#: Rows of a page of the sales listing.
PAGE = 500


@query
def sales_page(spark, d):
    """The third page of the sales listing, from the ends of the two before it."""
    rows, token = view.sales(spark, d), None
    for _ in range(2):
        token = sales.page_token(sales.ledger_page(rows, PAGE, token))
    return sales.ledger_page(rows, PAGE, token)


@query
def ledger_by_product(spark, d):
    return sales.sales_ledger(view.sales(spark, d), product_id=17)


@query
def ledger_of_product_zero(spark, d):
    """0 is an id like any other."""
    sold = sales.sales_ledger(view.sales(spark, d), product_id=0).select("id", "product_id", "sold_at")
    added = sales.restock_history(view.restocks(spark, d), product_id=0)
    return sold.unionByName(added.select("id", "product_id", F.col("restocked_at").alias("sold_at")))


@query
def restock_history(spark, d):
    return sales.restock_history(view.restocks(spark, d))


@query
def sales_json(spark, d):
    """The sales ledger as JSON rows, read back to columns."""
    listed = view.sales(spark, d).withColumns({"profit": F.col("profit").cast("double"), "sold_at": F.to_date("sold_at")})
    rows = json_rows(listed.drop("sale_price", "cost_price"))
    shape = (
        "id string, order_id bigint, line_no int, product_id bigint, product_name string, quantity_sold bigint, "
        "payment_method string, notes string, member_id bigint, member_qty_sold bigint, sold_at date, profit double"
    )
    return rows.select(F.from_json("json", shape).alias("r")).select("r.*")


@query
def product_rows(spark, d):
    return row_count(view.products(spark, d))


@query
def product_pl_summary(spark, d):
    return product_pl.product_pl(view.products(spark, d), view.sales(spark, d))


@query
def product_pl_doc(spark, d):
    """Every entry of every product's document, read back to columns."""
    entries = product_pl.product_documents(
        view.products(spark, d), view.sales(spark, d), view.restocks(spark, d)
    )
    shape = (
        "units_sold bigint, quantity_sold bigint, quantity_added bigint, "
        "gross_profit double, profit double, cost_per_unit double, inventory_value double, revenue double, "
        "cogs double, transactions bigint, margin_pct double, product_name string, payment_method string, "
        "notes string, member_id bigint, member_qty_sold bigint, member_qty bigint, id string, sale_price double"
    )
    return entries.withColumn("e", F.from_json("entry", shape)).select(
        "product_id",
        "section",
        "happened_at",
        F.coalesce("e.units_sold", "e.quantity_sold", "e.quantity_added").alias("units"),
        F.coalesce("e.gross_profit", "e.profit").alias("profit"),
        F.coalesce("e.cost_per_unit", "e.inventory_value").alias("cost"),
        *[F.col("e")[c].alias(c) for c in ("id", "revenue", "cogs", "transactions", "margin_pct", "product_name")],
        *[F.col("e")[c].alias(c) for c in ("payment_method", "notes", "member_id", "sale_price")],
        F.coalesce("e.member_qty_sold", "e.member_qty").alias("member_units"),
    )


@query
def expenses_list(spark, d):
    return sales.expense_list(view.expenses(spark, d), START, END)


@query
def expense_breakdown(spark, d):
    return sales.expense_breakdown(view.expenses(spark, d), START, END)


@query
def inventory_value(spark, d):
    return sales.inventory_value(view.products(spark, d)).drop("_own_value")


@query
def pl_summary(spark, d):
    return pnl.pl_summary(
        view.sales(spark, d), view.expenses(spark, d), view.products(spark, d), START, END
    )


def _cube(days, name):
    """Daily sums with their prefixes, as a stored table."""
    return stage(day_cube.with_prefixes(days), name)


@query
def pl_summary_from_days(spark, d):
    """The summary of the range, of stored daily totals."""
    sold = _cube(day_cube.sale_days(view.sales(spark, d)), "sale-days")
    spent = _cube(day_cube.expense_days(view.expenses(spark, d)), "expense-days")
    return day_cube.pl_summary_from_days(sold, spent, view.products(spark, d), START, END)


@query
def stream_pl_summary(spark, d):
    """The same of daily totals that streams of sales and expenses add up."""
    keys = view.star(spark, d, "supplier").count() + 2
    sold = day_cube.stream_days(view.sales_of(_stream(spark, d, "lineitem"), keys), day_cube.sale_days, "sale-days")
    spent = day_cube.stream_days(view.expenses_of(_stream(spark, d, "orders")), day_cube.expense_days, "expense-days")
    return day_cube.pl_summary_from_days(
        _cube(sold, "sale-days"), _cube(spent, "expense-days"), view.products(spark, d), START, END
    )


@query
def pl_all_time(spark, d):
    return pnl.pl_summary(view.sales(spark, d), view.expenses(spark, d), view.products(spark, d))


@query
def pl_top_products(spark, d):
    return sales.top_products(view.sales(spark, d), START, END)


@query
def pl_recent_sales(spark, d):
    return sales.recent_sales(view.sales(spark, d), view.members(spark, d), START, END)


@query
def pl_doc(spark, d):
    """The nested report, unnested to one row per entry."""
    doc = pnl.pl_document(
        view.sales(spark, d), view.expenses(spark, d), view.products(spark, d),
        view.members(spark, d), START, END,
    )

    def entry(section, label, units, amount):
        return F.struct(
            F.lit(section).alias("section"),
            label.cast("string").alias("label"),
            units.cast("bigint").alias("units"),
            amount.cast("double").alias("amount"),
        )

    none = F.lit(None)
    summary = [
        entry("summary", F.lit(name), F.col("transactions"), F.col(name))
        for name in ("revenue", "cogs", "net_profit", "total_invested")
    ]
    entries = F.concat(
        F.array(*summary),
        F.transform(
            "expense_breakdown", lambda e: entry("expense_breakdown", e["category"], none, e["total"])
        ),
        F.transform(
            "top_products", lambda e: entry("top_products", e["product_name"], e["units"], e["revenue"])
        ),
        F.transform(
            "recent_sales", lambda e: entry("recent_sales", e["id"], e["quantity_sold"], e["profit"])
        ),
    )
    return doc.select(F.inline(entries))


# --- members ----------------------------------------------------------------------------


@query
def member_statements(spark, d):
    return members.member_statements(
        view.members(spark, d), view.products(spark, d), view.sales(spark, d)
    )


@query
def member_products(spark, d):
    return members.member_products(view.products(spark, d))


@query
def products_of_member(spark, d):
    return members.member_products(view.products(spark, d), 6)


# --- table maintenance ------------------------------------------------------------------


def _product_table(spark, d):
    """Catalogue columns that a request can change, with the creation day."""
    return view.products(spark, d).select(
        "id", "name", "category", "subcategory", "description",
        "price", "stock", "featured", "sort_order",
        "quantity", F.col("cost_price").cast("double").alias("cost_price"), "member_id",
        "member_qty", "created_at", F.col("created_at").alias("updated_at"),
    )


def _product_changes(spark, d):
    valid = check.accepted(check.check_named(req.product_requests(spark, d)))
    return check.normal_products(valid, now=F.lit(TODAY))


@query
def product_insert(spark, d):
    """The table with every accepted request as a new row, with its defaults."""
    table = _product_table(spark, d).withColumn("images", F.array().cast("array<string>"))
    rows = _product_changes(spark, d).withColumn("id", F.expr("-1 - 2 * id - seq"))
    return maintenance.insert(table, rows).withColumn("images", array_json(F.col("images")))


@query
def product_upsert(spark, d):
    table = _product_table(spark, d)
    changed = [c for c in table.columns if c not in ("id", "created_at")]
    return maintenance.overwrite(table, _product_changes(spark, d), changed)


#: Files of a stored table.
STORED = 16


def _stored(rows, name):
    table = KeyedTable(rows.sparkSession, staging_path(rows.sparkSession, name), rows.schema)
    table.create(rows, STORED)
    return table


@query
def product_upsert_stored(spark, d):
    """The same on a stored table, where files without a changed key stay."""
    table = _stored(_product_table(spark, d), "products")
    changed = [c for c in table.schema.names if c not in ("id", "created_at")]
    table.overwrite(stage(_product_changes(spark, d), "product-changes"), changed)
    return table.read()


@query
def product_delete_stored(spark, d):
    table = _stored(_product_table(spark, d), "products")
    table.delete(view.star(spark, d, "part").where("p_size > 40").selectExpr("p_partkey AS id"))
    return table.read()


@query
def sale_edit_stored(spark, d):
    """Edits of stored sales rewrite the files that hold them."""
    stored = view.sales(spark, d)
    edits = stage(check.accepted(check.check_edits(req.sale_edits(spark, d), stored)), "edits")
    # The table has the types and the column that an edit gives.
    table = _stored(maintenance.edit_sales(stored, edits.where("false")), "sales")
    table.merge(stage(maintenance.last_edits(edits), "last-edits"), lambda rows: maintenance.edited_sales(rows, stored.columns))
    return table.read().select(
        "id", "sale_price", "cost_price", "quantity_sold", "payment_method", "notes", "profit", "profit_line"
    )


@query
def member_upsert_stored(spark, d):
    table = _stored(_member_table(spark, d), "members")
    table.upsert(_member_changes(spark, d))
    return _dated(table.read())


@query
def product_delete(spark, d):
    removed = view.star(spark, d, "part").where("p_size > 40").selectExpr("p_partkey AS id")
    return maintenance.delete(_product_table(spark, d), removed)


@query
def expense_append(spark, d):
    valid = check.accepted(check.check_expenses(req.expense_requests(spark, d)))
    typed = check.normal_expenses(valid, F.lit(TODAY))
    table = view.expenses(spark, d).withColumns(
        {"amount": F.col("amount").cast("double"), "payment_method": F.lit("Cash"), "notes": F.lit(None).cast("string")}
    )
    return maintenance.append(table, typed)


@query
def expense_delete(spark, d):
    removed = view.star(spark, d, "orders").where("o_totalprice < 100000").selectExpr("o_orderkey AS id")
    return maintenance.delete(view.expenses(spark, d), removed)


@query
def sale_edit(spark, d):
    stored = view.sales(spark, d)
    edits = check.accepted(check.check_edits(req.sale_edits(spark, d), stored))
    return maintenance.edit_sales(stored, edits).select(
        "id", "sale_price", "cost_price", "quantity_sold", "payment_method", "notes", "profit", "profit_line"
    )


def _member_table(spark, d):
    return view.members(spark, d).withColumns(
        {"notes": F.lit(None).cast("string"), "created_at": F.lit(TODAY).cast("timestamp") - F.expr("INTERVAL 1 DAY")}
    )


def _member_changes(spark, d):
    valid = check.accepted(check.check_named(req.member_requests(spark, d)))
    return check.normal_members(valid, F.lit(TODAY).cast("timestamp"))


def _dated(members):
    return members.withColumn("created_at", F.to_date("created_at"))


@query
def member_insert(spark, d):
    rows = _member_changes(spark, d).withColumn("id", F.expr("-1 - id"))
    return _dated(maintenance.insert(_member_table(spark, d), rows))


@query
def member_update(spark, d):
    """Members change, unknown ids do nothing."""
    changed = ["name", "phone", "notes"]
    return _dated(maintenance.overwrite(_member_table(spark, d), _member_changes(spark, d), changed))


@query
def member_upsert(spark, d):
    """Insert or replace by id, as a sync from another register would."""
    return _dated(maintenance.upsert(_member_table(spark, d), _member_changes(spark, d)))


def _removed_members(spark, d):
    return view.star(spark, d, "supplier").where("s_acctbal < 2000").selectExpr("s_suppkey AS id")


@query
def member_delete(spark, d):
    return maintenance.delete(view.members(spark, d), _removed_members(spark, d))


@query
def member_unlink(spark, d):
    return maintenance.unlink_members(view.products(spark, d), _removed_members(spark, d)).select(
        "id", "member_id", "member_qty"
    )


@query
def seed_if_empty_table(spark, d):
    """An empty catalogue takes the seed, a filled one does not."""
    table, seed = _product_table(spark, d), _product_table(spark, d).where("featured = 1")
    empty = table.where("quantity < 0")
    return (
        seed_if_empty(empty, seed)
        .withColumn("target", F.lit("empty"))
        .unionByName(seed_if_empty(table, seed).withColumn("target", F.lit("filled")))
        .select("target", "id", "name")
    )


# --- validation ---------------------------------------------------------------------------


@query
def validate_sales(spark, d):
    valid = check.accepted(check.check_sales(req.sale_requests(spark, d)))
    return check.normal_sales(valid, F.lit(TODAY)).drop("seq").withColumn("sold_at", F.to_date("sold_at"))


@query
def validate_restocks(spark, d):
    valid = check.accepted(check.check_restocks(req.restock_requests(spark, d)))
    typed = check.normal_restocks(valid, F.lit(TODAY)).drop("seq")
    return typed.withColumn("restocked_at", F.to_date("restocked_at"))


@query
def validate_rejects(spark, d):
    """Rejected requests of all kinds with their reasons."""
    kinds = {
        "sale": check.check_sales(req.sale_requests(spark, d)),
        "restock": check.check_restocks(req.restock_requests(spark, d)),
        "expense": check.check_expenses(req.expense_requests(spark, d)),
        "product": check.check_named(req.product_requests(spark, d)),
        "member": check.check_named(req.member_requests(spark, d)),
        "sale edit": check.check_edits(
            req.sale_edits(spark, d), view.sales(spark, d).where("product_id IS NOT NULL")
        ),
        "void": _voids(spark, d),
        "import": check.check_imports(
            view.star(spark, d, "pages").selectExpr("page_id AS id", "CASE WHEN page_id % 5 = 0 THEN '' ELSE url END AS url")
        ),
    }
    result = None
    for kind, checked in kinds.items():
        rows = check.rejected(checked).select(
            F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), check.REASON
        )
        result = rows if result is None else result.unionByName(rows)
    return result


# --- stock ledger ---------------------------------------------------------------------------

_HISTORY = [
    "product_id", "day", "order_id", "line_no", "kind", "member_sold", "owner_sold", "quantity",
    "member_qty", "current_member", "cost_price", "stock", "sold_out",
]


@query
def ledger_state(spark, d):
    """Sales and restocks only."""
    events = view.ledger_events(spark, d, voids=False)
    return ledger.ledger_state(view.products(spark, d), events, view.LEDGER_ORDER)


@query
def ledger_history(spark, d):
    events = view.ledger_events(spark, d, voids=False)
    history = ledger.ledger_history(view.products(spark, d), events, view.LEDGER_ORDER, keep=_HISTORY)
    return history.select(*_HISTORY)


@query
def ledger_void(spark, d):
    """Sales, restocks and voids."""
    events = view.ledger_events(spark, d)
    history = ledger.ledger_history(view.products(spark, d), events, view.LEDGER_ORDER, keep=_HISTORY)
    return history.select(*_HISTORY)


@query
def ledger_void_state(spark, d):
    events = view.ledger_events(spark, d)
    return ledger.ledger_state(view.products(spark, d), events, view.LEDGER_ORDER)


#: Shelves that stand for products. One is hot from five sixths of their mean on, so most are, in a block or two each.
SHELVES = 200


def _hot(spark, d):
    return max(1, view.star(spark, d, "lineitem").count() * 5 // (6 * SHELVES))


def _shelves(spark, d):
    return view.products(spark, d).where(f"id < {SHELVES}")


@query
def ledger_hot_state(spark, d):
    """Many parts to a product, so that most products are hot."""
    events = view.grouped_events(spark, d, SHELVES, voids=False)
    return ledger.ledger_state(_shelves(spark, d), events, [*view.LEDGER_ORDER, "part"], _hot(spark, d))


@query
def ledger_hot_void(spark, d):
    events = view.grouped_events(spark, d, SHELVES)
    history = ledger.ledger_history(_shelves(spark, d), events, [*view.LEDGER_ORDER, "part"], _hot(spark, d), ["part", *_HISTORY])
    return history.select("part", *_HISTORY)


@query
def ledger_stored_void(spark, d):
    """Voids of sales that an earlier batch stored, with the shares on the stored rows."""
    stored = view.sales(spark, d).where("product_id IS NOT NULL")
    voids = stored.where("payment_method IS NULL").select(
        F.col("product_id"), F.lit("void").alias("kind"), F.col("id").alias("ref"),
        F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("member_n"),
        "order_id", "line_no", F.col("sold_at").alias("day"),
    )
    events = ledger.merge_events(ledger.resolve_voids(voids, stored))
    return ledger.ledger_state(
        view.products(spark, d), events, ["day", "order_id", "line_no", "ref"]
    )


#: Every batch comes twice, as a sender does that got no answer.
APPENDS = [*range(4), *range(4)]
FROM, TO = "1996-02-20", "1996-09-10"


@query
def ledger_append(spark, d):
    """All lines appended to stored ledgers in batches, each sent twice, and a range of days read back."""
    found = []
    for kind, rows, time, units in (
        ("sale", view.sales(spark, d), "sold_at", "quantity_sold"),
        ("restock", view.restocks(spark, d), "restocked_at", "quantity_added"),
    ):
        path = staging_path(spark, f"ledger-{kind}")
        for batch in APPENDS:
            part = rows.where(F.col("order_id") % len(set(APPENDS)) == batch)
            append_ledger.append_batch(part, path, f"orders-{batch}", time)
        stored = append_ledger.read_ledger(spark, path, rows.schema, time, FROM, TO)
        found.append(
            stored.select(F.lit(kind).alias("kind"), "id", "product_id", "member_id", F.col(units).alias("units"), F.col(time).alias("at"))
        )
    return found[0].unionByName(found[1])


@query
def ledger_append_batches(spark, d):
    """Rows that each batch added, after every batch was sent twice."""
    rows, path = view.sales(spark, d), staging_path(spark, "ledger-batches")
    for batch in APPENDS:
        append_ledger.append_batch(rows.where(F.col("order_id") % len(set(APPENDS)) == batch), path, f"orders-{batch}", "sold_at")
    return append_ledger.batches(spark, path)


@query
def ledger_running_qty(spark, d):
    events = view.ledger_events(spark, d, voids=False)
    running = ledger.running_quantity(view.products(spark, d), events, view.LEDGER_ORDER)
    return running.select("product_id", "day", "order_id", "line_no", "kind", "running_quantity")


def _request_events(spark, d, voids=None):
    return record.request_events(
        req.sale_requests(spark, d), req.restock_requests(spark, d), voids, F.lit(TODAY)
    )


def _voids(spark, d):
    """Voids of the batch's sales; the stored sales of a product's lines are those of line 3."""
    stored = view.sales(spark, d).where("line_no = 3")
    return record.checked_voids(req.void_requests(spark, d), req.sale_requests(spark, d).where("seq.line_no <> 3"), stored)


@query
def record_sales(spark, d):
    """Raw sale and restock requests to sale rows."""
    rows = record.recorded_sales(view.products(spark, d), _request_events(spark, d))
    return rows.withColumn("sold_at", F.to_date("sold_at"))


@query
def record_voids(spark, d):
    """The sale rows that are left after sales, restocks and voids: new ones and stored ones."""
    requests, voids = req.sale_requests(spark, d).where("seq.line_no <> 3"), _voids(spark, d)
    events = record.request_events(requests, req.restock_requests(spark, d), voids, F.lit(TODAY))
    shown = ["id", "product_id", "quantity_sold", "member_qty_sold"]
    new = record.recorded_sales(view.products(spark, d), events, columns=shown)
    left = record.without_voided(new, voids).select(*shown, F.lit("new").alias("origin"))
    stored = record.without_voided(view.sales(spark, d).where("line_no = 3"), voids)
    return left.unionByName(stored.select(*shown, F.lit("stored").alias("origin")))


@query
def record_void_products(spark, d):
    """The catalogue after the same batch."""
    requests = req.sale_requests(spark, d).where("seq.line_no <> 3")
    events = record.request_events(requests, req.restock_requests(spark, d), _voids(spark, d), F.lit(TODAY))
    return record.next_products(_dated_products(spark, d), events, now=F.lit(TODAY)).select(*_MOVED)


@query
def record_products(spark, d):
    """The catalogue after the same requests."""
    events = _request_events(spark, d)
    return record.next_products(_dated_products(spark, d), events, now=F.lit(TODAY)).select(*_MOVED)


_MOVED = ["id", "name", "quantity", "member_qty", "member_id", "cost_price", "stock", "updated_at"]


def _dated_products(spark, d):
    cost = F.col("cost_price").cast("double")
    return view.products(spark, d).withColumns({"cost_price": cost, "updated_at": F.col("created_at")})


# --- import slot and pages ----------------------------------------------------------------


@query
def import_slot(spark, d):
    return slot.poll_results(view.slot_events(spark, d), SLOT_TTL)


def _with_images(found):
    return found.withColumn("images", array_json(F.col("images")))


def _extracted(spark, d, variant):
    return checked_products(view.star(spark, d, "pages"), variant)


@query
def extract_products(spark, d):
    return _with_images(check.accepted(_extracted(spark, d, RENDERED)))


@query
def extract_products_static(spark, d):
    return _with_images(check.accepted(_extracted(spark, d, STATIC)))


@query
def extract_structured(spark, d):
    """Shop pages with structured data, fallbacks, galleries and breadcrumbs, as a browser shows them."""
    return _with_images(checked_products(req.shop_pages(spark, d), RENDERED))


@query
def extract_structured_static(spark, d):
    """The same pages as delivered."""
    return _with_images(checked_products(req.shop_pages(spark, d), STATIC))


@query
def extract_repeated_names(spark, d):
    """Structured data with repeated names, broken text and long values."""
    found = checked_products(req.block_pages(spark, d), RENDERED)
    return _with_images(found.select("page_id", "name", "price", "images"))


@query
def extract_broken_blocks(spark, d):
    """How many blocks of a page are no JSON."""
    broken = broken_blocks(req.block_pages(spark, d))
    return broken.where(F.col("reason").startswith("block ")).groupBy("page_id").agg(F.count("*").alias("blocks"))


@query
def extract_rejects(spark, d):
    """Archived pages and plain documents: only pages name a product."""
    pages = view.star(spark, d, "pages").select("page_id", "url", "html")
    texts = view.star(spark, d, "documents").selectExpr(
        "doc_id AS page_id", "source AS url", "text AS html"
    )
    return check.rejected(checked_products(pages.unionByName(texts), RENDERED)).select(
        "page_id", "source", "price", check.REASON
    )


# --- streams ------------------------------------------------------------------------------


#: Files of a micro-batch at most.
FILES = 1000


def _stream(spark, d, name):
    """A table as a stream, be it one file or a folder of part files.

    A stream takes a single file only by a pattern; this one matches the table's name alone.
    """
    files = spark.readStream.schema(view.star(spark, d, name).schema).options(basePath=d, maxFilesPerTrigger=FILES)
    return files.parquet(f"{d}/{name}.parque[t]")


#: Parts of the time line that arrive one after the other.
TURNS = 4


def _in_turns(spark, rows, time, name, run):
    """Runs a stream once for each part of ``rows`` in order of ``time``; every run goes on where the last ended."""
    at, path = F.unix_timestamp(F.col(time).cast("timestamp")), staging_path(spark, f"{name}-arrivals")
    held = stage(rows, f"{name}-rows")
    bounds = held.agg(F.percentile_approx(at, [k / TURNS for k in range(1, TURNS)])).first()[0] or [0] * (TURNS - 1)
    turn = sum((F.when(at > bound, 1).otherwise(0) for bound in bounds), F.lit(0))
    for k in range(TURNS):
        held.where(turn == k).write.mode("append").parquet(path)
        found = run(spark.readStream.schema(held.schema).option("maxFilesPerTrigger", FILES).parquet(path))
    return found


@query
def stream_ledger(spark, d):
    """Events as they arrive over time, in several micro-batches."""
    path = staging_path(spark, "ledger")
    run = lambda events: ledger_stream.stream_ledger(view.products(spark, d), events, view.LEDGER_ORDER, path=path)
    return _in_turns(spark, view.ledger_events(spark, d), "day", "ledger", run).select(*_HISTORY)


@query
def stream_extract(spark, d):
    """Pages extracted as they arrive."""
    found = check.accepted(checked_products(_stream(spark, d, "pages"), RENDERED))
    return _with_images(drain(found, "products"))


@query
def stream_slot(spark, d):
    path = staging_path(spark, "slot")
    run = lambda events: slot_stream.stream_slot(events, SLOT_TTL, path=path)
    return _in_turns(spark, view.slot_events(spark, d), "ts", "slot", run)


@query
def stream_totals(spark, d):
    lines = _stream(spark, d, "lineitem")
    rows = view.sales_of(lines, view.star(spark, d, "supplier").count() + 2)
    return drain_latest(totals_stream.stream_product_sales(rows), "product-sales", ["product_id"])


@query
def stream_expenses(spark, d):
    rows = view.expenses_of(_stream(spark, d, "orders"))
    return drain_latest(totals_stream.stream_expenses(rows), "expenses", ["category"])


@query
def stream_sales_totals(spark, d):
    lines = _stream(spark, d, "lineitem")
    rows = view.sales_of(lines, view.star(spark, d, "supplier").count() + 2)
    totals = totals_stream.stream_sales_totals(rows)
    return drain_latest(totals, "sales-totals", [])
