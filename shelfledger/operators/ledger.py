"""The stock ledger: sales, restocks and voids applied per product in arrival order.

Events: ``product_id``, the order columns, ``kind`` (sale, restock, void),
``ref`` (the sale's id, or the id of the sale a void takes back), ``n`` units,
``member_id``/``member_n``/``unit_cost`` of a restock. A void of a sale from an
earlier batch carries that sale's ``n`` and ``member_n`` (see
:func:`resolve_voids`); a void of a sale in the same batch leaves ``n`` NULL.
Which voids take effect is settled by :func:`link_voids` before anything is
split, so products of any size follow the same rule. Unit costs are given out
at :data:`COST_STEP`.

The product's row joins its events as an opening event, so one shuffle on the
product brings together all that is needed, and products without events and
events without a product need no special case. Regular products are scanned by
windows (:mod:`stock_scan`); only the others are folded event by event.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from shelfledger.functions.stock_fold import Stock, TracedStock
from shelfledger.operators import stock_scan
from shelfledger.operators.ordered import (
    BLOCK,
    BROADCAST_KEYS,
    HOT_ROWS,
    Counts,
    before_here,
    block_window,
    cut_blocks,
    of_keys,
    ordered_window,
    split_counted,
    split_hot,
    up_to_here,
)
from shelfledger.schemas import FINAL, FOLDED, HISTORY, STOCK
from shelfledger.session import stage

_STATE_NAMES = STOCK.names
_FINAL_NAMES = FINAL.names
_BLOCK_KEY = ["product_id", BLOCK]
_OPEN = stock_scan.OPEN
_LINK = "_link"
# What a void takes back: the units, whether the member share is that of a sale
# in the same group, and the share otherwise.
_TAKEN = {"_takes": "bigint", "_borrows": "boolean", "_share": "bigint"}
_EVENT = ["kind", "ref", "n", "member_id", "member_n", "unit_cost"]
# An opening event goes to the fold in columns that it has no other use for.
_OPENS = {"quantity": "n", "member_qty": "member_n", "current_member": "member_id", "cost_price": "unit_cost", "stock": "ref"}
# The average cost depends on the order of its roundings below this step.
COST_STEP = 1e-6
_STEPPED_BELOW = 1e9
# One event in so many of a product that needs the fold, and all are folded: a
# second way beside it would cost more than it saves.
MOSTLY_FOLDED = 4
# One void in so many events, and all sales are shuffled to meet them.
MANY_VOIDS = 20


def restock_events(restocks: DataFrame) -> DataFrame:
    return restocks.withColumnsRenamed(
        {"quantity_added": "n", "cost_per_unit": "unit_cost", "member_qty": "member_n", "id": "ref"}
    ).withColumn("kind", F.lit("restock"))


def sale_events(sales: DataFrame) -> DataFrame:
    """Sales as events; the line's own cost is ``sale_cost`` beside the product's cost."""
    return (
        sales.withColumnsRenamed({"quantity_sold": "n", "id": "ref", "cost_price": "sale_cost"})
        .drop("member_id")
        .withColumn("kind", F.lit("sale"))
    )


def merge_events(*parts: DataFrame) -> DataFrame:
    """Sales, restocks and voids as one ledger."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


def resolve_voids(events: DataFrame, stored_sales: DataFrame) -> DataFrame:
    """Give voids of stored sales the units and the member share on the stored row.

    Other events pass by without a shuffle, and of the stored ledger only the
    voided sales go into the join.
    """
    void = F.col("kind") == "void"
    voids = events.where(void)
    stored = stored_sales.select(
        F.col("id").alias("ref"),
        F.coalesce("quantity_sold", F.lit(0)).alias("_n"),
        F.coalesce("member_qty_sold", F.lit(0)).alias("_member_n"),
    ).join(voids.select("ref"), "ref", "left_semi")
    resolved = voids.join(stored, "ref", "left").withColumns(
        {"n": F.coalesce("n", "_n"), "member_n": F.coalesce("member_n", "_member_n")}
    )
    return events.where(~void).unionByName(resolved.select(*events.columns))


def link_voids(typed: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds what each void takes back; NULL ``_takes`` for one without effect.

    Voids and sales meet by (product, ref), of the sales only those that a void
    names. After a sale its first void takes effect, with the sale's units;
    before any sale the first void that carries units does, with those. All
    later voids of the same sale, and voids that name no sale, have no effect.
    """
    linked = _linked(typed, order)
    rest = typed.where(~_named_void()).withColumns(_nothing())
    return rest.unionByName(linked.select(*rest.columns))


def _nothing() -> dict[str, Column]:
    return {name: F.lit(None).cast(kind) for name, kind in _TAKEN.items()}


def _named_void() -> Column:
    return F.coalesce((F.col("kind") == "void") & F.col("product_id").isNotNull() & F.col("ref").isNotNull(), F.lit(False))


def _linked(typed: DataFrame, order: Sequence[str], sale: Column | None = None, many: bool = False) -> DataFrame:
    """The voids that name a sale, with what they take back.

    ``_sale`` is what the column ``sale`` gives for the sale that a void comes after.
    With ``many`` voids all sales meet them in one shuffle, which costs less than to
    find those that are named first.
    """
    key, sold = ["product_id", "ref"], F.col("kind") == "sale"
    voids, sales = typed.where(_named_void()), typed.where(sold & F.col("product_id").isNotNull() & F.col("ref").isNotNull())
    if not many:
        sales = sales.join(voids.select(*key), key, "left_semi").select(*typed.columns)
    here = up_to_here(Window.partitionBy(*key).orderBy(*order))
    units = F.when(sold, F.coalesce("n", F.lit(0)))
    met = voids.unionByName(sales).withColumns(
        {
            "_sales": F.count(units).over(here),
            "_units": F.last(units, ignorenulls=True).over(here),
            "_sale": F.lit(None) if sale is None else F.last(F.when(sold, sale), ignorenulls=True).over(here),
        }
    )
    return _first_voids(met, here).where("kind = 'void'").withColumn("_borrows", F.coalesce("_borrows", F.lit(False)))


def _first_voids(met: DataFrame, here) -> DataFrame:
    """What the voids take back, of which only the first since the last sale takes effect.

    ``_sales`` and ``_units`` are of the sales up to a row by the window ``here``.
    """
    named, sold = _named_void(), F.col("kind") == "sale"
    usable = F.coalesce(named & ((F.col("_sales") > 0) | F.col("n").isNotNull()), F.lit(False))
    turns = met.withColumn("_turns", F.count_if(usable).over(here))
    spent = F.coalesce(F.last(F.when(sold, F.col("_turns")), ignorenulls=True).over(here), F.lit(0))
    first = turns.withColumn("_first", usable & (F.col("_turns") - spent == 1))
    return first.withColumns(
        {
            "_takes": F.when(F.col("_first"), F.coalesce("_units", "n")),
            "_borrows": F.when(named, F.col("_first") & (F.col("_sales") > 0)),
            "_share": F.when(F.col("_first") & (F.col("_sales") == 0), F.coalesce("member_n", F.lit(0))),
        }
    ).drop("_sales", "_units", "_turns", "_first")


def link_voids_here(dealt: DataFrame, order: Sequence[str]) -> DataFrame:
    """:func:`link_voids` for rows that are dealt by product already: no further shuffle."""
    here = up_to_here(Window.partitionBy("product_id", "ref").orderBy(*order))
    units = F.when(F.col("kind") == "sale", F.coalesce("n", F.lit(0)))
    met = dealt.withColumns({"_sales": F.count(units).over(here), "_units": F.last(units, ignorenulls=True).over(here)})
    return _first_voids(met, here)


def shown_cost(cost: Column) -> Column:
    """A unit cost at :data:`COST_STEP`; larger ones have no digits below it worth keeping."""
    stepped = F.floor(cost / COST_STEP + 0.5) * COST_STEP
    return F.when(F.abs(cost) < _STEPPED_BELOW, stepped).otherwise(cost)


def openings(products: DataFrame) -> DataFrame:
    cost = F.col("cost_price").cast("double")
    return products.select(
        F.col("id").alias("product_id"),
        F.lit("open").alias("kind"),
        F.struct(
            F.col("quantity").cast("bigint").alias("quantity"),
            F.col("member_qty").cast("bigint").alias("member_qty"),
            F.col("member_id").cast("bigint").alias("current_member"),
            cost.alias("cost_price"),
            F.col("stock").alias("stock"),
        ).alias(_OPEN),
    )


def _fold(rows: DataFrame, order: Sequence[str], keep: Sequence[str] | None) -> DataFrame:
    """Stream each sorted partition through the fold, one Arrow batch at a time.

    With the columns to ``keep`` every event comes back with its history, else the
    last state of each group. Only the columns that are read or kept go to Python.

    Rows of whole products come dealt by product, those of blocks are dealt here.
    No product's events are gathered in one place: the sort spills, and the fold
    holds one state and, for voids of the same batch, the shares of the sales.
    Products are hot beyond ``HOT_ROWS`` events, which bounds the latter.

    The fold of a whole product links its voids as it meets them, by the rule of
    :func:`link_voids`; voids of blocks come linked.
    """
    group = ["product_id", BLOCK] if BLOCK in rows.columns else ["product_id"]
    first = (F.col("kind") != "open").cast("int")
    dealt = rows.repartition(*group) if BLOCK in rows.columns else rows
    placed = dealt.sortWithinPartitions(*group, first, *order)
    opening = {to: F.when(F.col("kind") == "open", F.col(_OPEN)[of]).otherwise(F.col(to)).alias(to) for of, to in _OPENS.items()}
    read = lambda names: placed.select(*[opening.get(c, F.col(c)) for c in names])
    if keep is not None:
        kept = [*group, *[c for c in keep if c not in group]]
        schema = StructType([placed.schema[c] for c in kept] + HISTORY.fields)
        sent = read([*kept, *[c for c in _inputs(group) if c not in kept]])
        return sent.mapInArrow(_history_of(group, kept), schema).where("kind <> 'open'")
    schema = StructType([placed.schema[c] for c in group] + FOLDED.fields)
    return read(_read_columns(group)).mapInArrow(_state_of(group), schema)


def _inputs(group: list[str]) -> list[str]:
    """Columns of an event that the fold reads; those of blocks say what a void takes back."""
    return [*_EVENT, *(_TAKEN if BLOCK in group else [])]


def _read_columns(group: list[str]) -> list[str]:
    """Columns the fold reads; blocks also mark linked sales."""
    return [*group, *_inputs(group), *([_LINK] if BLOCK in group else [])]


class _Walk:
    """Applies events of blocks, whose voids are linked, to the stock of the current block."""

    def __init__(self, make_stock):
        self.make_stock = make_stock
        self.enter(object())

    def enter(self, group):
        self.group = group
        self.stock = self.make_stock()
        self.shares = {}

    def apply(self, kind, ref, n, member_id, member_n, unit_cost, takes, borrows, share):
        """Member units moved and whether the event took effect."""
        stock = self.stock
        if kind == "sale":
            sold = self.shares[ref] = stock.sell(n or 0)
            return sold, True
        if kind == "restock":
            stock.restock(n or 0, member_n or 0, member_id, unit_cost)
            return 0, True
        if kind == "void":
            if takes is None:
                return 0, False
            if borrows:
                share = self.shares.get(ref, 0)
                stock.hangs_on_start()
            stock.void(takes, share)
            return share, True
        # See _OPENS.
        stock.open(n, member_n, member_id, unit_cost, ref)
        return 0, True


class _LinkingWalk(_Walk):
    """Applies events of whole products and finds what each void takes back.

    ``shares`` holds the units and the member share of each sale that stands, None
    for one that was taken back.
    """

    def apply(self, kind, ref, n, member_id, member_n, unit_cost):
        stock = self.stock
        if kind == "sale":
            units = n or 0
            sold = stock.sell(units)
            self.shares[ref] = (units, sold)
            return sold, True
        if kind == "restock":
            stock.restock(n or 0, member_n or 0, member_id, unit_cost)
            return 0, True
        if kind == "void":
            # Before any sale the first void that carries units takes effect.
            taken = None if ref is None else self.shares.get(ref, None if n is None else (n, member_n or 0))
            if taken is None:
                return 0, False
            self.shares[ref] = None
            stock.void(*taken)
            return taken[1], True
        # See _OPENS.
        stock.open(n, member_n, member_id, unit_cost, ref)
        return 0, True


def _walk(group: list[str], make_stock) -> _Walk:
    return (_Walk if BLOCK in group else _LinkingWalk)(make_stock)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _rows(batch: pa.RecordBatch, names: list[str]):
    return zip(*[_values(_column(batch, name)) for name in names])


def _values(column: pa.Array) -> list:
    """The values as Python objects, None for NULL; the way over arrays is several times faster."""
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_floating(column.type):
        values = column.to_numpy(zero_copy_only=False)
        if column.null_count:
            values = values.astype(object)
            values[column.is_null().to_numpy(zero_copy_only=False)] = None
        return values.tolist()
    return column.to_pandas(integer_object_nulls=True, deduplicate_objects=False).tolist()


def _history_of(group: list[str], kept: list[str]):
    inputs = _inputs(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _walk(group, Stock)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.bool_()]
        for batch in batches:
            columns = [[] for _ in types]
            to_moved, to_quantity, to_held, to_member, to_cost, to_band, to_applied = [c.append for c in columns]
            for key, event in zip(_rows(batch, group), _rows(batch, inputs)):
                if key != walk.group:
                    walk.enter(key)
                    stock, apply = walk.stock, walk.apply
                moved, applied = apply(*event)
                known = stock.known
                to_moved(moved)
                to_quantity(stock.quantity if known else None)
                to_held(stock.member_qty if known else None)
                to_member(stock.member_id)
                to_cost(stock.cost)
                to_band(stock.stock)
                to_applied(applied)
            moved, quantity, *state, applied = [pa.array(c, t) for c, t in zip(columns, types)]
            kind = _column(batch, "kind")
            sale, none = pc.equal(kind, "sale"), pa.scalar(None, pa.int64())
            computed = {
                "member_sold": pc.if_else(pc.or_(sale, pc.equal(kind, "void")), moved, none),
                "owner_sold": pc.if_else(sale, pc.subtract(pc.fill_null(_column(batch, "n"), 0), moved), none),
                "quantity": quantity,
                **dict(zip(["member_qty", "current_member", "cost_price", "stock"], state)),
                "sold_out": pc.if_else(sale, pc.fill_null(pc.equal(quantity, 0), False), pa.scalar(None, pa.bool_())),
                "applied": applied,
            }
            passed = [_column(batch, name) for name in kept]
            yield pa.RecordBatch.from_arrays(passed + [computed[c] for c in HISTORY.names], names=kept + HISTORY.names)

    return run


def _state_of(group: list[str]):
    width, inputs = len(group), _inputs(group)
    types = [pa.int64(), pa.int32()][:width] + [
        pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(),
        pa.bool_(), pa.bool_(), pa.float64(), pa.float64(), pa.string(), pa.int64(),
    ]
    no_state = (None,) * len(FINAL)

    def final(walk: _Walk) -> tuple:
        s = walk.stock
        state = (s.quantity, s.member_qty, s.member_id, s.cost, s.stock)
        traced = (s.known, s.added, s.cap, s.exact, s.touched, s.scale, s.offset)
        return (*walk.group, *state, *traced, None, None)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(types)
        arrays = [pa.array(column, t) for column, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays(arrays, names=[*group, *FOLDED.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, started = _walk(group, TracedStock), False
        for batch in batches:
            done = []
            links = _values(_column(batch, _LINK)) if width == 2 else [None] * len(batch)
            for key, event, link in zip(_rows(batch, group), _rows(batch, inputs), links):
                if key != walk.group:
                    if started:
                        done.append(final(walk))
                    walk.enter(key)
                    apply, started = walk.apply, True
                moved, _ = apply(*event)
                if link and event[0] == "sale":
                    walk.stock.hangs_on_start()
                    done.append((*walk.group, *no_state, link, moved))
            yield table(done)
        if started:
            yield table([final(walk)])

    return run


def typed_events(events: DataFrame) -> DataFrame:
    """The columns the fold reads, in their types; other columns pass through."""
    types = {
        "product_id": "bigint", "kind": "string", "ref": "string", "n": "bigint",
        "member_id": "bigint", "member_n": "bigint", "unit_cost": "double",
    }
    passed = [c for c in events.columns if c not in types]
    read = [
        (F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c)
        for c, t in types.items()
    ]
    return events.select(*read, *passed)


class _Side(NamedTuple):
    """Events and openings of ordinary products, dealt by product; events and openings of hot ones.

    Voids of hot products are not linked yet; ``voids`` bounds their number.
    """

    cold: DataFrame
    hot: DataFrame | None
    hot_opened: DataFrame | None
    hot_rows: int
    voids: int


class _Parts(NamedTuple):
    """Typed events, and those of regular products and of those that are folded.

    ``largest`` bounds the rows, and the restocks with a cost, of an ordinary product.
    """

    typed: DataFrame
    regular: _Side | None
    folded: _Side | None
    largest: tuple[int, int]


def _split(products: DataFrame, events: DataFrame, order: Sequence[str], hot_rows: int, states: bool = False) -> _Parts:
    """Events with their voids linked, dealt by what can be done with their product.

    For ``states`` alone hot products are folded: a block then gives one row, which the
    fold finds in one walk, where windows would carry maps along on every row.
    """
    typed, opened = typed_events(events), openings(products)
    if states:
        typed = typed.select(*dict.fromkeys(["product_id", *_EVENT, *order]))
    owned = typed.where(F.col("product_id").isNotNull())
    read = ["product_id", "kind", "n", "member_id", "member_n", "unit_cost"]
    every = opened.unionByName(owned.select(*read), allowMissingColumns=True)
    event = F.col("kind") != "open"
    counted = every.groupBy(F.col("product_id").alias("_key")).agg(
        F.count_if(event).alias("_rows"),
        F.count_if(F.col("kind") == "void").alias("_voids"),
        F.count_if((F.col("kind") == "restock") & (F.col("unit_cost") != 0)).alias("_costs"),
        (stock_scan.irregular() | (F.count_if(~event) > 1)).alias("_folded"),
    )
    counted = stage(counted, "key-counts")
    hot = F.col("_rows") > hot_rows
    folded = F.col("_folded") | (hot & F.lit(states))
    void = lambda of: F.sum(F.when(of, F.col("_voids")))
    totals = counted.agg(
        F.count_if(hot & ~folded), F.sum(F.when(hot & ~folded, F.col("_rows"))), void(~folded),
        F.count_if(hot & folded), F.sum(F.when(hot & folded, F.col("_rows"))), void(folded),
        F.count_if(folded), F.max(F.when(~hot, F.col("_rows"))),
        F.sum("_rows"), F.sum(F.when(folded, F.col("_rows"))), F.max(F.when(~hot, F.col("_costs"))),
    ).first()
    totals = [x or 0 for x in totals]
    regular, to_fold, (n_folded, rows, n_rows, n_to_fold, costs) = totals[:3], totals[3:6], totals[6:]
    largest = (rows + 1, costs)
    if states and not regular[2] + to_fold[2]:
        # Only voids ask which sale they name.
        typed = typed.withColumn("ref", F.lit(None).cast("string"))
        owned = typed.where(F.col("product_id").isNotNull())

    def split(rows: DataFrame, opened: DataFrame, wanted: Column, n_hot: int, n_rows: int, voids: int, scan: bool = False) -> _Side:
        parted = split_counted(rows, "product_id", Counts(counted.where(hot & wanted).select("_key"), n_hot, n_rows))
        # A shuffle on the product serves the links of voids and the scan; the fold links them itself.
        dealt = parted.cold.unionByName(parted.cold_of(opened, "product_id"), allowMissingColumns=True).repartition("product_id")
        cold = link_voids_here(dealt, order) if voids and scan else dealt.withColumns(_nothing())
        if parted.hot is None:
            return _Side(cold, None, None, 0, 0)
        return _Side(cold, parted.hot, parted.hot_of(opened, "product_id"), n_rows, voids)

    if not n_folded:
        return _Parts(typed, split(owned, opened, ~folded, *regular, scan=True), None, largest)
    if n_to_fold * MOSTLY_FOLDED > n_rows:
        every = [a + b for a, b in zip(regular, to_fold, strict=True)]
        return _Parts(typed, None, split(owned, opened, F.lit(True), *every), largest)
    odd = of_keys(Counts(counted.where(folded).select("_key"), n_folded, 0))
    both = [[odd(rows, "product_id", how) for rows in (owned, opened)] for how in ("left_anti", "left_semi")]
    return _Parts(typed, split(*both[0], ~folded, *regular, scan=True), split(*both[1], folded, *to_fold), largest)


def _scanned(parts: _Parts, order: Sequence[str]) -> DataFrame:
    """Running maps of the ordinary regular products, each with the start it follows."""
    return stock_scan.scan_products(parts.regular.cold, order, *parts.largest)


def _scanned_blocks(parts: _Parts, order: Sequence[str], hot_rows: int) -> DataFrame:
    """The same for the blocks of hot products."""
    side = parts.regular
    linked = link_voids(side.hot, order) if side.voids else side.hot.withColumns(_nothing())
    blocks = cut_blocks(linked, side.hot_rows, "product_id", order, hot_rows)
    starts = _first_starts(blocks, side.hot_opened, order, guess=False)
    return stock_scan.scan_blocks(blocks, starts, order)


def ledger_state(
    products: DataFrame, events: DataFrame, order: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """State of every product after its events."""
    return _final_states(products, events, order, hot_rows).where("known").drop("known", "touched")


def changed_products(
    products: DataFrame, events: DataFrame, order: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """State of the products that an event moved."""
    moved = _final_states(products, events, order, hot_rows).where("known AND touched")
    return moved.drop("known", "touched")


def _final_states(products: DataFrame, events: DataFrame, order: Sequence[str], hot_rows: int) -> DataFrame:
    parts = _split(products, events, order, hot_rows, states=True)
    names = [*_STATE_NAMES, "known", "touched"]
    start = F.col("_start")

    def states(maps: DataFrame) -> DataFrame:
        shown = maps.withColumns(stock_scan.after_start(start))
        return shown.withColumns({"known": F.col("_known"), "touched": stock_scan.touched(start)})

    found = []
    if parts.regular is not None:
        found.append(states(stock_scan.last_of(_scanned(parts, order), ["product_id"], order)))
    if parts.folded is not None:
        found.append(_folded_states(parts, order, hot_rows))
    return _union(found, ["product_id", *names]).select(
        "product_id",
        "quantity",
        "member_qty",
        F.col("current_member").alias("member_id"),
        shown_cost(F.col("cost_price")).alias("cost_price"),
        "stock",
        "known",
        "touched",
    )


def _folded_states(parts: _Parts, order: Sequence[str], hot_rows: int) -> DataFrame:
    names = [*_STATE_NAMES, "known", "touched"]
    final = _fold(parts.folded.cold, order, None).select("product_id", *names)
    if parts.folded.hot is None:
        return final
    _, settled = _settle_blocks(parts.folded, order, hot_rows, ends=True)
    touched = F.bool_or("_end.touched").alias("touched")
    last = settled.groupBy("product_id").agg(F.max_by("_end", BLOCK).alias("_last"), touched)
    kept = [F.col("_last")[c].alias(c) for c in names[:-1]]
    return final.unionByName(last.select("product_id", *kept, "touched"))


def ledger_history(
    products: DataFrame, events: DataFrame, order: Sequence[str], hot_rows: int = HOT_ROWS, keep: Sequence[str] | None = None
) -> DataFrame:
    """Every event with its member and own units and the product's state after it.

    The state is NULL for an event whose product is unknown or NULL. ``keep`` names
    the events' columns that are wanted, by default all; the others stay out of the fold.
    """
    history = raw_history(products, events, order, hot_rows, keep)
    return history.withColumn("cost_price", shown_cost(F.col("cost_price")))


def raw_history(
    products: DataFrame, events: DataFrame, order: Sequence[str], hot_rows: int = HOT_ROWS, keep: Sequence[str] | None = None
) -> DataFrame:
    """The same with unit costs as they were carried on."""
    parts = _split(products, events, order, hot_rows)
    kept = [c for c in parts.typed.columns if keep is None or c in {"product_id", "kind", *keep}]
    names = kept + HISTORY.names
    moved = stock_scan.after_start(F.col("_start"))
    found = [loose_history(parts.typed)]
    if parts.regular is not None:
        maps = [_scanned(parts, order)]
        if parts.regular.hot is not None:
            maps.append(_scanned_blocks(parts, order, hot_rows))
        found += [m.where("kind <> 'open'").withColumns(moved) for m in maps]
    if parts.folded is not None:
        found.append(_fold(parts.folded.cold, order, kept))
        if parts.folded.hot is not None:
            blocks, settled = _settle_blocks(parts.folded, order, hot_rows, ends=False)
            found.append(_fold(_started(blocks, settled), order, kept))
    return _union(found, names)


def _union(frames: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select(*names) for f in frames])


def loose_history(typed: DataFrame) -> DataFrame:
    """Events without a product: they move no stock and need no shuffle."""
    sale = F.col("kind") == "sale"
    known = {
        "member_sold": F.when(sale, F.lit(0).cast("bigint")),
        "owner_sold": F.when(sale, F.col("n")),
        "sold_out": F.when(sale, F.lit(False)),
        "applied": F.col("kind") != "void",
    }
    return typed.where(F.col("product_id").isNull()).withColumns(
        {f.name: known.get(f.name, F.lit(None).cast(f.dataType)) for f in HISTORY.fields}
    )


# --- hot products -----------------------------------------------------------------


def _started(blocks: DataFrame, starts: DataFrame) -> DataFrame:
    opening = F.struct(*_STATE_NAMES).alias(_OPEN)
    opened = starts.select("product_id", BLOCK, F.lit("open").alias("kind"), opening)
    return blocks.unionByName(opened, allowMissingColumns=True)


def _settle_blocks(side: _Side, order: Sequence[str], hot_rows: int, ends: bool) -> tuple[DataFrame, DataFrame]:
    """Blocks of the hot products, and the state each block starts and, with ``ends``, ends in.

    Quantity and member are exact at once, from block totals. Member quantity
    and cost start from a guess, and all blocks are folded side by side. The
    fold also finds how a block's end hangs on its start: the member quantity
    as ``min(start + added, cap)``, the cost as ``scale * start + offset``. One
    walk over these, a small row per block, gives every start; no block is
    folded again for a wrong guess. Only a block that takes back sales folds
    again when its start or a share from another block has changed, since a
    share is no such function; that is repeated until nothing changes. Without
    ``ends`` a product's last block is not folded here, for nothing hangs on it.
    """
    cut = cut_blocks(side.hot, side.hot_rows, "product_id", order, hot_rows)
    blocks, crossing = _link_blocks(cut, order, side.voids * MANY_VOIDS > side.hot_rows) if side.voids else (cut.withColumns({**_nothing(), _LINK: F.lit(None).cast("string")}), None)
    starts = stage(_first_starts(blocks, side.hot_opened, order), "starts")
    inner = None if ends else stage(_but_last(starts), "inner")
    shares = stale = results = found = None
    while True:
        todo, only = _started(_with_shares(blocks, shares), starts), inner if stale is None else stale
        if only is not None:
            todo = todo.join(only, _BLOCK_KEY, "left_semi")
        folded = stage(_fold(todo, order, None), "folded")
        if stale is not None:
            kept = results.join(stale, _BLOCK_KEY, "left_anti")
            folded = stage(kept.unionByName(folded), "folded")
        results = folded
        settled = stage(_hand_over(starts, results.where(F.col(_LINK).isNull())), "settled")
        wrong = settled.where("_again").select(*_BLOCK_KEY)
        if crossing is not None:
            found = stage(_shares_of(results), "shares")
            wrong = wrong.union(_with_wrong_share(crossing, found, shares)).distinct()
        if inner is not None:
            wrong = wrong.join(inner, _BLOCK_KEY, "left_semi")
        stale = stage(wrong, "stale")
        if stale.isEmpty():
            return _with_shares(blocks, found), settled
        # Starts of the blocks that stay are those they were folded from.
        starts = _next_starts(starts, settled, stale)
        if crossing is not None:
            shares = found


def _but_last(starts: DataFrame) -> DataFrame:
    """The blocks that another block of their product follows."""
    last = F.max(BLOCK).over(Window.partitionBy("product_id"))
    return starts.withColumn("_last", last).where(F.col(BLOCK) < F.col("_last")).select(*_BLOCK_KEY)


def _next_starts(starts: DataFrame, settled: DataFrame, stale: DataFrame) -> DataFrame:
    kept = starts.join(stale, _BLOCK_KEY, "left_anti")
    again = settled.join(stale, _BLOCK_KEY, "left_semi").select(*starts.columns)
    return stage(kept.unionByName(again), "starts")


def _shares_of(results: DataFrame) -> DataFrame:
    taken = results.where(F.col(_LINK).isNotNull())
    return taken.select("product_id", _LINK, F.col("member_sold").alias("_found"))


def _with_wrong_share(crossing: DataFrame, found: DataFrame, used: DataFrame | None) -> DataFrame:
    """Blocks with a void whose share is not the one it was folded with."""
    key, before = ["product_id", _LINK], F.lit(0)
    joined = crossing.join(found, key, "left")
    if used is not None:
        joined = joined.join(used.withColumnRenamed("_found", "_used"), key, "left")
        before = F.coalesce("_used", F.lit(0))
    return joined.where(F.coalesce("_found", F.lit(0)) != before).select(*_BLOCK_KEY).distinct()


def _link_blocks(blocks: DataFrame, order: Sequence[str], many: bool) -> tuple[DataFrame, DataFrame | None]:
    """:func:`link_voids` for blocks, which names the sales whose void lies in another block, on both rows.

    The second result is the product, link and block of those voids, or None
    without any. Sales and voids meet under (product, ref), which spreads a hot
    product.
    """
    place = F.struct(*order)
    met = _linked(blocks, order, F.struct(place.alias("at"), F.col(BLOCK).alias("block")), many)
    away = F.col("_borrows") & (F.col("_sale.block") != F.col(BLOCK))
    link = F.when(away, F.to_json(F.struct("ref", "_sale.at"))).alias(_LINK)
    own = (F.col("_borrows") & ~F.coalesce(away, F.lit(False))).alias("_borrows")
    taken = ["_takes", own, "_share", link, F.col("_sale.at").alias("_at")]
    voids = stage(met.select(*blocks.columns, *taken), "linked-voids")
    apart = voids.where(F.col(_LINK).isNotNull())
    count = apart.count()
    names = [*blocks.columns, *_TAKEN, _LINK]
    rest = blocks.where(~_named_void()).withColumns(_nothing())
    if not count:
        return rest.withColumn(_LINK, F.lit(None).cast("string")).unionByName(voids.select(*names)), None
    # Like the keys of hot products, in one piece to every task unless they are very many.
    marks = apart.select("product_id", "ref", F.col("_at").alias("_place"), _LINK)
    marks = F.broadcast(marks) if count <= BROADCAST_KEYS else marks
    sale = F.col("kind") == "sale"
    marked = rest.withColumn("_place", F.when(sale, place)).join(marks, ["product_id", "ref", "_place"], "left")
    linked = stage(marked.select(*names).unionByName(voids.select(*names)), "linked")
    return linked, apart.select("product_id", _LINK, BLOCK)


def _linked_void() -> Column:
    return F.col(_LINK).isNotNull() & (F.col("kind") == "void")


def _with_shares(blocks: DataFrame, shares: DataFrame | None) -> DataFrame:
    """Put the member units found for a sale on its void in another block; other rows pass by the join."""
    if shares is None:
        return blocks.withColumn("_share", F.when(_linked_void(), F.lit(0)).otherwise(F.col("_share")))
    joined = blocks.where(_linked_void()).join(shares, ["product_id", _LINK], "left")
    found = joined.withColumn("_share", F.coalesce("_found", F.lit(0)).cast("bigint")).select(*blocks.columns)
    return blocks.where(~_linked_void()).unionByName(found)


def _signed_units():
    """Units that an event adds; a void adds what it takes back."""
    units = F.coalesce("n", F.lit(0))
    return (
        F.when(F.col("kind") == "sale", -units)
        .when(F.col("kind") == "void", F.coalesce("_takes", F.lit(0)))
        .otherwise(units)
    )


def _block_totals(blocks: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per block: net units, the lowest running net at a sale, the first member."""
    window = up_to_here(block_window("product_id", order))
    running = blocks.withColumn("_net", F.sum(_signed_units()).over(window))
    member = F.when((F.col("kind") == "restock") & (F.col("member_id") != 0), F.col("member_id"))
    first_at = F.when(member.isNotNull(), F.struct(*order))
    return running.groupBy("product_id", BLOCK).agg(
        F.sum(_signed_units()).alias("_units"),
        F.min(F.when(F.col("kind") == "sale", F.col("_net"))).alias("_low"),
        F.min_by(member, first_at).alias("_member"),
    )


def _quantity_before(totals: DataFrame, opened: DataFrame) -> DataFrame:
    """Net units, lowest running net and exact quantity in front of each block.

    A sale never takes the quantity below zero, so the quantity is the running
    net less its lowest value at a sale so far, if that is negative.
    """
    opening = opened.select("product_id", F.col(_OPEN).alias("_first"))
    earlier = before_here(ordered_window("product_id", [BLOCK]))
    base = F.coalesce(F.col("_first.quantity"), F.lit(0))
    net = base + F.coalesce(F.sum("_units").over(earlier), F.lit(0))
    placed = totals.join(opening, "product_id").withColumn("_net_before", net)
    low = F.min(F.col("_net_before") + F.col("_low")).over(earlier)
    return placed.withColumn("_low_before", F.least(F.lit(0), low)).withColumn(
        "_quantity_before", F.col("_net_before") - F.col("_low_before")
    )


def _first_starts(blocks: DataFrame, opened: DataFrame, order: Sequence[str], guess: bool = True) -> DataFrame:
    """Opening state per block with the quantity and the member in front of it.

    The member quantity is the opening's, as a ``guess`` cut down to the quantity.
    """
    placed = _quantity_before(_block_totals(blocks, order), opened)
    earlier = before_here(ordered_window("product_id", [BLOCK]))
    given = F.nullif(F.col("_first.current_member"), F.lit(0))
    member = F.coalesce(given, F.first("_member", ignorenulls=True).over(earlier))
    share = F.coalesce(F.col("_first.member_qty"), F.lit(0))
    position = F.row_number().over(ordered_window("product_id", [BLOCK]))
    return placed.select(
        "product_id",
        BLOCK,
        F.col("_quantity_before").alias("quantity"),
        F.when((position == 1) | F.lit(not guess), share)
        .otherwise(F.least(share, F.col("_quantity_before")))
        .alias("member_qty"),
        member.alias("current_member"),
        F.col("_first.cost_price").alias("cost_price"),
        F.col("_first.stock").alias("stock"),
    )


def _hand_over(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Start and end of every block, one small row per block, walked in order within a product.

    ``_again`` marks a block whose end its map does not give for this start. A last
    block may come without an end.
    """
    end = ends.select("product_id", BLOCK, F.struct(*_FINAL_NAMES).alias("_end"))
    rows = starts.join(end, ["product_id", BLOCK], "left").select(
        "product_id", BLOCK, *_STATE_NAMES, "_end"
    )
    again = StructField("_again", BooleanType())
    schema, names = StructType([*rows.schema.fields, again]), rows.columns

    def walk(group: pa.Table) -> pa.Table:
        carried, out = None, []
        for row in group.sort_by(BLOCK).to_pylist():
            used = {name: row[name] for name in _STATE_NAMES}
            # Quantity and member of the first guess are exact.
            start = used if carried is None else {**used, **carried}
            end, again = row["_end"], False
            if end is not None:
                end, again = _expected_end(end, used, start)
            out.append({**row, **start, "_end": end, "_again": again})
            if end is None:
                break
            carried = {name: end[name] for name in ("member_qty", "cost_price", "stock")}
        fields = [group.schema.field(name) for name in names]
        return pa.Table.from_pylist(out, schema=pa.schema([*fields, ("_again", pa.bool_())]))

    return rows.groupBy("product_id").applyInArrow(walk, schema)


def _expected_end(end: dict, used: dict, start: dict) -> tuple[dict, bool]:
    """End of a block folded from ``used`` for the start it really has, and whether to fold again."""
    expected, again = dict(end), False
    if start["member_qty"] != used["member_qty"]:
        normal = 0 <= start["member_qty"] <= start["quantity"]
        again = not (end["exact"] and normal)
        expected["member_qty"] = min(start["member_qty"] + end["added"], end["cap"])
    if start["cost_price"] != used["cost_price"]:
        untouched = end["scale"] == 1.0 and end["offset"] == 0.0
        # A product without a cost takes the next one whole instead of averaging.
        again = again or (end["scale"] != 0.0 and not untouched and not (start["cost_price"] and used["cost_price"]))
        again = again or (end["scale"] == 0.0 and bool(start["cost_price"]) != bool(used["cost_price"]))
        if untouched:
            expected["cost_price"] = start["cost_price"]
        elif end["scale"]:
            expected["cost_price"] = end["scale"] * (start["cost_price"] or 0.0) + end["offset"]
    if not end["touched"]:
        expected["stock"] = start["stock"]
    return expected, again


# --- running quantity -------------------------------------------------------------


def running_quantity(
    products: DataFrame, events: DataFrame, order: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Quantity after each event, by windows alone; NULL for an unknown product.

    Voids count with the units they carry.
    """
    carried = F.when(F.col("kind") == "void", F.col("n"))
    typed = typed_events(events).withColumn("_takes", carried)
    split = split_hot(typed, "product_id", hot_rows)
    opened = openings(products)
    names = [*[c for c in typed.columns if c != "_takes"], "running_quantity"]
    is_open = F.col("kind") == "open"
    units = F.when(is_open, F.coalesce(F.col(f"{_OPEN}.quantity"), F.lit(0))).otherwise(
        _signed_units()
    )
    rows = split.cold.unionByName(
        split.cold_of(opened, "product_id"), allowMissingColumns=True
    ).withColumn("_later", (~is_open).cast("int"))
    window = up_to_here(ordered_window("product_id", ["_later", *order]))
    running = rows.withColumns(
        {"_net": F.sum(units).over(window), "_known": F.max(is_open).over(window)}
    ).withColumn("_low", F.min(F.when(F.col("kind") == "sale", F.col("_net"))).over(window))
    quantity = F.col("_net") - F.least(F.lit(0), F.col("_low"))
    shown = F.when(F.col("_known"), quantity).alias("running_quantity")
    result = running.where(~is_open).select(*names[:-1], shown)
    if split.hot is None:
        return result
    blocks = cut_blocks(split.hot, split.hot_rows, "product_id", order, hot_rows)
    hot_openings = split.hot_of(opened, "product_id")
    before = _quantity_before(_block_totals(blocks, order), hot_openings)
    inside = up_to_here(block_window("product_id", order))
    local = blocks.withColumn("_net", F.sum(_signed_units()).over(inside)).withColumn(
        "_low", F.min(F.when(F.col("kind") == "sale", F.col("_net"))).over(inside)
    )
    joined = local.join(
        before.select("product_id", BLOCK, "_net_before", "_low_before"),
        ["product_id", BLOCK],
        "left",
    )
    net = F.col("_net_before") + F.col("_net")
    low = F.least(F.col("_low_before"), F.col("_net_before") + F.col("_low"))
    completed = joined.withColumn("running_quantity", net - low)
    return result.unionByName(completed.select(*names))
