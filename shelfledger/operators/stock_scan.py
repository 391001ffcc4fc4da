"""The stock ledger as running compositions of small maps, in windows alone.

What an event does to a product's stock is a map of its state, and such maps
compose into maps of the same form, so running values need no walk over events:

* quantity: a sum that a sale keeps from falling below zero, the running net less
  its lowest value at a sale
* member quantity: ``min(m + added, cap)``; own units go first, so a sale leaves
  the member what the remaining quantity has room for
* unit cost: ``scale * c + offset``; a restock averages, or sets the cost where no
  stock or no cost was there. Maps of 1, 2, 4, ... events are composed by
  doubling, which never divides by a small product. The first ``STEPWISE`` costs of
  a product are averaged one after the other, to the last bit like in the fold.

All of it shares one sort by product and arrival. A hot product's blocks are
scanned from an open start, side by side; composing one map per block gives every
start, and no row is scanned again.

The forms hold for regular products, see :func:`irregular`. The others (a void
takes back a share that a member's sale left open, negative units, a member
quantity above the stock) are for the event-by-event fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.functions.stock import band_after_restock, zero_if_null
from shelfledger.operators.ordered import BLOCK, before_here, ordered_window, up_to_here
from shelfledger.session import stage

OPEN = "_open"
#: Costs of an ordinary product that are averaged one by one.
STEPWISE = 64
#: The running map of a row, from the start of its group.
_MAP = ["_added", "_cap", "_scale", "_offset"]


def _truthy(number: Column) -> Column:
    return F.coalesce(number != 0, F.lit(False))


def _kind(name: str) -> Column:
    return F.col("kind") == name


def _bad_cost(cost: Column) -> Column:
    return F.coalesce((cost < 0) | F.isnan(cost) | (cost == float("inf")), F.lit(False))


_ODD, _NAMED, _VOID, _LOOSE, _OWN = 1, 2, 4, 8, 16


def irregular() -> Column:
    """Aggregate over a product's events and its opening: whether only the fold fits it."""
    opened, flag = F.col(OPEN), lambda bit, holds: F.when(holds, bit).otherwise(0)
    n, member_n = zero_if_null(F.col("n")), zero_if_null(F.col("member_n"))
    added, own = F.least(member_n, n), _truthy(opened["current_member"])
    held, stock = zero_if_null(opened["member_qty"]), zero_if_null(opened["quantity"])
    opening = (
        flag(_ODD, (held < 0) | (stock < 0) | _bad_cost(opened["cost_price"]))
        + flag(_OWN | _NAMED, own)
        # More than there is matters to a member alone.
        + flag(_VOID, held > stock)
        + flag(_LOOSE, ~own & (held != 0))
    )
    restock = flag(_ODD, (n < 0) | (added < 0) | _bad_cost(F.col("unit_cost"))) + F.when(_truthy(F.col("member_id")), _NAMED).otherwise(
        flag(_LOOSE, added != 0)  # units of no member that one who comes later would find
    )
    other = flag(_ODD, (n < 0) | (member_n < 0)) + flag(_VOID, _kind("void"))
    marks = F.bit_or(F.when(_kind("open"), opening).when(_kind("restock"), restock).otherwise(other))
    has = lambda bit: marks.bitwiseAND(bit) != 0
    return has(_ODD) | (has(_NAMED) & (has(_VOID) | (has(_LOOSE) & ~has(_OWN))))


def _rounds(rows: int) -> int:
    """Doublings after which a map covers ``rows`` rows."""
    return max(1, rows).bit_length()


def _composed(rows: DataFrame, group: Sequence[str], order: Sequence[str], count: int) -> DataFrame:
    """Replaces each row's map of the cost by that of all rows of its group up to it."""
    window = ordered_window(list(group), list(order))
    scale, offset = F.col("_scale"), F.col("_offset")
    for k in range(_rounds(count)):
        earlier = [F.lag(c, 1 << k, d).over(window) for c, d in (("_scale", 1.0), ("_offset", 0.0))]
        rows = rows.withColumns({"_scale": scale * earlier[0], "_offset": scale * earlier[1] + offset})
    return rows


def running_maps(rows: DataFrame, group: Sequence[str], order: Sequence[str], count: int) -> DataFrame:
    """Adds to every row its quantity and the map from its group's start to it.

    A group of a known product has an opening row with the start's exact quantity
    and member, and in ``_priced`` whether it has a cost. ``count`` bounds the rows
    of a group; without one, maps of the cost stay those of single events.
    """
    group = list(group)
    line = [F.col("_later"), *[F.col(c) for c in order]]
    window = up_to_here(ordered_window(group, line))
    place = ordered_window(group, line)
    n = zero_if_null(F.col("n"))
    effective = _kind("void") & F.col("_takes").isNotNull()
    units = (
        F.when(_kind("open"), zero_if_null(F.col(OPEN)["quantity"])).when(_kind("sale"), -n)
        .when(_kind("void"), zero_if_null(F.col("_takes"))).otherwise(n)
    )
    added = F.when(_kind("restock"), F.least(zero_if_null(F.col("member_n")), n)).when(effective, zero_if_null(F.col("_share"))).otherwise(0)
    member = F.when(_kind("open"), F.col(OPEN)["current_member"]).when(_kind("restock"), F.col("member_id"))
    priced = _kind("restock") & _truthy(F.col("unit_cost"))
    first = rows.withColumn("_later", (~_kind("open")).cast("int")).withColumns(
        {
            "_net": F.sum(units).over(window),
            "_added": F.sum(added).over(window),
            "_who": F.first(F.nullif(member, F.lit(0)), ignorenulls=True).over(window),
            "_known": F.max(_kind("open")).over(window),
            "_nth": F.count_if(priced).over(window),
            "_costs": (F.count_if(priced).over(window) - priced.cast("int")) + F.max(F.coalesce("_priced", F.lit(False))).over(window).cast("int"),
            "_moved": F.max(_kind("sale") | _kind("restock") | effective).over(window),
        }
    )
    low = F.min(F.when(_kind("sale"), F.col("_net"))).over(window)
    counted = first.withColumn("_quantity", F.col("_net") - F.least(F.lit(0), low)).withColumns(
        {
            "_before": F.lag("_quantity").over(place),
            "_cap": F.min(
                F.when((_kind("sale") & F.col("_who").isNotNull()) | effective, F.col("_quantity") - F.col("_added"))
            ).over(window),
        }
    )
    reset = priced & ((F.col("_before") <= 0) | (F.col("_costs") == 0))
    mapped = counted.withColumns(
        {
            "_added0": F.lag("_added").over(place),
            "_cap0": F.lag("_cap").over(place),
            "_scale": F.when(reset, 0.0).when(priced, F.col("_before") / F.col("_quantity")).otherwise(1.0),
            "_offset": F.when(reset, F.col("unit_cost")).when(priced, n * F.col("unit_cost") / F.col("_quantity")).otherwise(0.0),
        }
    )
    return (_composed(mapped, group, line, count) if count else mapped).drop("_net", "_costs")


def after_start(start: Column) -> dict[str, Column]:
    """History columns of a row behind the running map of :func:`running_maps`.

    ``start`` has the member quantity, cost and band at the group's start.
    """
    known, sale, void = F.col("_known"), _kind("sale"), _kind("void")
    held = zero_if_null(start["member_qty"])
    member_qty = F.col("_added") + F.least(held, "_cap")
    before = zero_if_null(F.col("_added0")) + F.least(held, "_cap0")
    n, takes = zero_if_null(F.col("n")), F.col("_takes").isNotNull()
    left_over = F.greatest(F.lit(0), n - F.greatest(F.lit(0), F.col("_before") - before))
    sold = F.when(known & F.col("_who").isNotNull(), left_over).otherwise(F.lit(0)).cast("bigint")
    share = F.when(takes, zero_if_null(F.col("_share"))).otherwise(0).cast("bigint")
    cost = F.when(F.col("_scale") != 0, F.col("_scale") * start["cost_price"] + F.col("_offset")).otherwise(F.col("_offset"))
    cost = F.when(F.col("_nth") == 0, start["cost_price"]).when(F.col("_nth") <= STEPWISE, F.coalesce("_stepped", cost)).otherwise(cost)
    shown = lambda c: F.when(known, c)
    return {
        "member_sold": F.when(sale, sold).when(void, share),
        "owner_sold": F.when(sale, n - sold),
        "quantity": shown(F.col("_quantity")),
        "member_qty": shown(member_qty),
        "current_member": shown(F.col("_who")),
        "cost_price": shown(cost),
        "stock": shown(F.when(touched(start), band_after_restock(F.col("_quantity"))).otherwise(start["stock"])),
        "sold_out": F.when(sale, known & (F.col("_quantity") == 0)),
        "applied": ~void | takes,
    }


def touched(start: Column) -> Column:
    """Whether any event moved the product so far."""
    return F.col("_moved") | F.coalesce(start["moved"], F.lit(False))


def last_of(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of every group, by the sort that the scan has made."""
    place = ordered_window(list(group), [F.col("_later"), *[F.col(c) for c in order]])
    return rows.withColumn("_next", F.lead("_later").over(place)).where("_next IS NULL").drop("_next")


def scan_products(rows: DataFrame, order: Sequence[str], count: int, costs: int) -> DataFrame:
    """Running maps of whole products; the start of each is its opening, its first row.

    ``count`` bounds the rows of a product, ``costs`` the restocks with a cost.
    """
    opened = F.col(OPEN)
    priced = rows.withColumn("_priced", _kind("open") & _truthy(opened["cost_price"]))
    # Single maps still stand on the rows, from which the first costs are averaged in turn.
    maps = running_maps(priced, ["product_id"], order, 0)
    line = ["_later", *order]
    window = up_to_here(ordered_window("product_id", line))
    sets = _kind("restock") & _truthy(F.col("unit_cost")) & (F.col("_nth") <= STEPWISE)
    step = F.struct(
        (F.col("_scale") == 0).alias("reset"), F.col("_before").alias("before"), zero_if_null(F.col("n")).alias("n"),
        F.col("unit_cost").alias("cost"), F.col("_quantity").alias("quantity"),
    )
    maps = maps.withColumns({"_start": F.first(OPEN, ignorenulls=True).over(window), "_steps": F.collect_list(F.when(sets, step)).over(window)})

    def averaged(cost: Column, s: Column) -> Column:
        return F.when(s["reset"], s["cost"]).otherwise((s["before"] * cost + s["n"] * s["cost"]) / s["quantity"])

    here = F.when(sets, F.aggregate("_steps", F.col("_start")["cost_price"], averaged))
    maps = maps.withColumn("_here", here).withColumn("_stepped", F.last("_here", ignorenulls=True).over(window)).drop("_steps", "_here")
    if costs > STEPWISE:
        maps = _composed(maps, ["product_id"], line, count)
    return maps.withColumn("_start", F.col("_start").withField("moved", F.lit(False)))


def scan_blocks(blocks: DataFrame, starts: DataFrame, order: Sequence[str]) -> DataFrame:
    """Running maps of the blocks of hot products, with the composed start of each block.

    ``starts`` has, per block, the product's opening state with the quantity and the
    member in front of the block.
    """
    key = ["product_id", BLOCK]
    sets = _kind("restock") & _truthy(F.col("unit_cost"))
    moves = _kind("sale") | _kind("restock") | (_kind("void") & F.col("_takes").isNotNull())
    inside = blocks.groupBy(*key).agg(F.count("*").alias("_rows"), F.max(sets).alias("_sets"), F.max(moves).alias("_moves"))
    inside = stage(inside, "block-counts")
    largest = inside.agg(F.max("_rows")).first()[0]
    earlier = before_here(ordered_window("product_id", [BLOCK]))
    ahead = {
        "_priced": _truthy(F.col("cost_price")) | F.coalesce(F.max("_sets").over(earlier), F.lit(False)),
        "moved": F.coalesce(F.max("_moves").over(earlier), F.lit(False)),
    }
    placed = stage(starts.join(inside, key).withColumns(ahead), "block-starts")
    opening = F.struct("quantity", "member_qty", "current_member", "cost_price", "stock").alias(OPEN)
    opened = blocks.unionByName(placed.select(*key, F.lit("open").alias("kind"), opening, "_priced"), allowMissingColumns=True)
    maps = stage(running_maps(opened, key, order, (largest or 0) + 1), "block-maps")

    ends = last_of(maps, key, order).where("_known").select(*key, *_MAP)
    chained = placed.join(ends, key)
    blocks_of_one = stage(chained, "block-ends")
    most = blocks_of_one.groupBy("product_id").count().agg(F.max("count")).first()[0] or 0
    added = F.coalesce(F.sum("_added").over(earlier), F.lit(0))
    summed = blocks_of_one.withColumn("_added_before", added)
    cap = F.min(F.col("_cap") - F.col("_added_before")).over(earlier)
    capped = summed.withColumn("_cap_before", cap)
    composed = _composed(capped, ["product_id"], [F.col(BLOCK)], most)
    line = ordered_window("product_id", [BLOCK])
    scale, offset = (F.lag(c).over(line) for c in ("_scale", "_offset"))
    handed = composed.withColumns({"_scale1": F.coalesce(scale, F.lit(1.0)), "_offset1": F.coalesce(offset, F.lit(0.0))})
    cost = F.when(F.col("_scale1") != 0, F.col("_scale1") * F.col("cost_price") + F.col("_offset1")).otherwise(F.col("_offset1"))
    held = F.col("_added_before") + F.least(zero_if_null(F.col("member_qty")), "_cap_before")
    state = handed.select(*key, F.struct(held.alias("member_qty"), cost.alias("cost_price"), "stock", "moved").alias("_start"))
    return maps.join(state, key, "left").withColumn("_stepped", F.lit(None).cast("double"))
