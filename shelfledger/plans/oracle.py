"""The same queries as SQL, for checking against another engine."""

from __future__ import annotations

START, END = "1996-01-01", "1998-12-31"

_KEYS = "((SELECT count(*) FROM supplier) + 2)"
_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE))"

MEMBERS = "members AS (SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS phone FROM supplier)"

PRODUCTS = f"""products AS (SELECT p_partkey AS id, p_name AS name,
  CASE WHEN p_type IN ('ECONOMY','MEDIUM') THEN 'Flooring' WHEN p_type IN ('PROMO','SMALL') THEN 'Vanity'
       WHEN p_type = 'LARGE' THEN 'Tools' ELSE 'Other' END AS category,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS subcategory,
  concat(p_name, ' ', p_type) AS description, p_retailprice AS price,
  CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS featured, p_size % 5 AS sort_order,
  CAST(p_size - 1 AS BIGINT) AS quantity,
  CASE WHEN p_size - 1 = 0 THEN 'out_stock' WHEN p_size - 1 <= 5 THEN 'low_stock' ELSE 'in_stock' END AS stock,
  CASE WHEN p_partkey % 7 = 0 THEN NULL
       ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(0.6 AS DECIMAL(3,2)) AS DECIMAL(16,4)) END AS cost_price,
  CASE WHEN p_partkey % 3 = 0 THEN p_partkey % {_KEYS} END AS member_id,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(FLOOR((p_size - 1) / 3.0) AS BIGINT)
       WHEN p_partkey % 3 = 1 THEN CAST(0 AS BIGINT) END AS member_qty,
  CAST('2024-01-01' AS DATE) + p_size AS created_at
FROM part)"""

SALES = f"""raw_sales AS (SELECT {_ID} AS id, l_orderkey AS order_id, l_linenumber AS line_no,
  CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_partkey END AS product_id,
  concat('Part ', CAST(l_partkey AS VARCHAR)) AS product_name,
  CAST(l_quantity AS BIGINT) AS quantity_sold, CAST(l_extendedprice AS DECIMAL(12,2)) AS sale_price,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))
       AS DECIMAL(16,4)) AS cost_price,
  CASE WHEN l_linestatus = 'F' THEN 'Cash' END AS payment_method,
  CASE WHEN l_tax > 0 THEN concat('tax ', l_returnflag) END AS notes,
  CASE WHEN l_partkey % 3 = 0 THEN l_partkey % {_KEYS} END AS member_id,
  CASE WHEN l_partkey % 3 = 0 THEN CAST(FLOOR(l_quantity / 4.0) AS BIGINT) END AS member_qty_sold,
  l_shipdate AS sold_at
FROM lineitem WHERE l_returnflag <> 'R'),
sales AS (SELECT *, CAST((sale_price - cost_price) * quantity_sold AS DECIMAL(24,4)) AS profit FROM raw_sales)"""

RESTOCKS = f"""restocks AS (SELECT {_ID} AS id, l_orderkey AS order_id, l_linenumber AS line_no,
  l_partkey AS product_id, concat('Part ', CAST(l_partkey AS VARCHAR)) AS product_name,
  CAST(l_quantity AS BIGINT) AS quantity_added,
  CASE WHEN l_suppkey % 5 <> 0 THEN l_extendedprice END AS cost_per_unit, l_shipdate AS restocked_at,
  CASE WHEN l_partkey % 4 = 0 THEN l_partkey % {_KEYS} END AS member_id,
  CASE WHEN l_partkey % 4 = 0 THEN CAST(FLOOR(l_quantity / 2.0) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS member_qty
FROM lineitem WHERE l_returnflag = 'R')"""

EXPENSES = """expenses AS (SELECT o_orderkey AS id, o_orderpriority AS category,
  CAST(o_totalprice AS DECIMAL(14,2)) AS amount, CAST(o_orderdate AS DATE) AS expense_date
FROM orders)"""

SETTINGS = """settings AS (SELECT key, value FROM (SELECT CAST(user_id AS VARCHAR) AS key, props AS value,
  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1)"""

_MONEY = "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR)"
_UNITS = "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)"

SALE_REQUESTS = f"""requests AS (SELECT {_ID} AS id,
  CASE WHEN l_suppkey % 13 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS product_id,
  l_suppkey % 2 = 0 AS id_is_number,
  CASE WHEN l_linenumber = 7 THEN '' ELSE concat('Part ', CAST(l_partkey AS VARCHAR)) END AS product_name,
  CASE WHEN l_linenumber = 6 AND l_suppkey % 17 = 0 THEN '99999999999999999999'
    WHEN l_linenumber = 1 THEN concat(' ', {_UNITS}, ' pcs') WHEN l_linenumber = 2 THEN '0'
    WHEN l_linenumber = 3 THEN concat({_UNITS}, '.7') WHEN l_linenumber = 4 THEN 'many' ELSE {_UNITS} END AS quantity_sold,
  l_linenumber = 2 AND l_suppkey % 3 = 0 AS quantity_is_number,
  CASE WHEN l_linenumber = 4 AND l_suppkey % 19 = 1 THEN '20000000000.125'
    WHEN l_linenumber = 4 AND l_suppkey % 19 = 2 THEN '1e40' WHEN l_linenumber = 5 THEN '' WHEN l_returnflag = 'R' THEN NULL
    WHEN l_linenumber = 6 THEN concat({_MONEY}, ' USD') ELSE {_MONEY} END AS sale_price,
  CASE WHEN l_linestatus = 'F' THEN {_MONEY} END AS cost_price,
  CASE WHEN l_tax > 0 THEN 'taxed' ELSE '' END AS notes,
  CASE WHEN l_linestatus = 'F' THEN 'Cash' END AS payment_method,
  CASE WHEN l_linenumber = 1 THEN '' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS sold_at
FROM lineitem)"""

RESTOCK_REQUESTS = f"""restock_requests AS (SELECT {_ID} AS id,
  CASE WHEN l_suppkey % 13 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS product_id,
  CASE WHEN l_linenumber <> 7 THEN concat('Part ', CAST(l_partkey AS VARCHAR)) END AS product_name,
  l_suppkey % 2 = 0 AS id_is_number, l_linenumber = 2 AND l_suppkey % 3 = 0 AS quantity_is_number,
  CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN '0' WHEN 3 THEN concat('-', {_UNITS}) ELSE {_UNITS} END AS quantity_added,
  CASE WHEN l_linestatus = 'F' THEN {_MONEY} ELSE '0' END AS cost_per_unit,
  CASE WHEN l_tax > 0 THEN 'taxed' ELSE '' END AS notes,
  CASE WHEN l_linenumber = 4 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS member_id,
  CASE WHEN l_linenumber = 5 THEN 'all' ELSE '12' END AS member_qty,
  CASE WHEN l_linenumber = 6 THEN '' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS restocked_at
FROM lineitem)"""

EXPENSE_REQUESTS = """expense_requests AS (SELECT -1 - o_orderkey AS id,
  CASE WHEN o_orderpriority LIKE '1%' THEN '' ELSE o_orderpriority END AS category,
  CASE WHEN o_orderpriority LIKE '2%' THEN '' WHEN o_orderpriority LIKE '3%' THEN '0'
    WHEN o_custkey % 50 = 1 THEN '-1e99'
    ELSE CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) END AS amount, o_custkey % 2 = 0 AS amount_is_number,
  CASE WHEN o_orderpriority LIKE '4%' THEN 'Card' END AS payment_method,
  CASE WHEN o_orderpriority LIKE '5%' THEN '' ELSE o_orderstatus END AS notes,
  CASE WHEN o_orderpriority LIKE '4%' THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS expense_date
FROM orders)"""

PRODUCT_REQUESTS = """product_requests AS (SELECT p_partkey AS id, seq,
  CASE WHEN p_brand = 'Brand#1' THEN '' ELSE concat(upper(p_name), ' ', CAST(seq AS VARCHAR)) END AS name,
  CASE WHEN p_type = 'LARGE' THEN '' ELSE p_type END AS category,
  CASE WHEN seq = 2 THEN '' ELSE p_brand END AS subcategory,
  CASE WHEN p_size > 25 THEN p_name END AS description,
  CASE WHEN p_size > 40 THEN NULL ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) END AS price,
  CASE WHEN p_size > 30 THEN 'box' ELSE 'each' END AS price_unit,
  concat('SKU-', CAST(p_partkey AS VARCHAR)) AS sku,
  CASE WHEN p_size < 6 THEN 'low_stock' ELSE 'in_stock' END AS stock,
  CASE WHEN p_size > 25 THEN concat('["http://img/', CAST(p_partkey AS VARCHAR), '"]') ELSE '[]' END AS images,
  CASE WHEN p_size > 15 THEN 1 ELSE 0 END AS featured, p_size % 5 AS sort_order,
  CASE WHEN p_size > 35 THEN CAST(p_size AS BIGINT) WHEN p_size > 30 THEN CAST(31 AS BIGINT)
    ELSE CAST(p_size AS BIGINT) END AS quantity,
  CASE WHEN p_size > 25 THEN CAST(3 AS BIGINT) END AS member_id,
  CASE WHEN p_size > 25 THEN CAST(2 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS member_qty
FROM part, (VALUES (CAST(1 AS BIGINT)), (CAST(2 AS BIGINT))) s(seq))"""

SALE_EDITS = f"""edits AS (SELECT {_ID} AS id, seq,
  CASE WHEN seq = 2 THEN CASE WHEN l_linenumber = 4 THEN NULL WHEN l_linenumber = 5 THEN CAST(1e12 AS DOUBLE)
      ELSE CAST(99.5 AS DOUBLE) END
    ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) END AS new_price,
  seq = 2 AND l_linenumber = 7 AS too_large,
  CASE WHEN seq = 1 AND l_linenumber = 5 THEN 'Check' END AS new_payment,
  CASE WHEN seq = 2 AND l_linenumber = 6 THEN '' WHEN l_linenumber <> 1
    THEN concat('edit ', CAST(seq AS VARCHAR)) END AS new_notes
FROM lineitem, (VALUES (1), (2)) s(seq)
WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND (seq = 1 OR l_linenumber > 3))"""

MEMBER_REQUESTS = """member_requests AS (SELECT c_custkey AS id,
  CASE WHEN c_nationkey = 3 THEN '' ELSE c_name END AS name,
  CASE WHEN c_nationkey > 10 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS phone,
  CAST(NULL AS VARCHAR) AS notes FROM customer)"""


def _leading_int(text: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract({text}, '^\\s*([+-]?\\d+)', 1), '') AS BIGINT)"


def _leading_float(text: str) -> str:
    pattern = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"
    return f"TRY_CAST(NULLIF(regexp_extract({text}, '{pattern}', 1), '') AS DOUBLE)"


_SALE_COMPLETE = """product_name <> '' AND quantity_sold <> '' AND NOT (quantity_is_number AND quantity_sold = '0')
  AND sale_price IS NOT NULL"""
_SALE_FITS = "quantity_sold NOT LIKE '99999999999999999999%' AND coalesce(sale_price, '') <> '1e40'"
_SALE_OK = f"({_SALE_COMPLETE}) AND {_SALE_FITS}"
_PRODUCT_ID = """CASE WHEN product_id <> '' AND NOT (id_is_number AND product_id = '0')
  THEN CAST(product_id AS BIGINT) END"""
_RESTOCK_OK = """product_id <> '' AND NOT (id_is_number AND product_id = '0')
  AND quantity_added <> '' AND NOT (quantity_is_number AND quantity_added = '0')"""
_EXPENSE_GIVEN = "amount <> '' AND NOT (amount_is_number AND amount = '0')"
_TODAY = "DATE '2002-01-01'"


def _with(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


def _sum(measure: str, name: str, kind: str = "DOUBLE") -> str:
    return f"CAST(COALESCE(SUM({measure}), 0) AS {kind}) AS {name}"


_SALE_RANGE = f"CAST(sold_at AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'"
_EXPENSE_RANGE = f"expense_date BETWEEN DATE '{START}' AND DATE '{END}'"
_PRODUCT_SALES = f"""SELECT product_id, {_sum('quantity_sold', 'units_sold', 'BIGINT')},
  {_sum('sale_price * quantity_sold', 'revenue')}, {_sum('cost_price * quantity_sold', 'cogs')},
  {_sum('profit', 'profit')}, COUNT(*) AS transactions
FROM sales WHERE product_id IS NOT NULL GROUP BY product_id"""

_CATALOG = "SELECT p.*, m.name AS member_name FROM products p LEFT JOIN members m ON p.member_id = m.id WHERE "


def _search(term: str) -> str:
    return " OR ".join(
        f"lower(coalesce(p.{c}, '')) LIKE '%{term}%'" for c in ("name", "description", "subcategory")
    )


def _pl_parts(ranged: bool) -> str:
    where = f"WHERE {_SALE_RANGE}" if ranged else ""
    spent = f"WHERE {_EXPENSE_RANGE}" if ranged else ""
    return f"""s AS (SELECT COALESCE(SUM(sale_price * quantity_sold), 0) AS revenue,
  COALESCE(SUM(cost_price * quantity_sold), 0) AS total_cogs, COALESCE(SUM(profit), 0) AS stored_profit,
  COUNT(*) AS transactions, COALESCE(SUM(cost_price * COALESCE(member_qty_sold, 0)), 0) AS member_cogs
FROM sales {where}),
ever AS (SELECT COALESCE(SUM(cost_price * (quantity_sold - COALESCE(member_qty_sold, 0))), 0) AS own FROM sales),
e AS (SELECT COALESCE(SUM(amount), 0) AS spent FROM expenses {spent}),
inv AS (SELECT COALESCE(SUM((quantity - COALESCE(member_qty, 0)) * COALESCE(cost_price, 0)), 0) AS own,
  COALESCE(SUM(quantity * COALESCE(cost_price, 0)), 0) AS every FROM products WHERE quantity > 0),
pl AS (SELECT CAST(revenue AS DOUBLE) AS revenue, CAST(total_cogs - member_cogs AS DOUBLE) AS cogs,
  CAST(member_cogs AS DOUBLE) AS member_cogs,
  CAST(revenue - (total_cogs - member_cogs) AS DOUBLE) AS gross_profit,
  CAST(stored_profit AS DOUBLE) AS stored_profit, transactions, CAST(spent AS DOUBLE) AS total_expenses,
  CAST(revenue - (total_cogs - member_cogs) - spent AS DOUBLE) AS net_profit,
  CAST(inv.own AS DOUBLE) AS inventory_value, CAST(inv.every AS DOUBLE) AS inventory_value_all,
  CAST(ever.own + inv.own AS DOUBLE) AS total_invested FROM s, ever, e, inv)"""


_TOP = f"""SELECT product_id, product_name, CAST(SUM(quantity_sold) AS BIGINT) AS units,
  CAST(SUM(sale_price * quantity_sold) AS DOUBLE) AS revenue, CAST(SUM(profit) AS DOUBLE) AS profit
FROM sales WHERE {_SALE_RANGE} GROUP BY product_id, product_name
ORDER BY revenue DESC, product_name, product_id NULLS FIRST LIMIT 5"""

_RECENT = f"""SELECT s.id, s.product_name, s.quantity_sold, s.sale_price, s.profit, s.payment_method, s.notes,
  s.sold_at, s.member_id, m.name AS member_name FROM sales s LEFT JOIN members m ON s.member_id = m.id
WHERE {_SALE_RANGE} ORDER BY s.sold_at DESC, s.id DESC LIMIT 200"""

_PRODUCT_PL = f"""SELECT p.id AS product_id, COALESCE(units_sold, 0) AS units_sold, COALESCE(revenue, 0) AS revenue,
  COALESCE(cogs, 0) AS cogs, COALESCE(profit, 0) AS gross_profit, COALESCE(transactions, 0) AS transactions,
  CAST(COALESCE(quantity, 0) * COALESCE(cost_price, 0) AS DOUBLE) AS inventory_value,
  CAST(0 AS DOUBLE) AS margin_pct_ref,
  CASE WHEN COALESCE(cogs, 0) > 0 THEN COALESCE(profit, 0) / cogs * 100 ELSE CAST(0 AS DOUBLE) END AS margin_pct
FROM products p LEFT JOIN stats ON stats.product_id = p.id"""

_TABLE = """base AS (SELECT id, name, category, subcategory, description, price, stock,
  featured, sort_order, quantity, CAST(cost_price AS DOUBLE) AS cost_price, member_id, member_qty, created_at,
  created_at AS updated_at FROM products)"""

_LAST_REQUEST = """last AS (SELECT * FROM product_requests r WHERE name <> '' AND seq = 2)"""


def _line_events(voids: bool) -> str:
    day = "CAST(l_shipdate AS DATE)"
    void_rows = f"""UNION ALL SELECT l_partkey, {day} + 30, l_orderkey, l_linenumber, 1, 'void',
  concat_ws('-', l_orderkey, l_linenumber, {day}), NULL, NULL, NULL, NULL
FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'O'"""
    return f"""happened AS (SELECT l_partkey AS product_id, {day} AS day, l_orderkey AS order_id, l_linenumber AS line_no,
  0 AS kind_rank, CASE WHEN l_returnflag = 'R' THEN 'restock' ELSE 'sale' END AS kind,
  concat_ws('-', l_orderkey, l_linenumber, {day}) AS ref, CAST(l_quantity AS BIGINT) AS n,
  CASE WHEN l_returnflag = 'R' AND l_partkey % 4 = 0 THEN l_partkey % {_KEYS} END AS who,
  CASE WHEN l_returnflag = 'R' AND l_partkey % 4 = 0 THEN CAST(FLOOR(l_quantity / 2.0) AS BIGINT) END AS member_n,
  CASE WHEN l_returnflag = 'R' AND l_suppkey % 5 <> 0 THEN l_extendedprice END AS unit_cost
FROM lineitem {void_rows if voids else ""})"""


_PLACED = f"""{SALE_REQUESTS}, {RESTOCK_REQUESTS},
placed_lines AS (SELECT {_ID} AS id, CAST(l_shipdate AS DATE) AS day, l_orderkey AS order_id, l_linenumber AS line_no,
  l_returnflag = 'A' AND l_linestatus = 'O' AS voided FROM lineitem)"""

# Sales of line 3 are stored, the others arrive with their batch.
_VOIDS = f"""{_PLACED}, {SALES},
tried AS (SELECT p.*, rank, concat('void-', CAST(rank AS VARCHAR), '-', id) AS void_id
FROM placed_lines p, (VALUES (2), (3)) r(rank) WHERE voided AND (rank = 2 OR line_no = 2)),
voids AS (SELECT t.*, CASE WHEN line_no = 3 THEN s.product_id ELSE r.pid END AS product_id,
  CASE WHEN line_no = 3 THEN s.quantity_sold END AS n, CASE WHEN line_no = 3 THEN COALESCE(s.member_qty_sold, 0) END AS member_n,
  rank = 2 AND line_no <> 5 AND (line_no = 3 OR r.id IS NOT NULL) AS valid
FROM tried t LEFT JOIN (SELECT id, {_PRODUCT_ID} AS pid FROM requests WHERE {_SALE_OK}) r ON r.id = t.id
LEFT JOIN (SELECT id, product_id, quantity_sold, member_qty_sold FROM sales) s ON s.id = t.id)"""


def _request_events(voids: bool) -> str:
    happened = f"""happened AS (SELECT {_PRODUCT_ID} AS product_id, day, order_id, line_no, 0 AS kind_rank,
  'sale' AS kind, id AS ref, COALESCE(NULLIF({_leading_int('quantity_sold')}, 0), 1) AS n, CAST(NULL AS BIGINT) AS who,
  CAST(NULL AS BIGINT) AS member_n, CAST(NULL AS DOUBLE) AS unit_cost
FROM requests JOIN placed_lines USING (id)
WHERE {_SALE_OK} {"AND line_no <> 3" if voids else ""}
UNION ALL SELECT CAST(product_id AS BIGINT), day, order_id, line_no, 1, 'restock', id,
  COALESCE({_leading_int('quantity_added')}, 0), CASE WHEN member_id <> '' THEN {_leading_int('member_id')} END,
  COALESCE({_leading_int('member_qty')}, 0), {_leading_float('cost_per_unit')}
FROM restock_requests JOIN placed_lines USING (id) WHERE {_RESTOCK_OK}
{"UNION ALL SELECT product_id, day + 30, order_id, line_no, 2, 'void', id, n, NULL, member_n, NULL FROM voids WHERE valid" if voids else ""})"""
    return f"{_VOIDS if voids else _PLACED},\n{happened}"


_REQUEST_EVENTS, _VOID_EVENTS = _request_events(False), _request_events(True)


def _ledger(happened: str) -> str:
    """Event-by-event walk; a void finds its sale's share by position."""
    return f"""WITH RECURSIVE {PRODUCTS},
{happened},
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY day, order_id, line_no, kind_rank) AS pos
FROM happened),
ev AS (SELECT v.product_id, v.day, v.order_id, v.line_no, v.kind, v.ref, v.pos, COALESCE(v.n, s.n) AS n, v.who,
  v.member_n, v.unit_cost, s.pos AS sale_pos FROM placed v LEFT JOIN placed s
  ON v.kind = 'void' AND s.kind = 'sale' AND s.product_id = v.product_id AND s.ref = v.ref),
walk AS (
SELECT id AS product_id, CAST(0 AS BIGINT) AS pos, quantity AS q, COALESCE(member_qty, 0) AS m,
  NULLIF(member_id, 0) AS who, CAST(cost_price AS DOUBLE) AS c, stock, CAST(0 AS BIGINT) AS moved,
  CAST([] AS BIGINT[]) AS shares FROM products
UNION ALL
SELECT product_id, pos, nq,
  CASE kind WHEN 'sale' THEN GREATEST(0, m - moved) WHEN 'restock' THEN m + LEAST(COALESCE(member_n, 0), n)
    ELSE LEAST(nq, m + moved) END,
  COALESCE(who, CASE WHEN kind = 'restock' THEN NULLIF(new_who, 0) END),
  CASE WHEN kind <> 'restock' OR COALESCE(unit_cost, 0) = 0 THEN c
    WHEN q > 0 AND COALESCE(c, 0) <> 0
    THEN CASE WHEN nq <> 0 THEN ((q * c) + (n * unit_cost)) / nq END ELSE unit_cost END,
  CASE WHEN nq = 0 OR (kind = 'restock' AND nq < 0) THEN 'out_stock' WHEN nq <= 5 THEN 'low_stock' ELSE 'in_stock' END,
  moved, list_append(shares, moved)
FROM (SELECT e.product_id, e.pos, e.kind, e.n, e.member_n, e.unit_cost, e.who AS new_who, w.q, w.m, w.who, w.c, w.shares,
  CASE e.kind WHEN 'sale' THEN GREATEST(0, w.q - e.n) ELSE w.q + e.n END AS nq,
  CASE WHEN e.kind = 'sale' AND w.who IS NOT NULL THEN GREATEST(0, e.n - LEAST(e.n, GREATEST(0, w.q - w.m)))
    WHEN e.kind = 'void' THEN COALESCE(w.shares[e.sale_pos], e.member_n, 0) ELSE 0 END AS moved
  FROM walk w JOIN ev e ON e.product_id = w.product_id AND e.pos = w.pos + 1) step)
"""


_LINES, _LINES_AND_VOIDS = _line_events(False), _line_events(True)


def _shelf_ledger(voids: bool) -> str:
    """The lines of many parts as events of one of 200 products."""
    grouped = _line_events(voids).replace("l_partkey AS product_id", "l_partkey % 200 AS product_id, l_partkey AS part", 1)
    grouped = grouped.replace("SELECT l_partkey, CAST", "SELECT l_partkey % 200, l_partkey, CAST")
    day = "CAST(l_shipdate AS DATE)"
    grouped = grouped.replace(f"l_linenumber, {day})", f"l_linenumber, {day}, l_partkey)")
    walked = _ledger(grouped).replace("line_no, kind_rank) AS pos", "line_no, kind_rank, part) AS pos")
    return walked.replace("SELECT v.product_id, v.day", "SELECT v.part, v.product_id, v.day")

def _shown(cost: str) -> str:
    return f"CASE WHEN abs({cost}) < 1e9 THEN floor({cost} / 1e-6 + 0.5) * 1e-6 ELSE {cost} END"


_HISTORY = f"""SELECT e.product_id, e.day, e.order_id, e.line_no, e.kind,
  CASE WHEN e.kind <> 'restock' THEN w.moved END AS member_sold,
  CASE WHEN e.kind = 'sale' THEN e.n - w.moved END AS owner_sold,
  w.q AS quantity, w.m AS member_qty, w.who AS current_member, {_shown('w.c')} AS cost_price, w.stock,
  CASE WHEN e.kind = 'sale' THEN w.q = 0 END AS sold_out
FROM ev e JOIN walk w ON w.product_id = e.product_id AND w.pos = e.pos"""

_STATE = f"""SELECT product_id, q AS quantity, m AS member_qty, who AS member_id, {_shown('c')} AS cost_price, stock
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY pos DESC) AS back FROM walk) x WHERE back = 1"""

_NEXT_PRODUCTS = f""", state AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY pos DESC) AS back FROM walk)
SELECT p.id, p.name, CASE WHEN pos > 0 THEN q ELSE p.quantity END AS quantity,
  CASE WHEN pos > 0 THEN m ELSE p.member_qty END AS member_qty, CASE WHEN pos > 0 THEN who ELSE p.member_id END AS member_id,
  CASE WHEN pos > 0 THEN {_shown('c')} ELSE CAST(p.cost_price AS DOUBLE) END AS cost_price,
  CASE WHEN pos > 0 THEN s.stock ELSE p.stock END AS stock,
  CASE WHEN pos > 0 THEN {_TODAY} ELSE p.created_at END AS updated_at
FROM products p JOIN state s ON s.product_id = p.id AND back = 1"""

_SLOT = """SELECT user_id AS session, event_id AS seq, ts,
  CASE WHEN before_type = 'signup' AND ts - before_ts < INTERVAL '43200' SECOND THEN CAST(before_id AS VARCHAR) END AS payload
FROM (SELECT *, LAG(event_type) OVER w AS before_type, LAG(ts) OVER w AS before_ts, LAG(event_id) OVER w AS before_id
      FROM events WHERE event_type IN ('signup', 'purchase')
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) x WHERE event_type = 'purchase'"""

_HEADING = "replace(replace(replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_EXTRACT = f"""SELECT page_id, url, 'Other' AS source, trim(regexp_replace({_HEADING}, '\\s+', ' ', 'g')) AS name,
  CAST({{description}} AS VARCHAR) AS description, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS VARCHAR) AS category,
  '[]' AS images
FROM pages WHERE html LIKE '%<h1%'"""



def _shop(rendered: bool) -> str:
    """What each of the ten kinds of shop page says, from the columns that it was made from."""
    lists = {
        0: """'["http://img/' || p_partkey || '.png"]'""", 1: """'["http://a/1","http://a/2","http://a/3","4","5","6"]'""",
        4: """'["http://og/' || p_partkey || '"]'""",
    }
    name = {0: "p_name || ' big'", 4: "p_name || ' | Shop'", 5: "p_name || ' new'", 8: "''"}
    text = {0: "p_name || ' here'", 2: "'d'", 3: "'a page'", 4: "'og text'"}
    price = {0: "CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE)", 1: "12.5", 2: "1299.0", 4: "1234.0"}
    if rendered:
        six = ",".join(f'"http://c/{i}"' for i in range(6))
        lists |= {5: """'["http://g/1","http://g/2"]'""", 9: f"'[{six}]'"}
        name |= {4: "p_name", 8: "NULL"}
        text[3] = "'a  page'"
        price[5] = "45.5"
        del price[4]
    else:
        text |= {i: "''" for i in (1, 5, 6, 7, 8, 9)}

    def pick(values: dict, other: str) -> str:
        return "CASE p_partkey % 10 " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + f" ELSE {other} END"

    return f"""SELECT p_partkey AS page_id, 'https://' || host || '/p/' || p_partkey AS url, source,
  {pick(name, "p_name")} AS name, {pick(text, "NULL")} AS description, CAST({pick(price, "NULL")} AS DOUBLE) AS price,
  CASE WHEN p_partkey % 10 = 6 THEN CASE p_size % 3 WHEN 0 THEN 'Other' WHEN 1 THEN 'Flooring' ELSE 'Vanity' END END AS category,
  {pick(lists, "'[]'")} AS images,
  CASE WHEN p_partkey % 10 = 8 THEN 'Could not extract product info from this page.' END AS reject_reason
FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'www.homedepot.com' WHEN 1 THEN 'www.lowes.com' ELSE 'example.org' END AS host,
  CASE p_partkey % 3 WHEN 0 THEN 'Home Depot' WHEN 1 THEN 'Lowe''s' ELSE 'Other' END AS source FROM part) p"""


ORACLE: dict[str, str] = {
    "catalog_search": _with(PRODUCTS, MEMBERS) + _CATALOG + f"({_search('ring')})",
    "catalog_category": _with(PRODUCTS, MEMBERS)
    + _CATALOG
    + "p.category = 'Flooring' AND p.stock = 'in_stock'",
    "catalog_featured": _with(PRODUCTS, MEMBERS) + _CATALOG + f"p.featured = 1 AND ({_search('bl_e')})",
    "product_lookup": _with(PRODUCTS, RESTOCKS)
    + "SELECT * FROM products WHERE id IN (SELECT product_id FROM restocks WHERE member_qty > 0)",
    "categories": _with(PRODUCTS)
    + "SELECT DISTINCT category, 1 AS section FROM products UNION ALL SELECT 'All', 0",
    "settings_object": _with(SETTINGS) + "SELECT key, value FROM settings WHERE key <> 'employee_password'",
    "settings_map": _with(SETTINGS) + "SELECT key, value FROM settings WHERE key <> 'employee_password'",
    "settings_defaults": _with(SETTINGS)
    + "SELECT key, value FROM settings UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name FROM part "
    "WHERE CAST(p_partkey AS VARCHAR) NOT IN (SELECT key FROM settings)",
    "settings_fallback": _with(SETTINGS)
    + "SELECT '7' AS key, COALESCE((SELECT NULLIF(value, '') FROM settings WHERE key = '7'), 'none') AS value "
    "UNION ALL SELECT 'business_name', COALESCE((SELECT NULLIF(value, '') FROM settings "
    "WHERE key = 'business_name'), 'Your Business Name')",
    "settings_upsert": """SELECT key, value FROM (SELECT CAST(user_id AS VARCHAR) AS key, props AS value,
  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END,
    CASE WHEN event_type = 'signup' THEN ts END DESC, event_id DESC) AS rn
  FROM events) x WHERE rn = 1""",
    "sales_by_product": _with(SALES) + _PRODUCT_SALES,
    "sales_by_product_map": _with(SALES)
    + f"SELECT CAST(product_id AS VARCHAR) AS key, units_sold, revenue, cogs, transactions, profit FROM ({_PRODUCT_SALES}) x",
    "sales_page": _with(SALES) + "SELECT * FROM sales ORDER BY sold_at DESC NULLS LAST, id DESC NULLS LAST LIMIT 500 OFFSET 1000",
    "sales_ledger": _with(SALES) + "SELECT * FROM sales",
    "ledger_by_product": _with(SALES) + "SELECT * FROM sales WHERE product_id = 17",
    "ledger_of_product_zero": _with(SALES, RESTOCKS)
    + "SELECT id, product_id, sold_at FROM sales WHERE product_id = 0 "
    "UNION ALL SELECT id, product_id, restocked_at FROM restocks WHERE product_id = 0",
    "restock_history": _with(RESTOCKS) + "SELECT * FROM restocks",
    "sales_json": _with(SALES)
    + "SELECT * EXCLUDE (sale_price, cost_price, sold_at, profit), CAST(sold_at AS DATE) AS sold_at, "
    "CAST(profit AS DOUBLE) AS profit FROM sales",
    "product_rows": "SELECT COUNT(*) AS n FROM part",
    "product_pl_summary": _with(PRODUCTS, SALES, f"stats AS ({_PRODUCT_SALES})") + _PRODUCT_PL,
    "product_pl_doc": _with(
        PRODUCTS, SALES, RESTOCKS, f"stats AS ({_PRODUCT_SALES})", f"summary AS ({_PRODUCT_PL})"
    )
    + """SELECT product_id, 'summary' AS section, CAST(NULL AS TIMESTAMP) AS happened_at, units_sold AS units,
  gross_profit AS profit, inventory_value AS cost, CAST(NULL AS VARCHAR) AS id, revenue, cogs, transactions, margin_pct,
  CAST(NULL AS VARCHAR) AS product_name, CAST(NULL AS VARCHAR) AS payment_method, CAST(NULL AS VARCHAR) AS notes,
  CAST(NULL AS BIGINT) AS member_id, CAST(NULL AS DOUBLE) AS sale_price, CAST(NULL AS BIGINT) AS member_units FROM summary
UNION ALL SELECT product_id, 'sale', sold_at, quantity_sold, CAST(profit AS DOUBLE), NULL, id, NULL, NULL, NULL, NULL,
  product_name, payment_method, notes, member_id, CAST(sale_price AS DOUBLE), member_qty_sold FROM sales
  WHERE product_id IS NOT NULL
UNION ALL SELECT product_id, 'restock', restocked_at, quantity_added, NULL, cost_per_unit, id, NULL, NULL, NULL, NULL,
  product_name, NULL, NULL, member_id, NULL, member_qty FROM restocks""",
    "expenses_list": _with(EXPENSES) + f"SELECT * FROM expenses WHERE {_EXPENSE_RANGE}",
    "expense_breakdown": _with(EXPENSES)
    + f"SELECT category, {_sum('amount', 'total')} FROM expenses WHERE {_EXPENSE_RANGE} GROUP BY category",
    "inventory_value": _with(PRODUCTS, SALES, EXPENSES, _pl_parts(False))
    + "SELECT inventory_value, inventory_value_all FROM pl",
    "ledger_append": _with(SALES, RESTOCKS)
    + """SELECT 'sale' AS kind, id, product_id, member_id, quantity_sold AS units, sold_at AS at FROM sales
WHERE CAST(sold_at AS DATE) BETWEEN DATE '1996-02-20' AND DATE '1996-09-10'
UNION ALL SELECT 'restock', id, product_id, member_id, quantity_added, restocked_at FROM restocks
WHERE CAST(restocked_at AS DATE) BETWEEN DATE '1996-02-20' AND DATE '1996-09-10'""",
    "ledger_append_batches": _with(SALES)
    + "SELECT concat('orders-', order_id % 4) AS batch, count(*) AS n_rows FROM sales GROUP BY 1",
    "pl_summary": _with(PRODUCTS, SALES, EXPENSES, _pl_parts(True)) + "SELECT * FROM pl",
    "pl_all_time": _with(PRODUCTS, SALES, EXPENSES, _pl_parts(False)) + "SELECT * FROM pl",
    "pl_top_products": _with(SALES) + _TOP,
    "pl_recent_sales": _with(SALES, MEMBERS) + _RECENT,
    "pl_doc": _with(
        PRODUCTS, SALES, EXPENSES, MEMBERS, _pl_parts(True), f"top AS ({_TOP})", f"recent AS ({_RECENT})"
    )
    + f"""SELECT 'summary' AS section, 'revenue' AS label, transactions AS units, revenue AS amount FROM pl
UNION ALL SELECT 'summary', 'cogs', transactions, cogs FROM pl
UNION ALL SELECT 'summary', 'net_profit', transactions, net_profit FROM pl
UNION ALL SELECT 'summary', 'total_invested', transactions, total_invested FROM pl
UNION ALL SELECT 'expense_breakdown', category, NULL, CAST(SUM(amount) AS DOUBLE) FROM expenses
  WHERE {_EXPENSE_RANGE} GROUP BY category
UNION ALL SELECT 'top_products', product_name, units, revenue FROM top
UNION ALL SELECT 'recent_sales', id, quantity_sold, CAST(profit AS DOUBLE) FROM recent""",
    "member_statements": _with(MEMBERS, PRODUCTS, SALES)
    + """SELECT m.*, CAST(stock_value AS DOUBLE) AS stock_value, active_products, total_products,
  CAST(sold_cost + stock_value AS DOUBLE) AS total_fronted, CAST(sold_cost AS DOUBLE) AS sold_cost,
  CAST(sold_revenue AS DOUBLE) AS sold_revenue, CAST(sold_cost AS DOUBLE) AS owed_back
FROM (SELECT m.id,
  COALESCE((SELECT SUM(COALESCE(member_qty, 0) * COALESCE(cost_price, 0)) FROM products p
    WHERE p.member_id = m.id AND quantity > 0), 0) AS stock_value,
  (SELECT COUNT(*) FROM products p WHERE p.member_id = m.id AND quantity > 0) AS active_products,
  (SELECT COUNT(*) FROM products p WHERE p.member_id = m.id) AS total_products,
  COALESCE((SELECT SUM(cost_price * COALESCE(member_qty_sold, 0)) FROM sales s WHERE s.member_id = m.id), 0) AS sold_cost,
  COALESCE((SELECT SUM(sale_price * COALESCE(member_qty_sold, 0)) FROM sales s WHERE s.member_id = m.id), 0) AS sold_revenue
FROM members m) x JOIN members m ON m.id = x.id""",
    "member_products": _with(PRODUCTS)
    + "SELECT id, name, quantity, member_qty, cost_price, price, stock, member_id FROM products "
    "WHERE member_id IS NOT NULL",
    "products_of_member": _with(PRODUCTS)
    + "SELECT id, name, quantity, member_qty, cost_price, price, stock FROM products WHERE member_id = 6",
    "product_insert": _with(PRODUCTS, PRODUCT_REQUESTS, _TABLE)
    + f"""SELECT *, '[]' AS images FROM base
UNION ALL SELECT -1 - 2 * id - seq, name, COALESCE(NULLIF(category, ''), 'Other'), NULLIF(subcategory, ''),
  description, price, stock, featured, sort_order, quantity, NULL, member_id, member_qty, {_TODAY}, {_TODAY}, images
FROM product_requests WHERE name <> ''""",
    "product_upsert": _with(PRODUCTS, PRODUCT_REQUESTS, _TABLE, _LAST_REQUEST)
    + """SELECT b.id, CASE WHEN l.id IS NULL THEN b.name ELSE l.name END AS name,
  CASE WHEN l.id IS NULL THEN b.category ELSE COALESCE(NULLIF(l.category, ''), 'Other') END AS category,
  CASE WHEN l.id IS NULL THEN b.subcategory ELSE NULLIF(l.subcategory, '') END AS subcategory,
  CASE WHEN l.id IS NULL THEN b.description ELSE l.description END AS description,
  CASE WHEN l.id IS NULL THEN b.price ELSE l.price END AS price,
  CASE WHEN l.id IS NULL THEN b.stock ELSE l.stock END AS stock,
  CASE WHEN l.id IS NULL THEN b.featured ELSE l.featured END AS featured,
  CASE WHEN l.id IS NULL THEN b.sort_order ELSE l.sort_order END AS sort_order,
  CASE WHEN l.id IS NULL THEN b.quantity ELSE l.quantity END AS quantity,
  CASE WHEN l.id IS NULL THEN b.cost_price END AS cost_price,
  CASE WHEN l.id IS NULL THEN b.member_id ELSE l.member_id END AS member_id,
  CASE WHEN l.id IS NULL THEN b.member_qty ELSE l.member_qty END AS member_qty, b.created_at,
  CASE WHEN l.id IS NULL THEN b.updated_at ELSE DATE '2002-01-01' END AS updated_at
FROM base b LEFT JOIN last l ON l.id = b.id""",
    "product_delete": _with(PRODUCTS, _TABLE)
    + "SELECT * FROM base WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)",
    "expense_append": _with(EXPENSES, EXPENSE_REQUESTS)
    + f"""SELECT id, category, CAST(amount AS DOUBLE) AS amount, expense_date, 'Cash' AS payment_method,
  CAST(NULL AS VARCHAR) AS notes FROM expenses
UNION ALL SELECT id, COALESCE(NULLIF(category, ''), 'Other'), COALESCE({_leading_float('amount')}, 0),
  COALESCE(TRY_CAST(NULLIF(expense_date, '') AS DATE), DATE '2002-01-01'),
  COALESCE(NULLIF(payment_method, ''), 'Cash'), NULLIF(notes, '') FROM expense_requests
WHERE {_EXPENSE_GIVEN} AND amount <> '-1e99'""",
    "expense_delete": _with(EXPENSES)
    + "SELECT * FROM expenses WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice < 100000)",
    "sale_edit": _with(SALES, SALE_EDITS)
    + """, folded AS (SELECT id, arg_max(new_price, seq) FILTER (WHERE new_price <> 0) AS new_price,
  arg_max(new_payment, seq) FILTER (WHERE new_payment <> '') AS new_payment,
  arg_max(new_notes, seq) FILTER (WHERE new_notes IS NOT NULL) AS new_notes FROM edits WHERE NOT too_large GROUP BY id),
merged AS (SELECT s.*, f.id AS hit, COALESCE(f.new_price, CAST(s.sale_price AS DOUBLE)) AS price, f.new_payment, f.new_notes,
  CAST(cost_price AS DOUBLE) AS unit_cost
FROM sales s LEFT JOIN folded f ON f.id = s.id)
SELECT id, price AS sale_price, cost_price, quantity_sold, COALESCE(new_payment, payment_method) AS payment_method,
  COALESCE(new_notes, notes) AS notes,
  CASE WHEN hit IS NULL THEN CAST(profit AS DOUBLE) ELSE price - unit_cost * quantity_sold END AS profit,
  (price - unit_cost) * quantity_sold AS profit_line FROM merged""",
    "member_insert": _with(MEMBERS, MEMBER_REQUESTS)
    + f"""SELECT id, name, phone, CAST(NULL AS VARCHAR) AS notes, DATE '2001-12-31' AS created_at FROM members
UNION ALL SELECT -1 - id, name, phone, notes, {_TODAY} FROM member_requests WHERE name <> ''""",
    "member_update": _with(MEMBERS, MEMBER_REQUESTS)
    + """SELECT m.id, CASE WHEN r.id IS NULL THEN m.name ELSE r.name END AS name,
  CASE WHEN r.id IS NULL THEN m.phone ELSE r.phone END AS phone, r.notes, DATE '2001-12-31' AS created_at
FROM members m LEFT JOIN member_requests r ON r.id = m.id AND r.name <> ''""",
    "member_upsert": _with(MEMBERS, MEMBER_REQUESTS)
    + f""", valid AS (SELECT * FROM member_requests WHERE name <> '')
SELECT id, name, phone, notes, {_TODAY} AS created_at FROM valid UNION ALL
SELECT id, name, phone, CAST(NULL AS VARCHAR), DATE '2001-12-31' FROM members WHERE id NOT IN (SELECT id FROM valid)""",
    "member_delete": _with(MEMBERS)
    + "SELECT * FROM members WHERE id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000)",
    "member_unlink": _with(PRODUCTS)
    + """SELECT id, CASE WHEN member_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000)
  THEN member_id END AS member_id, member_qty FROM products""",
    "seed_if_empty_table": _with(PRODUCTS)
    + "SELECT 'empty' AS target, id, name FROM products WHERE featured = 1 "
    "UNION ALL SELECT 'filled', id, name FROM products",
    "validate_sales": _with(SALE_REQUESTS)
    + f""", typed AS (SELECT id, {_PRODUCT_ID} AS product_id, product_name,
  COALESCE(NULLIF({_leading_int('quantity_sold')}, 0), 1) AS quantity_sold,
  COALESCE({_leading_float('sale_price')}, 0) AS sale_price, COALESCE({_leading_float('cost_price')}, 0) AS cost_price,
  NULLIF(notes, '') AS notes, NULLIF(payment_method, '') AS payment_method,
  CASE WHEN sold_at = '' THEN {_TODAY} ELSE CAST(sold_at AS DATE) END AS sold_at
FROM requests WHERE {_SALE_OK})
SELECT *, (sale_price - cost_price) * quantity_sold AS profit FROM typed""",
    "validate_restocks": _with(RESTOCK_REQUESTS)
    + f"""SELECT id, CAST(product_id AS BIGINT) AS product_id, COALESCE(product_name, '') AS product_name,
  COALESCE({_leading_int('quantity_added')}, 0) AS quantity_added,
  NULLIF({_leading_float('cost_per_unit')}, 0) AS cost_per_unit, NULLIF(notes, '') AS notes,
  CASE WHEN member_id <> '' THEN {_leading_int('member_id')} END AS member_id,
  LEAST(COALESCE({_leading_int('member_qty')}, 0), COALESCE({_leading_int('quantity_added')}, 0)) AS member_qty,
  CASE WHEN restocked_at = '' THEN {_TODAY} ELSE CAST(restocked_at AS DATE) END AS restocked_at
FROM restock_requests WHERE {_RESTOCK_OK}""",
    "validate_rejects": _with(_VOIDS, EXPENSE_REQUESTS, PRODUCT_REQUESTS, MEMBER_REQUESTS, SALE_EDITS)
    + f"""SELECT 'sale' AS kind, id, CASE WHEN {_SALE_COMPLETE} THEN 'Number out of range'
  ELSE 'Missing required fields' END AS reject_reason FROM requests WHERE NOT COALESCE({_SALE_OK}, false)
UNION ALL SELECT 'restock', id, 'Missing fields' FROM restock_requests WHERE NOT ({_RESTOCK_OK})
UNION ALL SELECT 'expense', CAST(id AS VARCHAR), CASE WHEN {_EXPENSE_GIVEN} THEN 'Number out of range'
  ELSE 'Amount required' END FROM expense_requests WHERE NOT ({_EXPENSE_GIVEN}) OR amount = '-1e99'
UNION ALL SELECT 'void', void_id, 'Sale not found' FROM voids WHERE NOT valid
UNION ALL SELECT 'import', CAST(page_id AS VARCHAR), 'URL required' FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT 'product', CAST(id AS VARCHAR), 'Name required' FROM product_requests WHERE name = ''
UNION ALL SELECT 'member', CAST(id AS VARCHAR), 'Name required' FROM member_requests WHERE name = ''
UNION ALL SELECT 'sale edit', id, CASE WHEN id IN (SELECT id FROM sales WHERE product_id IS NOT NULL)
  THEN 'Number out of range' ELSE 'Not found' END FROM edits
  WHERE too_large OR id NOT IN (SELECT id FROM sales WHERE product_id IS NOT NULL)""",
    "ledger_state": _ledger(_LINES) + _STATE,
    "ledger_history": _ledger(_LINES) + _HISTORY,
    "ledger_void": _ledger(_LINES_AND_VOIDS) + _HISTORY,
    "ledger_void_state": _ledger(_LINES_AND_VOIDS) + _STATE,
    "ledger_hot_state": _shelf_ledger(False) + _STATE.replace("FROM walk)", "FROM walk WHERE product_id < 200)"),
    "ledger_hot_void": _shelf_ledger(True) + _HISTORY.replace("SELECT e.product_id", "SELECT e.part, e.product_id"),
    "ledger_stored_void": _with(PRODUCTS, SALES)
    + f""", back AS (SELECT product_id, SUM(quantity_sold) AS n FROM sales
  WHERE product_id IS NOT NULL AND payment_method IS NULL GROUP BY product_id),
each AS (SELECT product_id, COALESCE(member_qty_sold, 0) AS share,
  SUM(quantity_sold) OVER w AS added, SUM(COALESCE(member_qty_sold, 0)) OVER w AS shared
FROM sales WHERE product_id IS NOT NULL AND payment_method IS NULL
WINDOW w AS (PARTITION BY product_id ORDER BY sold_at, order_id, line_no, id ROWS UNBOUNDED PRECEDING)),
slack AS (SELECT e.product_id, MIN(p.quantity + added - shared) AS room, MAX(shared) AS shared
FROM each e JOIN products p ON p.id = e.product_id GROUP BY e.product_id)
SELECT p.id AS product_id, CAST(p.quantity + COALESCE(b.n, 0) AS BIGINT) AS quantity,
  CAST(CASE WHEN s.product_id IS NULL THEN COALESCE(member_qty, 0)
    ELSE s.shared + LEAST(COALESCE(member_qty, 0), s.room) END AS BIGINT) AS member_qty,
  NULLIF(p.member_id, 0) AS member_id, {_shown('CAST(p.cost_price AS DOUBLE)')} AS cost_price,
  CASE WHEN b.n IS NULL THEN p.stock WHEN p.quantity + b.n = 0 THEN 'out_stock'
    WHEN p.quantity + b.n <= 5 THEN 'low_stock' ELSE 'in_stock' END AS stock
FROM products p LEFT JOIN back b ON b.product_id = p.id LEFT JOIN slack s ON s.product_id = p.id""",
    "ledger_running_qty": _ledger(_LINES)
    + """SELECT e.product_id, e.day, e.order_id, e.line_no, e.kind, w.q AS running_quantity
FROM ev e JOIN walk w ON w.product_id = e.product_id AND w.pos = e.pos""",
    "record_sales": _ledger(_REQUEST_EVENTS)
    + f""", typed AS (SELECT id, {_PRODUCT_ID} AS product_id, product_name,
  COALESCE(NULLIF({_leading_int('quantity_sold')}, 0), 1) AS quantity_sold,
  COALESCE({_leading_float('sale_price')}, 0) AS sale_price, COALESCE({_leading_float('cost_price')}, 0) AS cost_price,
  NULLIF(payment_method, '') AS payment_method, NULLIF(notes, '') AS notes,
  CASE WHEN sold_at = '' THEN {_TODAY} ELSE CAST(sold_at AS DATE) END AS sold_at
FROM requests WHERE {_SALE_OK}),
sold AS (SELECT e.ref, w.who, w.moved, w.q FROM ev e JOIN walk w ON w.product_id = e.product_id AND w.pos = e.pos
WHERE e.kind = 'sale')
SELECT t.*, (sale_price - cost_price) * quantity_sold AS profit, who AS member_id,
  COALESCE(moved, 0) AS member_qty_sold, COALESCE(q = 0, false) AS sold_out FROM typed t LEFT JOIN sold ON sold.ref = t.id""",
    "record_products": _ledger(_REQUEST_EVENTS) + _NEXT_PRODUCTS,
    "record_void_products": _ledger(_VOID_EVENTS) + _NEXT_PRODUCTS,
    "record_voids": _ledger(_VOID_EVENTS)
    + f""", moved AS (SELECT e.ref, w.moved FROM ev e JOIN walk w ON w.product_id = e.product_id AND w.pos = e.pos
WHERE e.kind = 'sale'),
gone AS (SELECT id FROM voids WHERE valid)
SELECT r.id, {_PRODUCT_ID} AS product_id, COALESCE(NULLIF({_leading_int('quantity_sold')}, 0), 1) AS quantity_sold,
  COALESCE(m.moved, 0) AS member_qty_sold, 'new' AS origin
FROM requests r JOIN placed_lines p USING (id) LEFT JOIN moved m ON m.ref = r.id
WHERE {_SALE_OK} AND line_no <> 3 AND r.id NOT IN (SELECT id FROM gone)
UNION ALL SELECT id, product_id, quantity_sold, member_qty_sold, 'stored' FROM sales
WHERE line_no = 3 AND id NOT IN (SELECT id FROM gone)""",
    "import_slot": _SLOT,
    "extract_products": _EXTRACT.format(description="NULL"),
    "extract_products_static": _EXTRACT.format(description="''"),
    "extract_structured": _shop(True),
    "extract_structured_static": _shop(False),
    "extract_repeated_names": """SELECT p_partkey AS page_id,
  CASE p_partkey % 5 WHEN 1 THEN p_name || ' ok' ELSE p_name END AS name,
  CASE WHEN p_partkey % 5 IN (0, 4) THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) END AS price,
  CASE p_partkey % 5 WHEN 2 THEN '["i2"]' ELSE '[]' END AS images FROM part""",
    "extract_broken_blocks": """SELECT p_partkey AS page_id, CASE p_partkey % 5 WHEN 1 THEN 1 ELSE 2 END AS blocks
FROM part WHERE p_partkey % 5 IN (1, 3)""",
    "extract_rejects": """SELECT doc_id AS page_id, 'Other' AS source, CAST(NULL AS DOUBLE) AS price,
  'Could not extract product info from this page.' AS reject_reason FROM documents WHERE text NOT LIKE '%<h1%'""",
    "stream_ledger": _ledger(_LINES_AND_VOIDS) + _HISTORY,
    "stream_extract": _EXTRACT.format(description="NULL"),
    "stream_slot": _SLOT,
    "stream_totals": _with(SALES) + _PRODUCT_SALES,
    "stream_expenses": _with(EXPENSES)
    + f"SELECT category, {_sum('amount', 'total')} FROM expenses GROUP BY category",
    "stream_sales_totals": _with(PRODUCTS, SALES, EXPENSES, _pl_parts(False))
    + """SELECT CAST(s.revenue AS DOUBLE) AS revenue, CAST(total_cogs AS DOUBLE) AS total_cogs,
  CAST(s.stored_profit AS DOUBLE) AS stored_profit, s.transactions, CAST(s.member_cogs AS DOUBLE) AS member_cogs,
  CAST(ever.own AS DOUBLE) AS all_time_my_cogs FROM s, ever""",
}

# Stored tables give what their snapshots give.
ORACLE |= {f"{name}_stored": ORACLE[name] for name in ("product_upsert", "product_delete", "sale_edit", "member_upsert")}
ORACLE |= {name: ORACLE["pl_summary"] for name in ("pl_summary_from_days", "stream_pl_summary")}
