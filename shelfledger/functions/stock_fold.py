"""One product's stock, moved event by event.

The only order-dependent arithmetic that no window expresses: the member share
of a sale depends on what is left, and the average cost on the stock it meets.
Used inside tasks by the batch ledger and by the streaming processor.
"""

from __future__ import annotations

from shelfledger.functions.stock import IN, LOW, LOW_LIMIT, OUT


def band(quantity: int, restocked: bool) -> str:
    if quantity > LOW_LIMIT:
        return IN
    if quantity == 0 or (restocked and quantity < 0):
        return OUT
    return LOW


class Stock:
    """Quantity, member quantity, member and unit cost of one product.

    ``known`` is false until an opening state arrives: events of an unknown
    product are kept but move nothing.
    """

    __slots__ = ("known", "quantity", "member_qty", "member_id", "cost", "stock")

    def __init__(self):
        self.known = False
        self.quantity = self.member_qty = 0
        self.member_id = self.cost = self.stock = None

    def open(self, quantity, member_qty, member_id, cost, stock):
        self.known = True
        self.quantity = quantity or 0
        self.member_qty = member_qty or 0
        self.member_id = member_id or None
        self.cost = cost
        self.stock = stock

    def sell(self, units: int) -> int:
        """Own units go first; returns the member units sold."""
        if not self.known:
            return 0
        # Conditions in place of min and max: this runs once an event.
        quantity, held, member_units = self.quantity, self.member_qty, 0
        if self.member_id:
            own = quantity - held
            member_units = units if own <= 0 else units - own
            if member_units < 0 or units <= 0:
                member_units = 0
        quantity -= units
        held -= member_units
        self.quantity = quantity = quantity if quantity > 0 else 0
        self.member_qty = held if held > 0 else 0
        self.stock = IN if quantity > LOW_LIMIT else LOW if quantity else OUT
        return member_units

    def restock(self, units: int, member_units: int, member_id, unit_cost) -> None:
        if not self.known:
            return
        before = self.quantity
        self.quantity = before + units
        self.member_qty += min(member_units, units)
        self.member_id = self.member_id or member_id or None
        self.stock = band(self.quantity, True)
        if not unit_cost:
            return
        if before > 0 and self.cost:
            # No average exists over zero units.
            spent = (before * self.cost) + (units * unit_cost)
            self.cost = spent / self.quantity if self.quantity else None
        else:
            self.cost = unit_cost

    def hangs_on_start(self) -> None:
        """Called where what follows depends on the first state in a way that is not traced."""

    def void(self, units: int, member_units: int) -> None:
        if not self.known:
            return
        self.quantity += units
        self.member_qty = min(self.quantity, self.member_qty + member_units)
        self.stock = band(self.quantity, False)


class TracedStock(Stock):
    """Stock that also records how its result hangs on the state it started from.

    While ``exact``, the final member quantity is ``min(first + added, cap)`` for
    any first one between 0 and the quantity; the final cost is ``scale * first
    cost + offset``. ``touched`` says whether any event wrote the stock band.
    """

    __slots__ = ("added", "cap", "exact", "touched", "scale", "offset")

    _FREE = 1 << 62

    def __init__(self):
        super().__init__()
        self.added, self.cap, self.exact, self.touched = 0, self._FREE, True, False
        self.scale, self.offset = 1.0, 0.0

    def hangs_on_start(self):
        self.exact = False

    def _add(self, member_units: int) -> None:
        self.added += member_units
        if self.cap != self._FREE:
            self.cap += member_units

    def sell(self, units):
        if not 0 <= self.member_qty <= self.quantity:
            self.exact = False
        member_units = Stock.sell(self, units)
        if self.known:
            self.touched = True
            # Own units go first, so the member keeps what the rest leaves room for.
            if self.member_id and self.quantity < self.cap:
                self.cap = self.quantity
        return member_units

    def restock(self, units, member_units, member_id, unit_cost):
        before, averaged = self.quantity, bool(self.cost)
        super().restock(units, member_units, member_id, unit_cost)
        if not self.known:
            return
        self.touched = True
        added = min(member_units, units)
        if added < 0:
            self.exact = False
        self._add(added)
        if unit_cost and before > 0 and averaged and self.quantity:
            kept = before / self.quantity
            self.scale *= kept
            self.offset = self.offset * kept + units * unit_cost / self.quantity
        elif unit_cost:
            self.scale, self.offset = 0.0, self.cost or 0.0

    def void(self, units, member_units):
        super().void(units, member_units)
        if self.known:
            self.touched = True
            self._add(member_units)
            self.cap = min(self.cap, self.quantity)
