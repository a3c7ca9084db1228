"""The order book with the published engine's quirks as one loop, to compare with."""


class Book:
    """Ladders and order index of one instrument."""

    def __init__(self):
        self.sides = {"Buy": {}, "Sell": {}}
        self.orders: dict[int, list] = {}

    def _take(self, side: str, px: int, qty: int) -> None:
        ladder = self.sides[side]
        ladder[px] = ladder.get(px, 0) - qty
        if ladder[px] <= 0:
            del ladder[px]

    def apply(self, kind: str, oid: int, new: int, px: int, qty: int, side: str) -> None:
        ladder, order = self.sides[side], self.orders.get(oid) if oid else None
        if kind in ("Add", "Snapshot"):
            if kind == "Snapshot" or qty > 0:
                ladder[px] = qty + (ladder.get(px, 0) if kind == "Add" else 0)
                if oid:
                    self.orders[oid] = [px, qty, side]
        elif kind == "Modify":
            ladder.update({px: qty}) if qty > 0 else ladder.pop(px, None)
            if order:
                order[1] = qty
                if qty <= 0:
                    del self.orders[oid]
        elif kind == "Replace":
            if order:
                self._take(order[2], order[0], order[1])
                del self.orders[oid]
                ladder[px] = ladder.get(px, 0) + qty
                self.orders[new] = [px, qty, side]
        elif kind == "Delete" and (not order or qty == 0):
            if order:
                self.sides[order[2]].pop(order[0], None)
                del self.orders[oid]
            else:
                ladder.pop(px, None)
        elif order:
            at = px if kind == "Trade" else order[0]
            if at:
                self._take(order[2], at, qty)
            order[1] -= qty
            if order[1] <= 0:
                del self.orders[oid]
        elif px in ladder and px:
            self._take(side, px, qty)

    def best(self) -> tuple[int, int, int, int]:
        bids, asks = self.sides["Buy"], self.sides["Sell"]
        b, a = max(bids, default=0), min(asks, default=0)
        return b, bids.get(b, 0), a, asks.get(a, 0)
