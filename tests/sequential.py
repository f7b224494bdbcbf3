"""A plain sequential order book, written from the data model's rules, for differential tests."""

from __future__ import annotations


class OneBook:
    def __init__(self):
        self.levels = {}
        self.stale = True
        self.ts = None
        self.sub = None

    def best(self, side):
        prices = [p for (s, p) in self.levels if s == side]
        if not prices:
            return None
        return max(prices) if side == 0 else min(prices)

    def crossed(self):
        bid, ask = self.best(0), self.best(1)
        return bid is not None and ask is not None and bid >= ask

    def image(self, rows, ts=None):
        seen = {}
        for side, price, count in rows:
            if count <= 0 or (side, price) in seen:
                self.stale = True
                return
            seen[side, price] = count
        old = self.levels
        self.levels = seen
        if self.crossed():
            self.levels = old
            self.stale = True
            return
        self.stale = False
        self.ts = ts

    def delta(self, side, price, change, ts):
        if self.stale:
            return
        now = self.levels.get((side, price), 0) + change
        if now < 0:
            self.stale = True
            return
        if now:
            self.levels[side, price] = now
        else:
            self.levels.pop((side, price), None)
        if self.crossed():
            self.stale = True
            return
        if ts is not None:
            self.ts = ts


def in_order(events, drop_ns=600_000_000_000):
    """Events ``(wall, mono, kind, payload)`` in receive order, each with its position; kinds are D, S and G."""
    ranked = []
    source = {"D": 0, "S": 1, "G": 2}
    high, boots = None, 0
    for n, event in sorted(enumerate(events), key=lambda e: (e[1][0], source[e[1][2]], e[1][1])):
        mono = event[1]
        if high is not None and mono < high - drop_ns:
            boots, high = boots + 1, mono
        else:
            high = mono if high is None else max(high, mono)
        ranked.append(((boots, mono, 0 if event[2] == "G" else 1, source[event[2]], n), event))
    return sorted(ranked, key=lambda r: r[0])


def run(events, base=None):
    """Books after all events."""
    books = base or {}
    for _, (_, _, kind, row) in in_order(events):
        if kind == "G":
            for book in books.values():
                if book.sub == (row["conn_id"], row["sid"]):
                    book.stale = True
            continue
        book = books.setdefault(row["ticker"], OneBook())
        book.sub = (row["conn_id"], row["sid"])
        if kind == "D":
            book.delta(row["side"], row["price_e4"], row["delta_e2"], row["ts_ms"])
        else:
            book.image(row["levels"])
    return books
