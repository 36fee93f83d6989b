"""Order books: the sequential engine, and the signed-delta form in plain windows."""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import partial
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tapeloom.operators.walks import Walker, walk
from tapeloom.schema import ADD, ADD_MPID, BOOK_TYPES, BUY, CANCEL, DELETE, EXECUTE, EXECUTE_PRICE, REPLACE, SELL

TOP = "bid_price long, bid_qty long, ask_price long, ask_qty long, queue_ahead long, changed_top boolean"


class Ladder:
    """Quantities by price of one side, with its best price at hand."""

    def __init__(self, side: int):
        self.buy, self.qty, self.prices = side == BUY, {}, []

    def add(self, price: int, qty: int) -> None:
        if price not in self.qty:
            insort(self.prices, price)
            self.qty[price] = 0
        self.qty[price] += qty

    def take(self, price: int, qty: int) -> None:
        left = self.qty.get(price)
        if left is None:
            return
        if left > qty:
            self.qty[price] = left - qty
        else:
            del self.qty[price]
            self.prices.pop(bisect_left(self.prices, price))

    def top(self):
        if not self.prices:
            return None, None
        p = self.prices[-1 if self.buy else 0]
        return p, self.qty[p]

    def levels(self) -> list[tuple[int, int]]:
        """Best first."""
        return [(p, self.qty[p]) for p in (reversed(self.prices) if self.buy else self.prices)]


class Book:
    """Orders and levels of a venue's symbols.

    In strict mode an order knows its symbol, side and price, a delete removes what remains, a replace keeps the side, and
    order id 0 is no order. In compat mode levels are those of the event's own symbol, a delete with a quantity removes no more than that
    from the level, a replace of unknown side does not come back, and adds with id 0 count.
    """

    def __init__(self, compat: bool = False):
        self.compat, self.orders, self.sides = compat, {}, {}

    def ladder(self, symbol: str, side: int) -> Ladder:
        key = symbol, side
        if key not in self.sides:
            self.sides[key] = Ladder(side)
        return self.sides[key]

    def _reduce(self, order_id: int, symbol: str, qty: int, delete: bool) -> tuple | None:
        order = self.orders.get(order_id)
        if order is None:
            return None
        own, side, price, left = order
        gone = left if qty == 0 or qty > left or (delete and not self.compat) else qty
        self.ladder(symbol if self.compat else own, side).take(price, gone)
        if delete or gone == left:
            del self.orders[order_id]
        else:
            self.orders[order_id] = own, side, price, left - gone
        return order

    def _insert(self, order_id: int, symbol: str, side: int, price: int, qty: int) -> int:
        if side not in (BUY, SELL) or (order_id == 0 and not self.compat):
            return 0
        ladder = self.ladder(symbol, side)
        ahead = ladder.qty.get(price, 0)
        if qty:
            ladder.add(price, qty)
        if order_id:
            self.orders[order_id] = symbol, side, price, qty
        return ahead

    def apply(self, kind: int, symbol: str, order_id: int, reference: int, side: int, price: int, qty: int) -> int:
        """Applies an event; the quantity ahead of a new order."""
        if kind in (ADD, ADD_MPID):
            return self._insert(order_id, symbol, side, price, qty)
        if kind in (EXECUTE, EXECUTE_PRICE, CANCEL, DELETE):
            self._reduce(order_id, symbol, qty, kind == DELETE)
        elif kind == REPLACE:
            old = self._reduce(reference or order_id, symbol, 0, True)
            if old and not self.compat:
                symbol, side = old[0], side if side in (BUY, SELL) else old[1]
            return self._insert(order_id, symbol, side, price, qty)
        return 0

    def tops(self, symbol: str) -> tuple:
        return (*self.ladder(symbol, BUY).top(), *self.ladder(symbol, SELL).top())


class StrictBook:
    """One venue's symbol by Book's strict rules, written out flat: levels are dicts, and each side has a heap of prices from which
    dead ones are dropped when they come to the top. What it holds is the live orders and levels."""

    def __init__(self):
        self.orders, self.bids, self.asks, self.bid_heap, self.ask_heap = {}, {}, {}, [], []
        self.top = (None, None, None, None)

    def run(self, kinds: list, ids: list, references: list, sides: list, prices: list, quantities: list) -> list[list]:
        """Columns bid_price, bid_qty, ask_price, ask_qty, queue_ahead and changed_top after each event."""
        n = len(kinds)
        out = [[None] * n for _ in range(4)] + [[0] * n, [False] * n]
        bid_price, bid_qty, ask_price, ask_qty, ahead_of, moved = out
        orders, bids, asks, bid_heap, ask_heap = self.orders, self.bids, self.asks, self.bid_heap, self.ask_heap
        b, bq, a, aq = self.top
        i = -1
        for kind, oid, side, price, qty in zip(kinds, ids, sides, prices, quantities):
            i += 1
            if kind <= REPLACE:
                key = oid
                if kind > ADD_MPID:
                    if kind == REPLACE:
                        key = references[i] or oid
                    order = orders.get(key)
                    if order is not None:
                        was, at, left = order
                        gone = left if kind >= DELETE or qty == 0 or qty > left else qty
                        levels = asks if was else bids
                        have = levels.get(at, 0)
                        if have > gone:
                            levels[at] = have - gone
                        else:
                            levels.pop(at, None)
                        if gone == left:
                            del orders[key]
                        else:
                            orders[key] = was, at, left - gone
                        if side > 1:
                            side = was
                if (kind <= ADD_MPID or kind == REPLACE) and side < 2 and oid:
                    levels = asks if side else bids
                    have = levels.get(price)
                    if qty:
                        if have is None:
                            heappush(ask_heap, price) if side else heappush(bid_heap, -price)
                            levels[price] = qty
                        else:
                            levels[price] = have + qty
                    orders[oid] = side, price, qty
                    if have:
                        ahead_of[i] = have
                while bid_heap and -bid_heap[0] not in bids:
                    heappop(bid_heap)
                while ask_heap and ask_heap[0] not in asks:
                    heappop(ask_heap)
                nb, na = (-bid_heap[0] if bid_heap else None), (ask_heap[0] if ask_heap else None)
                nbq, naq = bids.get(nb), asks.get(na)
                if nbq != bq or nb != b or naq != aq or na != a:
                    moved[i] = True
                    b, bq, a, aq = nb, nbq, na, naq
            bid_price[i], bid_qty[i], ask_price[i], ask_qty[i] = b, bq, a, aq
        self.top = b, bq, a, aq
        return out


def walk_strict(kinds: list, ids: list, references: list, sides: list, prices: list, quantities: list) -> list[list]:
    """StrictBook from the start."""
    return StrictBook().run(kinds, ids, references, sides, prices, quantities)


def enrich(events: DataFrame) -> DataFrame:
    """Events that name only an order get its symbol and side, from the latest event of the order that has them."""
    order = Window.partitionBy("venue", F.when(F.col("reference_order_id") != 0, F.col("reference_order_id")).otherwise(F.col("order_id"))).orderBy("arrival")
    bare = (F.col("symbol") == "") & F.col("event_type").isin(*BOOK_TYPES)
    symbol = F.coalesce(F.last(F.when(F.col("symbol") != "", F.col("symbol")), ignorenulls=True).over(order), F.col("symbol"))
    return events.withColumn("symbol", F.when(bare, symbol).otherwise(F.col("symbol")))


NEEDED = ("arrival", "venue", "symbol", "event_type", "order_id", "reference_order_id", "side", "price", "qty")


def with_tops(events: DataFrame, compat: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Every event with its own venue's best bid and offer after it, the queue ahead of a new order and whether the top changed.

    `keep` names the events' columns that are wanted after it (all): Spark cannot prune through the walk, so the rest is cut before.

    Books are independent by venue and symbol (in compat mode by venue), so these are the walks' keys; what a task holds is a book, not its events.
    """
    columns = list(keep or events.columns)
    events = events.select(*dict.fromkeys([*columns, *NEEDED]))
    types = ", ".join(f"{n} {t}" for n, t in events.select(*columns).dtypes)
    if compat:
        return walk(events, ["venue"], ["arrival"], partial(CompatWalk, columns), f"{types}, {TOP}")
    return walk(events, ["venue", "symbol"], ["arrival"], partial(TopWalk, columns), f"{types}, {TOP}")


CELLS = ("event_type", "order_id", "reference_order_id", "side", "price", "qty")
TOP_NAMES = [f.split()[0] for f in TOP.split(", ")]


def _cells(rows: pa.RecordBatch, names) -> list[list]:
    return [c.to_numpy(zero_copy_only=False).tolist() if not c.null_count and not pa.types.is_string(c.type) else c.to_pylist() for c in map(rows.column, names)]


def _with(rows: pa.RecordBatch, columns: list[str], out) -> pa.RecordBatch:
    cells = [pa.array(values, pa.bool_() if name == "changed_top" else pa.int64()) for name, values in zip(TOP_NAMES, out)]
    return pa.RecordBatch.from_arrays([*map(rows.column, columns), *cells], [*columns, *TOP_NAMES])


class TopWalk(Walker):
    """One venue's symbol."""

    def __init__(self, columns: list[str]):
        self.columns, self.book = columns, StrictBook()

    def feed(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        return _with(rows, self.columns, self.book.run(*_cells(rows, CELLS)))


class CompatWalk(Walker):
    """One venue, all its symbols."""

    def __init__(self, columns: list[str]):
        self.columns, self.book, self.last = columns, Book(True), {}

    def feed(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for kind, symbol, *rest in zip(*_cells(rows, ("event_type", "symbol", *CELLS[1:]))):
            ahead = self.book.apply(kind, symbol, *rest)
            top = self.book.tops(symbol)
            out.append((*top, ahead, top != self.last.get(symbol, (None,) * 4)))
            self.last[symbol] = top
        return _with(rows, self.columns, zip(*out))


def deltas(events: DataFrame) -> DataFrame:
    """(arrival, venue, symbol, side, price, delta): what each event adds to a level; exact where no reduction exceeds the remainder."""
    order = Window.partitionBy("venue", "order_id").orderBy("arrival")
    orders = events.where(F.col("event_type").isin(ADD, ADD_MPID, EXECUTE, EXECUTE_PRICE, CANCEL, DELETE) & (F.col("order_id") != 0))
    is_add = F.col("event_type").isin(ADD, ADD_MPID)
    own = F.last(F.when(is_add, F.struct("symbol", "side", "price")), ignorenulls=True).over(order)
    signed = F.when(is_add, F.col("qty")).when(F.col("event_type") == DELETE, F.lit(0).cast("long")).otherwise(-F.col("qty"))
    left = F.sum(signed).over(order.rowsBetween(Window.unboundedPreceding, -1))
    whole = F.when((F.col("event_type") == DELETE) | (~is_add & (F.col("qty") == 0)), -left).otherwise(signed)
    found = orders.withColumn("own", own).withColumn("delta", whole)
    return found.where("own IS NOT NULL").select("arrival", "venue", F.col("own.symbol").alias("symbol"), F.col("own.side").alias("side"), F.col("own.price").alias("price"), "delta", "event_type", "order_id")


def oversize(events: DataFrame) -> DataFrame:
    """Reductions for which the delta form is not exact: use with_tops where there are any."""
    order = Window.partitionBy("venue", "order_id").orderBy("arrival")
    return deltas(events).withColumn("left", F.sum("delta").over(order)).where("left < 0")


def levels(events: DataFrame) -> DataFrame:
    """Depth of a level after each change, and the depth before it."""
    level = Window.partitionBy("venue", "symbol", "side", "price").orderBy("arrival")
    depth = F.sum("delta").over(level.rowsBetween(Window.unboundedPreceding, 0))
    return deltas(events).withColumn("depth", depth).withColumn("ahead", F.col("depth") - F.col("delta"))


def live_levels(events: DataFrame) -> DataFrame:
    """Levels with depth at the end of the tape: a sum, no order needed."""
    return deltas(events).groupBy("venue", "symbol", "side", "price").agg(F.sum("delta").alias("qty")).where("qty > 0")


def top_of_book(events: DataFrame) -> DataFrame:
    live = live_levels(events)
    bid, ask = F.when(F.col("side") == BUY, F.col("price")), F.when(F.col("side") == SELL, F.col("price"))
    return live.groupBy("venue", "symbol").agg(F.max(bid).alias("bid_price"), F.max_by("qty", bid).alias("bid_qty"), F.min(ask).alias("ask_price"), F.min_by("qty", ask).alias("ask_qty"))


def depth_snapshot(events: DataFrame) -> DataFrame:
    """Arrays of (price, qty) by side, best first."""
    best_first = F.when(F.col("side") == BUY, -F.col("price")).otherwise(F.col("price"))
    cells = F.array_sort(F.collect_list(F.struct(best_first.alias("k"), "price", "qty")))
    snap = live_levels(events).groupBy("venue", "symbol", "side").agg(cells.alias("cells"))
    return snap.select("venue", "symbol", "side", F.transform("cells", lambda c: F.struct(c["price"].alias("price"), c["qty"].alias("qty"))).alias("levels"))


class LevelWalk(Walker):
    """The levels that are left at the end of one venue's symbol."""

    def __init__(self, compat: bool):
        self.book, self.venue = Book(compat), None

    def feed(self, rows: pa.RecordBatch) -> None:
        self.venue = rows.column("venue")[0].as_py()
        for row in zip(*_cells(rows, ("event_type", "symbol", *CELLS[1:]))):
            self.book.apply(*row)

    def end(self) -> pa.RecordBatch | None:
        cells = [(self.venue, s, side, p, q) for (s, side), ladder in self.book.sides.items() for p, q in ladder.levels()]
        types = (pa.int16(), pa.string(), pa.int16(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], t) for k, t in enumerate(types)], ["venue", "symbol", "side", "price", "qty"])


def reconcile(events: DataFrame, compat: bool = False) -> DataFrame:
    """Levels on which the engine's final books and the delta form disagree; empty if they agree."""
    events = events.select(*NEEDED)
    engine = walk(events, ["venue", "symbol"], ["arrival"], partial(LevelWalk, compat), "venue short, symbol string, side short, price long, qty long")
    other = live_levels(events).select("venue", "symbol", "side", "price", "qty")
    return engine.exceptAll(other).unionByName(other.exceptAll(engine))
