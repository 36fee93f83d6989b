"""Orders in their queues, and books checked at regular points.

effects() says what every event does to the one order that it touches, by the strict rules of the book and in one bounded walk, which
queue_position() takes too; checked books are sums over effects.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tapeloom.functions.ranks import global_rank
from tapeloom.operators.book import NEEDED, StrictBook, _cells
from tapeloom.operators.walks import Walker, walk
from tapeloom.schema import ADD_MPID, DELETE, REPLACE
from tapeloom.shared import stored

LEVEL = ["venue", "symbol", "side", "price"]
EFFECT = "arrival long, venue short, symbol string, step int, order_id long, age long, side short, price long, delta long, remaining long, entered boolean, gone boolean"
_CHECKED = f"{EFFECT}, checkpoint long"
_EFFECT_TYPES = (pa.int64(), pa.int16(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int16(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64())
_EFFECT_NAMES = [c.split()[0] for c in _CHECKED.split(", ")]


class OrderWalk(Walker):
    """Live orders of one venue's symbol: id -> (age, side, price, what remains). Ages count the orders that entered."""

    def __init__(self):
        self.orders, self.entered = {}, 0

    def feed(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        orders, out = self.orders, []
        venue, symbol = rows.column("venue")[0].as_py(), rows.column("symbol")[0].as_py()
        width = len(rows.schema) - len(NEEDED) + len(_EFFECT_NAMES) - 1
        points = rows.column("checkpoint").to_pylist() if width == len(_EFFECT_NAMES) else [None] * rows.num_rows
        cells = _cells(rows, ("arrival", "event_type", "order_id", "reference_order_id", "side", "price", "qty"))
        for at, kind, oid, reference, side, price, qty, point in zip(*cells, points):
            if kind > REPLACE:
                continue
            step = 0
            if kind > ADD_MPID:
                key = (reference or oid) if kind == REPLACE else oid
                order = orders.get(key)
                if order is not None:
                    age, own, level, left = order
                    cut = left if kind >= DELETE or qty == 0 or qty > left else qty
                    if cut == left:
                        del orders[key]
                    else:
                        orders[key] = age, own, level, left - cut
                    out.append((at, venue, symbol, 0, key, age, own, level, -cut, left - cut, False, cut == left, point))
                    step, side = 1, own if side > 1 else side
            if (kind <= ADD_MPID or kind == REPLACE) and side < 2 and oid:
                orders[oid] = self.entered, side, price, qty
                out.append((at, venue, symbol, step, oid, self.entered, side, price, qty, qty, True, False, point))
                self.entered += 1
        cells = zip(*out) if out else [[] for _ in _EFFECT_NAMES]
        made = [pa.array(c, t) for c, t in zip(cells, _EFFECT_TYPES)]
        return pa.RecordBatch.from_arrays(made[:width], _EFFECT_NAMES[:width])


def effects(events: DataFrame) -> DataFrame:
    """A row for every order that an event enters, reduces or takes out (a replace does two things, in steps 0 and 1).

    An order whose id is entered again stays in its level, out of reach, as in the book. A column checkpoint is kept.
    """
    point = [c for c in events.columns if c == "checkpoint"]
    return walk(events.select(*NEEDED, *point), ["venue", "symbol"], ["arrival"], OrderWalk, _CHECKED if point else EFFECT)


class LevelQueue:
    """Orders of one level by age, and sums of orders and lots before each in Fenwick trees, made anew when most places are empty."""

    def __init__(self):
        self.left, self.place, self.orders, self.lots = {}, {}, [0], [0]

    def enter(self, age: int, lots: int) -> None:
        if len(self.orders) > 2 * len(self.left) + 64:
            live = self.left
            self.__init__()
            for a, n in live.items():
                self._append(a, n)
        self._append(age, lots)

    def _append(self, age: int, lots: int) -> None:
        at, orders, below = len(self.orders), 1, 1
        self.left[age], self.place[age] = lots, at
        while below < at & -at:
            orders, lots, below = orders + self.orders[at - below], lots + self.lots[at - below], below << 1
        self.orders.append(orders)
        self.lots.append(lots)

    def ahead(self, age: int) -> tuple[int, int]:
        at, orders, lots = self.place[age] - 1, 0, 0
        while at:
            orders, lots, at = orders + self.orders[at], lots + self.lots[at], at & at - 1
        return orders, lots

    def reduce(self, age: int, cut: int, gone: bool) -> None:
        at = self.place[age]
        self.left[age] -= cut
        if gone:
            del self.left[age], self.place[age]
        while at < len(self.orders):
            self.orders[at] -= gone
            self.lots[at] -= cut
            at += at & -at


class QueueWalk(OrderWalk):
    """Effects with what stands before their orders; levels without orders are dropped, so memory is bounded by the orders in them."""

    def __init__(self):
        super().__init__()
        self.levels = {}

    def feed(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        found, out = super().feed(rows), []
        for age, side, price, delta, entered, gone in zip(*(found.column(c).to_pylist() for c in ("age", "side", "price", "delta", "entered", "gone"))):
            queue = self.levels.get((side, price))
            if queue is None:
                queue = self.levels[side, price] = LevelQueue()
            if entered:
                queue.enter(age, delta)
            out.append(queue.ahead(age))
            if not entered:
                queue.reduce(age, -delta, gone)
                if not queue.left:
                    del self.levels[side, price]
        ahead = zip(*out) if out else ([], [])
        return pa.RecordBatch.from_arrays([*found.columns, *(pa.array(c, pa.int64()) for c in ahead)], [*found.schema.names, "orders_ahead", "lots_ahead"])


def queue_position(events: DataFrame) -> DataFrame:
    """For every effect: how many orders and lots stand before the order in its level's queue after it.

    An order stands behind those of its level that entered before it. Each book's queues are kept by the walk that finds the effects, so nothing
    is sorted or summed again and a task holds the orders in its book's levels.
    """
    return walk(events.select(*NEEDED), ["venue", "symbol"], ["arrival"], QueueWalk, f"{EFFECT}, orders_ahead long, lots_ahead long")


# -- checkpoints --------------------------------------------------------------------------------------------------
SNAPSHOT = "venue short, symbol string, checkpoint long, side short, price long, qty long"


class SnapshotWalk(Walker):
    """Levels of one venue's symbol at the end of each interval in which it has events."""

    def __init__(self):
        self.book, self.key, self.now = StrictBook(), None, None

    def _levels(self) -> list[tuple]:
        return [(*self.key, self.now, side, p, q) for side, levels in enumerate((self.book.bids, self.book.asks)) for p, q in levels.items()]

    def feed(self, rows: pa.RecordBatch) -> pa.RecordBatch | None:
        self.key = rows.column("venue")[0].as_py(), rows.column("symbol")[0].as_py()
        points = rows.column("checkpoint").to_pylist()
        cells = _cells(rows, ("event_type", "order_id", "reference_order_id", "side", "price", "qty"))
        out, lo = [], 0
        while lo < len(points):
            if self.now is not None and points[lo] != self.now:
                out += self._levels()
            self.now, hi = points[lo], lo
            while hi < len(points) and points[hi] == self.now:
                hi += 1
            self.book.run(*(c[lo:hi] for c in cells))
            lo = hi
        return self._batch(out)

    def end(self) -> pa.RecordBatch:
        return self._batch(self._levels())

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int16(), pa.string(), pa.int64(), pa.int16(), pa.int64(), pa.int64())
        cells = zip(*rows) if rows else [[] for _ in types]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], [c.split()[0] for c in SNAPSHOT.split(", ")])


def numbered(events: DataFrame, every: int) -> DataFrame:
    """Adds checkpoint: 1 for the first `every` events of all, 2 for the next ones, and so on."""
    if every < 1:
        raise ValueError("every >= 1")
    ranked = global_rank(events, "arrival", [], "__rank")
    return ranked.withColumn("checkpoint", F.expr(f"(__rank + {every - 1}L) div {every}L")).drop("__rank")


def snapshots(points: DataFrame) -> DataFrame:
    """The engine's levels of every venue's symbol at each checkpoint of `points` (events with checkpoint) in whose interval it has events."""
    return walk(points.select(*NEEDED, "checkpoint"), ["venue", "symbol"], ["arrival"], SnapshotWalk, SNAPSHOT)


def level_changes(changes: DataFrame) -> DataFrame:
    """(venue, symbol, side, price, checkpoint, change): what the orders' effects add to a level in an interval; no order needed."""
    return changes.groupBy(*LEVEL, "checkpoint").agg(F.sum("delta").alias("change"))


def rebuilt(points: DataFrame, changes: DataFrame) -> DataFrame:
    """The same levels from the beginning, by sums over the orders' effects: a level's depth holds until its next change.

    A book's intervals with events are numbered, and a depth is put at each number until the next change of its level.
    """
    active = points.select("venue", "symbol", "checkpoint").distinct()
    active = active.withColumn("nth", F.row_number().over(Window.partitionBy("venue", "symbol").orderBy("checkpoint")))
    last = active.groupBy("venue", "symbol").agg(F.max("nth").alias("last"))
    moved = level_changes(changes).join(active, ["venue", "symbol", "checkpoint"])
    by = Window.partitionBy(*LEVEL).orderBy("nth")
    depth = F.sum("change").over(by.rowsBetween(Window.unboundedPreceding, 0))
    held = moved.withColumn("qty", depth).withColumn("until", F.lead("nth").over(by)).where("qty > 0").join(last, ["venue", "symbol"])
    stop = F.coalesce(F.col("until") - 1, F.col("last"))
    spread = held.select("venue", "symbol", "side", "price", "qty", F.explode(F.sequence("nth", stop)).alias("nth"))
    return spread.join(active, ["venue", "symbol", "nth"]).select("venue", "symbol", "checkpoint", "side", "price", "qty")


def replayed(live: DataFrame, points: DataFrame, changes: DataFrame) -> DataFrame:
    """The same levels by suffix replay: a book's snapshot before, and what the orders' effects add in the interval."""
    active = points.select("venue", "symbol", "checkpoint").distinct()
    onward = active.withColumn("next", F.lead("checkpoint").over(Window.partitionBy("venue", "symbol").orderBy("checkpoint"))).where("next IS NOT NULL")
    base = live.join(onward, ["venue", "symbol", "checkpoint"]).select("venue", "symbol", F.col("next").alias("checkpoint"), "side", "price", "qty")
    moved = level_changes(changes).select("venue", "symbol", "checkpoint", "side", "price", F.col("change").alias("qty"))
    return base.unionByName(moved).groupBy("venue", "symbol", "checkpoint", "side", "price").agg(F.sum("qty").alias("qty")).where("qty <> 0")


def checked(points: DataFrame, live: DataFrame | None = None, truth: DataFrame | None = None) -> DataFrame:
    """A row a checkpoint: books with events in its interval, their levels, and levels on which the live books differ.

    differences: against the books rebuilt from the beginning. new_differences: against the snapshot before with the interval replayed, so an
    error counts once, where it happens. `live` are levels to be checked (the engine's over `points`); `truth` are the events that
    the books are rebuilt from (`points`), with the same checkpoints.
    """
    live = stored(snapshots(points) if live is None else live, "book-snapshots")
    truth = points if truth is None else truth
    changes = stored(effects(truth), "book-effects")
    books = truth.groupBy("checkpoint").agg(F.count("*").alias("events"), F.count_distinct("venue", "symbol").alias("books"))
    key = ["venue", "symbol", "checkpoint", "side", "price"]

    def apart(other: DataFrame, name: str) -> DataFrame:
        met = live.withColumnRenamed("qty", "a").join(other.withColumnRenamed("qty", "b"), key, "full_outer")
        return met.groupBy("checkpoint").agg(F.count("a").alias(f"{name}_levels"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias(name))

    out = books.join(apart(rebuilt(truth, changes), "differences"), "checkpoint", "left").join(apart(replayed(live, truth, changes), "new_differences"), "checkpoint", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    return out.select("checkpoint", "events", "books", none("differences_levels").alias("levels"), none("differences").alias("differences"), none("new_differences").alias("new_differences"))
