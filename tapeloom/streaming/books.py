"""Live order books: an order and a level are entries of the state store of their own, and idle books are evicted by timers.

A micro-batch reads the orders that it touches and a book's levels, and writes what it changed, so its cost goes with its events and the
depth of a book, not with the orders that are live. Books are kept by venue and symbol, and by feed side too where the events have one.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.operators.book import TOP, StrictBook
from tapeloom.schema import REPLACE

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CELLS = ["event_type", "order_id", "reference_order_id", "side", "price", "qty"]
TOP_NAMES = [c.split()[0] for c in TOP.split(", ")]


class BookState(StatefulProcessor):
    """One book. `keep` are the events' columns that go on to the result."""

    def __init__(self, keep: list[str], idle_ms: int | None = None):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.orders = handle.getMapState("orders", "order_id long", "side int, price long, left long")
        self.levels = handle.getMapState("levels", "side int, price long", "qty long")
        self.timer = handle.getValueState("timer", "at long")

    def _book(self, ids: set[int]) -> tuple[StrictBook, dict, dict]:
        book = StrictBook()
        for k in ids:
            if self.orders.containsKey((k,)):
                book.orders[k] = tuple(map(int, self.orders.getValue((k,))))
        if self.levels.exists():
            for (side, price), (qty,) in self.levels.iterator():
                (book.asks if side else book.bids)[int(price)] = int(qty)
        book.bid_heap, book.ask_heap = [-p for p in book.bids], list(book.asks)
        heapify(book.bid_heap)
        heapify(book.ask_heap)
        best = (-book.bid_heap[0] if book.bid_heap else None), (book.ask_heap[0] if book.ask_heap else None)
        book.top = best[0], book.bids.get(best[0]), best[1], book.asks.get(best[1])
        return book, dict(book.orders), {0: dict(book.bids), 1: dict(book.asks)}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        cells = [events[c].tolist() for c in CELLS]
        ids = {k for kind, *both in zip(cells[0], cells[1], cells[2]) if kind <= REPLACE for k in both if k}
        book, orders, levels = self._book(ids)
        out = book.run(*cells)
        for k in ids:
            now = book.orders.get(k)
            if now is None and k in orders:
                self.orders.removeKey((k,))
            elif now is not None and now != orders.get(k):
                self.orders.updateValue((k,), now)
        for side, now in enumerate((book.bids, book.asks)):
            for price in levels[side].keys() - now.keys():
                self.levels.removeKey((side, price))
            for price, qty in now.items():
                if levels[side].get(price) != qty:
                    self.levels.updateValue((side, price), (qty,))
        if self.idle_ms is not None:
            self._wait(int(events["exchange_ts_ns"].max()) // 1_000_000 + self.idle_ms)
        found = events[self.keep].reset_index(drop=True)
        for name, values in zip(TOP_NAMES, out):
            found[name] = pd.array(values, "boolean" if name == "changed_top" else "Int64")
        yield found

    def _wait(self, at: int) -> None:
        if self.timer.exists():
            old = int(self.timer.get()[0])
            if old >= at:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No event of the book for idle_ms of event time: its orders and levels go."""
        self.orders.clear()
        self.levels.clear()
        self.timer.clear()
        return iter([])

    def close(self) -> None:
        pass


def tops(events: DataFrame, keep: list[str] | None = None, idle: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Best bid and offer of a book after every event, with the columns `keep` of the events (arrival, venue, symbol, and feed where it is).

    With `idle` (an interval of event time) a book without events for so long is forgotten; `delay` is how late events may be.
    """
    spark: SparkSession = events.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)  # maps and timers need it
    keys = [c for c in ("feed", "venue", "symbol") if c in events.columns]
    keep = list(keep or ["arrival", *keys])
    idle_ms = None
    if idle is not None:
        idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
        events = events.withColumn("event_time", F.timestamp_micros(F.expr("exchange_ts_ns div 1000"))).withWatermark("event_time", delay)
    types = ", ".join(f"{n} {t}" for n, t in events.select(*keep).dtypes)
    return events.groupBy(*keys).transformWithStateInPandas(BookState(keep, idle_ms), f"{types}, {TOP}", "append", "None" if idle is None else "EventTime")
