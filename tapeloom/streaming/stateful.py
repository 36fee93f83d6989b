"""Live forms of the stateful operators: one state a key, kept in the state store between micro-batches.

Books lie in the state store by order and level (streaming.books). Any other operator is a class whose `row` takes one event and gives output
rows; its state is small. The batch operators use the same engines, so a replayed stream gives what the batch form gives. Rows of a micro-batch are put in order of arrival; an event that arrives in a
later micro-batch with a smaller arrival is applied when it comes.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeloom.operators.features import SECOND, VPIN_BUCKETS, VPIN_VOLUME, Recursions
from tapeloom.operators.sequence import Tracker
from tapeloom.schema import BUY, FEATURE_TRADES, SELL
from tapeloom.streaming.books import tops

STATE = "state binary"


def _run(events: DataFrame, keys: list[str], make, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        op = pickle.loads(state.get[0]) if state.exists else make()
        out = []
        for row in pd.concat(list(frames)).sort_values("arrival", kind="stable").to_dict("records"):
            out += op.row(row)
        state.update((pickle.dumps(op),))
        yield pd.DataFrame(out, columns=names)

    return events.groupBy(*keys).applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.NoTimeout)


class SequenceOp:
    def __init__(self, window: int):
        self.tracker, self.n = Tracker(window), 0

    def row(self, r) -> list[tuple]:
        _, _, out = self.tracker.observe(r["sequence"], r["arrival"])
        rows = [(r["venue"], self.n + k, a) for k, a in enumerate(out, 1)]
        self.n += len(out)
        return rows


def sequenced(events: DataFrame, window: int = 1024) -> DataFrame:
    """(venue, release, arrival): events in the order in which the venue's tracker releases them."""
    return _run(events, ["venue"], lambda: SequenceOp(window), "venue short, release long, arrival long")


class FeatureOp:
    """All features of one symbol from its venues' tops; what is kept is a top a venue, the window's flow and sums."""

    def __init__(self, window_ns: int, volume: int, buckets: int):
        self.window_ns, self.tops = window_ns, {}
        self.quote, self.flow, self.ofi = None, deque(), 0
        self.sums, self.mid, self.rec = [0, 0, 0, 0, 0], None, Recursions(volume, buckets)

    def row(self, r) -> list[tuple]:
        ahead = r["queue_ahead"]
        self.tops[r["venue"]] = tuple(None if pd.isna(r[c]) else int(r[c]) for c in ("bid_price", "bid_qty", "ask_price", "ask_qty"))
        bid = max(((t[0], -v, t[1]) for v, t in self.tops.items() if t[0] is not None), default=None)
        ask = min(((t[2], v, t[3]) for v, t in self.tops.items() if t[2] is not None), default=None)
        if not bid or not ask or not bid[0] or not ask[0]:
            return []
        bp, bq, ap, aq = bid[0], bid[2], ask[0], ask[2]
        step = 0
        if self.quote:
            pb, pbq, pa, paq = self.quote
            step += bq if bp > pb else -pbq if bp < pb else bq - pbq
            step += -aq if ap < pa else paq if ap > pa else paq - aq
        self.quote = bp, bq, ap, aq
        now = r["exchange_ts_ns"]
        self.flow.append((now, step))
        self.ofi += step
        while self.flow and now - self.flow[0][0] > self.window_ns:
            self.ofi -= self.flow.popleft()[1]
        trade, mid2 = r["event_type"] in FEATURE_TRADES, bp + ap
        if trade:
            x = r["qty"] if r["side"] == BUY else -r["qty"] if r["side"] == SELL else 0
            y = 0 if self.mid is None else mid2 - self.mid
            self.sums = [s + d for s, d in zip(self.sums, (1, x, y, x * x, x * y))]
        self.mid = mid2
        n, sx, sy, sxx, sxy = self.sums
        down = n * sxx - sx * sx
        spread, vpin = self.rec.step(trade, r["side"], r["qty"], r["price"], mid2 / 2)
        micro = (ap * bq + bp * aq) / (bq + aq) if bq + aq > 0 else mid2 / 2
        return [(r["arrival"], r["symbol"], now, bp, bq, ap, aq, micro, float(self.ofi), float(ahead), spread, (n * sxy - sx * sy) / down / 2 if down else 0.0, vpin)]


def features(events: DataFrame, window_ns: int = SECOND, volume: int = VPIN_VOLUME, buckets: int = VPIN_BUCKETS) -> DataFrame:
    schema = "arrival long, symbol string, exchange_ts_ns long, bid_price long, bid_qty long, ask_price long, ask_qty long, microprice double, ofi double, queue_ahead double, effective_spread double, kyle_lambda double, vpin double"
    quoted = tops(events, keep=["arrival", "venue", "symbol", "exchange_ts_ns", "event_type", "side", "qty", "price"])
    return _run(quoted, ["symbol"], lambda: FeatureOp(window_ns, volume, buckets), schema)


def arbitrated(copies: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first copy of each venue's sequence number. Numbers are forgotten after `delay` of event time."""
    timed = copies.withColumn("event_time", F.timestamp_micros((F.col("exchange_ts_ns") / 1000).cast("long"))).withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(["venue", "sequence"])


def journalled(events: DataFrame, paths: list[str], checkpoint: str):
    """A query that appends each micro-batch to every path as Parquet; a batch that is written again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for p in paths:
            batch.write.mode("overwrite").parquet(f"{p}/batch={number}")
        batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def wire_events(datagrams: DataFrame, protocol: str) -> DataFrame:
    """Canonical events of a stream (or table) of datagrams (arrival, ingest_ts_ns, payload) of one feed."""
    from tapeloom.sources.decode import LAYOUTS, decode
    from tapeloom.sources.files import framed

    return decode(framed(datagrams, protocol), LAYOUTS[protocol])
