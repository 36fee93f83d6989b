"""Microstructure features per symbol, in order of arrival.

Everything that a window can express is one: a feature is a column, and all of them share one shuffle and sort by symbol. VPIN and the
exponential mean are recursions; they walk each symbol once.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tapeloom.operators.walks import Walker, walk
from tapeloom.schema import BUY, FEATURE_TRADES, SELL

SECOND = 1_000_000_000
VPIN_VOLUME, VPIN_BUCKETS, VPIN_RING = 10_000, 32, 64
EMA_KEEP = 0.95


def two_sided(quotes: DataFrame) -> DataFrame:
    """Rows with both sides present and not 0; others neither count nor move any state."""
    return quotes.where("bid_price IS NOT NULL AND ask_price IS NOT NULL AND bid_price <> 0 AND ask_price <> 0")


def by_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("arrival")


def mid() -> Column:
    return (F.col("bid_price") + F.col("ask_price")) / 2.0


def microprice() -> Column:
    size = F.col("bid_qty") + F.col("ask_qty")
    return F.when(size > 0, (F.col("ask_price") * F.col("bid_qty") + F.col("bid_price") * F.col("ask_qty")) / F.nullif(size, F.lit(0)).cast("double")).otherwise(mid())


def ofi_delta() -> Column:
    """Order-flow imbalance of a quote against the symbol's quote before; 0 for the first."""
    w = by_symbol()
    was = {c: F.lag(c).over(w) for c in ("bid_price", "bid_qty", "ask_price", "ask_qty")}
    bid = F.when(F.col("bid_price") > was["bid_price"], F.col("bid_qty")).when(F.col("bid_price") < was["bid_price"], -was["bid_qty"]).otherwise(F.col("bid_qty") - was["bid_qty"])
    ask = F.when(F.col("ask_price") < was["ask_price"], -F.col("ask_qty")).when(F.col("ask_price") > was["ask_price"], was["ask_qty"]).otherwise(was["ask_qty"] - F.col("ask_qty"))
    return F.coalesce(bid + ask, F.lit(0).cast("long"))


def trailing_sum(value: str, window_ns: int) -> Column:
    """Sum over rows up to this one in arrival order whose time is within the window, its edge included.

    A RANGE frame would add later rows of the same time, so it is the running sum less the sum of what is too old.
    """
    upto = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    old = Window.partitionBy("symbol").orderBy("exchange_ts_ns").rangeBetween(Window.unboundedPreceding, -(window_ns + 1))
    return F.sum(value).over(upto) - F.coalesce(F.sum(value).over(old), F.lit(0))


def is_trade() -> Column:
    return F.col("event_type").isin(*FEATURE_TRADES)


def signed_qty() -> Column:
    return F.when(F.col("side") == BUY, F.col("qty")).when(F.col("side") == SELL, -F.col("qty")).otherwise(0)


def with_kyle(quotes: DataFrame) -> DataFrame:
    """Adds kyle_lambda: the slope of mid changes on signed trade quantities over all trades so far, 0 while there is none.

    Doubled mid changes and quantities are whole numbers, so the sums are exact whatever their order.
    """
    w = by_symbol()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    q = quotes.withColumn("kl_mid", F.col("bid_price") + F.col("ask_price"))
    q = q.withColumn("kl_y", F.when(is_trade(), F.coalesce(F.col("kl_mid") - F.lag("kl_mid").over(w), F.lit(0).cast("long")))).withColumn("kl_x", F.when(is_trade(), signed_qty()))
    n, x, y, xx, xy = (c.over(upto).cast("double") for c in (F.count("kl_x"), F.sum("kl_x"), F.sum("kl_y"), F.sum(F.col("kl_x") * F.col("kl_x")), F.sum(F.col("kl_x") * F.col("kl_y"))))
    down = n * xx - x * x
    slope = F.when(F.abs(down) > 1e-12, (n * xy - x * y) / F.nullif(down, F.lit(0.0)) / 2.0)
    return q.withColumn("kyle_lambda", F.coalesce(slope, F.lit(0.0))).drop("kl_mid", "kl_x", "kl_y")


class Recursions:
    """Effective-spread mean and VPIN of one symbol."""

    def __init__(self, volume: int = VPIN_VOLUME, buckets: int = VPIN_BUCKETS):
        self.volume, self.most = volume, min(buckets, VPIN_RING)
        self.ema, self.buy, self.sell, self.full = None, 0, 0, []

    def step(self, trade: bool, side: int, qty: int, price: int, mid: float) -> tuple[float, float]:
        if trade:
            spread = 2.0 * abs(price - mid)
            self.ema = spread if self.ema is None else EMA_KEEP * self.ema + (1 - EMA_KEEP) * spread
            if side == BUY:
                self.buy += qty
            elif side == SELL:
                self.sell += qty
            while self.buy + self.sell >= self.volume:
                self.full = [*self.full, abs(self.buy - self.sell) / self.volume][-self.most :]
                # What is left over stays on the buy side if the buys exceed it, else nothing does; sells keep what the buys leave.
                over = self.buy + self.sell - self.volume
                self.buy = over if self.buy > over else 0
                self.sell = over - self.buy if self.sell > self.buy else 0
        return self.ema or 0.0, sum(self.full) / len(self.full) if self.full else 0.0


class RecursionWalk(Walker):
    """One symbol's recursions; only trades change them."""

    def __init__(self, volume: int, buckets: int):
        self.state, self.now = Recursions(volume, buckets), (0.0, 0.0)

    def feed(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        trades = np.isin(rows.column("event_type").to_numpy(zero_copy_only=False), FEATURE_TRADES)
        at = np.nonzero(trades)[0]
        some = rows.take(pa.array(at))
        cells = (some.column(c).to_pylist() for c in ("side", "qty", "price", "bid_price", "ask_price"))
        known = [self.now, *(self.state.step(True, side, qty, price, 0.5 * (bid + ask)) for side, qty, price, bid, ask in zip(*cells))]
        self.now = known[-1]
        values = np.array(known)[np.cumsum(trades)]
        out = [pa.array(values[:, k], pa.float64()) for k in range(2)]
        return pa.RecordBatch.from_arrays([*rows.columns, *out], [*rows.schema.names, "effective_spread", "vpin"])


def with_recursions(quotes: DataFrame, volume: int = VPIN_VOLUME, buckets: int = VPIN_BUCKETS) -> DataFrame:
    """Adds effective_spread and vpin."""
    types = ", ".join(f"{n} {t}" for n, t in quotes.dtypes)
    return walk(quotes, ["symbol"], ["arrival"], partial(RecursionWalk, volume, buckets), f"{types}, effective_spread double, vpin double")


def ema(value: Column) -> Column:
    """The effective-spread mean in SQL, for symbols whose trades fit an array: a fold over the trades so far."""
    so_far = F.collect_list(value).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(F.aggregate(so_far, F.lit(None).cast("double"), lambda a, v: F.when(a.isNull(), v).otherwise(EMA_KEEP * a + (1 - EMA_KEEP) * v)), F.lit(0.0))


def features(quotes: DataFrame, window_ns: int = SECOND, volume: int = VPIN_VOLUME, buckets: int = VPIN_BUCKETS) -> DataFrame:
    """Feature rows: one for every event of a symbol with a two-sided best bid and offer."""
    q = two_sided(quotes).withColumn("ofi_step", ofi_delta())
    q = with_kyle(q.withColumn("ofi", trailing_sum("ofi_step", window_ns).cast("double")).withColumn("microprice", microprice()))
    return with_recursions(q, volume, buckets).select(
        "arrival", "symbol", "exchange_ts_ns", "ingest_ts_ns", "venue", "event_type", "side", "qty", "price",
        "bid_price", "bid_qty", "ask_price", "ask_qty", "microprice", "ofi", F.col("queue_ahead").cast("double").alias("queue_ahead"), "effective_spread", "kyle_lambda", "vpin",
    )


def event_ofi(events: DataFrame, most: int = 128, window_ns: int | None = None) -> DataFrame:
    """Imbalance of raw events: each event with a side and a price against the last of its side; the sum of the last `most` events, within the window."""
    w = by_symbol()
    out = events
    for side, up in ((BUY, 1), (SELL, -1)):
        quotes = F.when((F.col("side") == side) & (F.col("price") > 0), F.struct("price", "qty"))
        was = F.last(quotes, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        better = F.col("price") - F.col("was.price")  # for offers, too: the rule is the bids' with its sign turned
        step = F.when(F.col("was").isNull() | (better > 0), F.col("qty")).when(better == 0, F.col("qty") - F.col("was.qty")).otherwise(-F.col("was.qty"))
        out = out.withColumn("was", was).withColumn(f"step_{side}", F.when(quotes.isNotNull(), step * up).otherwise(0)).drop("was")
    out = out.withColumn("ofi_step", F.col(f"step_{BUY}") + F.col(f"step_{SELL}"))
    frame = w.rowsBetween(-(most - 1), 0)
    if window_ns is None:
        total = F.sum("ofi_step").over(frame)
    else:
        inside = F.collect_list(F.struct("exchange_ts_ns", "ofi_step")).over(frame)
        total = F.aggregate(F.filter(inside, lambda p: p["exchange_ts_ns"] >= F.col("exchange_ts_ns") - window_ns), F.lit(0).cast("long"), lambda a, p: a + p["ofi_step"])
    return out.withColumn("ofi_events", total).drop(f"step_{BUY}", f"step_{SELL}")
