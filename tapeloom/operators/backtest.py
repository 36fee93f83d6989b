"""Simulated trading of a strategy against a tape: matching, strategies and profit and loss.

Fills, quotes and positions of a symbol depend on that symbol alone, so each is walked once in order of arrival; the portfolio
curve is the running sum of the symbols' changes. Orders are numbered by symbol.
"""

from __future__ import annotations

import math
from bisect import insort
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tapeloom.functions.ranks import BUCKETS, last_before
from tapeloom.functions.stats import drawdown, sharpe
from tapeloom.operators import features as feat
from tapeloom.operators.book import with_tops
from tapeloom.operators.nbbo import consolidate
from tapeloom.operators.sequence import clock_filter
from tapeloom.operators.walks import Walker, walk
from tapeloom.schema import BUY, MATCHING_TRADES, SELL
from tapeloom.shared import stored


# -- matching -------------------------------------------------------------------------------------------------------
class Matching:
    """Resting orders filled by prints: a sell print fills bids at or above it, a buy print offers at or below it, at its price.

    A print fills at most a share of its quantity. Better prices come first, then earlier times, then lower numbers.
    """

    def __init__(self, cap: float = 0.25):
        self.cap, self.resting, self.orders = max(cap, 0.0), {BUY: [], SELL: []}, {}

    def submit(self, number: int, side: int, price: int, qty: int, ts: int) -> None:
        if number and qty:
            key = (-price if side == BUY else price, ts, number)
            self.orders[number] = [side, key, qty]
            insort(self.resting[side], key)

    def cancel(self, number: int) -> None:
        order = self.orders.pop(number, None)
        if order:
            self.resting[order[0]].remove(order[1])

    def event(self, kind: int, side: int, price: int, qty: int) -> list[tuple]:
        """Fills (number, side, price, qty, partial)."""
        if kind not in MATCHING_TRADES or side not in (BUY, SELL):
            return []
        budget, other, out = math.floor(qty * self.cap), SELL if side == BUY else BUY, []
        resting = self.resting[other]
        while budget > 0 and resting:
            key = resting[0]
            limit = -key[0] if other == BUY else key[0]
            if (limit < price) if other == BUY else (limit > price):
                break
            order = self.orders[key[2]]
            take = min(order[2], budget)
            order[2] -= take
            budget -= take
            out.append((key[2], other, price, take, order[2] > 0))
            if not order[2]:
                del self.orders[key[2]]
                resting.pop(0)
        return out


# -- strategies -----------------------------------------------------------------------------------------------------
class MarketMaker:
    """Quotes around the microprice, leaned by inventory and order flow; on a first view, a move of the centre, or after a fill."""

    def __init__(self, half_spread=1, size=10, max_inventory=1000, inventory_skew=0.0, ofi_skew=0.0, threshold=1, cooldown_ns=0):
        self.c = (half_spread, size, max_inventory, inventory_skew, ofi_skew, threshold, cooldown_ns)
        self.inventory, self.center, self.last_ts, self.live = 0, None, 0, {}

    def view(self, row: dict) -> tuple[list, list]:
        """Orders (side, price, qty) to send and numbers to cancel, on a row with features."""
        if row["microprice"] is None:
            return [], []
        half, size, most, skew, lean, threshold, cooldown = self.c
        held = max(-most, min(most, self.inventory))
        x = row["microprice"] - held * skew - row["ofi"] * lean
        center = math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)
        moved = self.center is None or abs(center - self.center) >= threshold
        if not moved or row["exchange_ts_ns"] < self.last_ts or row["exchange_ts_ns"] - self.last_ts < cooldown:
            return [], []
        self.center, self.last_ts, old = center, row["exchange_ts_ns"], list(self.live)
        self.live = {}
        return [(BUY, center - half, size), (SELL, center + half, size)], old

    def placed(self, number: int, side: int) -> None:
        self.live[number] = side

    def filled(self, number: int, side: int, qty: int, partial: bool) -> None:
        self.inventory += qty if side == BUY else -qty
        if not partial:
            self.live.pop(number, None)
        self.center = None


class OfiTaker:
    """Quotes around the middle of its own venue's book, moved to the offer or bid on strong order flow; at its limit it sells or buys back only."""

    def __init__(self, half_spread=1, size=10, max_position=200, threshold=100.0, offset=0, cooldown_events=0):
        self.c = (half_spread, size, max_position, threshold, offset, cooldown_events)
        self.inventory, self.quote, self.since, self.numbers = 0, None, 0, {BUY: 0, SELL: 0}

    def view(self, row: dict) -> tuple[list, list]:
        bid, ask = row["own_bid"], row["own_ask"]
        if bid is None or ask is None:
            return [], []
        half, size, most, threshold, offset, cooldown = self.c
        self.since += 1
        center = (bid + ask) // 2 if bid + ask >= 0 else -((-bid - ask) // 2)
        if row["ofi_events"] > threshold:
            center = max(center, ask)
        elif row["ofi_events"] < -threshold:
            center = min(center, bid)
        quote = {BUY: center - half, SELL: center + half}
        both = all(self.numbers.values())
        if both and (self.quote == quote or cooldown and self.since < cooldown):
            return [], []
        old = [n for n in self.numbers.values() if n]
        self.numbers, self.since = {BUY: 0, SELL: 0}, 0
        last = dict(self.quote or {BUY: 0, SELL: 0})
        if self.inventory >= most:
            orders = [(SELL, bid - offset, size)]
        elif self.inventory <= -most:
            orders = [(BUY, ask + offset, size)]
        else:
            orders = [(BUY, quote[BUY], size), (SELL, quote[SELL], size)]
        self.quote = last | {s: p for s, p, _ in orders}
        return orders, old

    def placed(self, number: int, side: int) -> None:
        self.numbers[side] = number

    def filled(self, number: int, side: int, qty: int, partial: bool) -> None:
        self.inventory += qty if side == BUY else -qty
        if not partial:
            self.numbers = {s: 0 if n == number else n for s, n in self.numbers.items()}


STRATEGIES = {"market_maker": MarketMaker, "ofi": OfiTaker}
TAKER_FEE, MAKER_REBATE = 0.0030, 0.0020


# -- profit and loss ------------------------------------------------------------------------------------------------
@dataclass
class Account:
    """Position at average cost. Strict equity is cash and the position at mid; compat equity is cash, realized and unrealized profit."""

    compat: bool = False
    position: int = 0
    cash: float = 0.0
    cost: float = 0.0
    realized: float = 0.0
    turnover: float = 0.0
    fees: float = 0.0
    rebates: float = 0.0
    mid: float | None = None

    def fill(self, side: int, price: float, qty: int, taker: bool) -> float:
        """Books a fill; the profit it realizes."""
        signed, before = qty if side == BUY else -qty, self.realized
        if self.position * signed >= 0:
            self.cost = (self.cost * abs(self.position) + price * qty) / (abs(self.position) + qty)
            self.position += signed
        else:
            closed = min(abs(self.position), qty)
            self.realized += (price - self.cost) * closed * (1 if self.position > 0 else -1)
            old, self.position = self.position, self.position + signed
            if self.position == 0:
                self.cost = 0.0
            elif (self.position > 0) != (old > 0) and (not self.compat or abs(self.position) > closed):
                self.cost = price
        self.cash -= price * signed
        self.turnover += price * qty
        self.fees += TAKER_FEE * qty * taker
        self.rebates += MAKER_REBATE * qty * (not taker)
        return self.realized - before

    @property
    def unrealized(self) -> float:
        return 0.0 if self.mid is None else (self.mid - self.cost) * self.position

    @property
    def equity(self) -> float:
        if self.compat:
            return self.cash + self.realized + self.unrealized
        return self.cash + (self.position * (self.mid if self.mid is not None else self.cost))


# -- runs -----------------------------------------------------------------------------------------------------------
@dataclass
class Config:
    strategy: str = "market_maker"
    options: dict = field(default_factory=dict)
    cap: float = 0.25
    compat: bool = False
    ofi_window_ns: int = feat.SECOND


INTENT = "struct<action:string,number:long,side:short,price:long,qty:long>"
FILL = "struct<number:long,side:short,price:long,qty:long,partial:boolean,taker:boolean,realized:double>"
TICKS = f"symbol string, arrival long, exchange_ts_ns long, submitted long, cancelled long, position long, cash double, realized double, unrealized double, turnover double, fees double, rebates double, equity double, intents array<{INTENT}>, fills array<{FILL}>"


def inputs(events: DataFrame, cfg: Config) -> DataFrame:
    """Per event: own venue's top, order flow of events, and microprice, flow and mid where the market is two-sided; late events are left out."""
    on_time = clock_filter(events).where("NOT rejected").drop("rejected")
    tops = with_tops(feat.event_ofi(on_time), keep=["arrival", "venue", "symbol", "exchange_ts_ns", "event_type", "side", "price", "qty", "ofi_events"])
    quotes = consolidate(tops.withColumn("own_bid", F.col("bid_price")).withColumn("own_ask", F.col("ask_price")))
    # Rows without both sides neither count nor move a feature: each stands in a group of its own, so one pass serves all rows.
    two = F.coalesce((F.col("bid_price") != 0) & (F.col("ask_price") != 0), F.lit(False))
    alone = F.concat("symbol", F.lit("\x00"), F.col("arrival").cast("string"))
    q = quotes.withColumn("__symbol", F.col("symbol")).withColumn("__two", two).withColumn("symbol", F.when(F.col("__two"), F.col("symbol")).otherwise(alone))
    q = q.withColumn("ofi_step", feat.ofi_delta())
    seen = {"ofi": feat.trailing_sum("ofi_step", cfg.ofi_window_ns).cast("double"), "microprice": feat.microprice(), "mid": feat.mid()}
    cells = ["arrival", "exchange_ts_ns", "event_type", "side", "price", "qty", "own_bid", "own_ask", "ofi_events", "bid_price", "ask_price"]
    return q.select(F.col("__symbol").alias("symbol"), *cells, *(F.when(F.col("__two"), c).alias(n) for n, c in seen.items()))


_FILL = pa.struct([("number", pa.int64()), ("side", pa.int16()), ("price", pa.int64()), ("qty", pa.int64()), ("partial", pa.bool_()), ("taker", pa.bool_()), ("realized", pa.float64())])
_INTENT = pa.struct([("action", pa.string()), ("number", pa.int64()), ("side", pa.int16()), ("price", pa.int64()), ("qty", pa.int64())])
_KINDS = [pa.string()] + [pa.int64()] * 5 + [pa.float64()] * 7 + [pa.list_(_INTENT), pa.list_(_FILL)]


class Trader(Walker):
    """One symbol's strategy, resting orders and account, batch by batch; of orders it keeps those that rest."""

    def __init__(self, cfg: Config):
        self.strategy, self.match, self.account = STRATEGIES[cfg.strategy](**cfg.options), Matching(cfg.cap), Account(cfg.compat)
        self.number, self.submitted, self.cancelled, self.takers, self.best = 0, 0, 0, {}, (None, None)

    def feed(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        out = [self._step(r) for r in rows.to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], [c.split()[0] for c in TICKS.split(", ")])

    def _step(self, r: dict) -> tuple:
        strategy, match, account, takers = self.strategy, self.match, self.account, self.takers
        if r["mid"] is not None:
            account.mid, self.best = r["mid"], (r["bid_price"], r["ask_price"])
        bid, ask = self.best
        orders, old = strategy.view(r)
        intents = []
        for n in old:
            match.cancel(n)
            takers.pop(n, None)
            self.cancelled += 1
            intents.append({"action": "cancel", "number": n, "side": None, "price": None, "qty": None})
        for side, price, qty in orders:
            self.number += 1
            self.submitted += 1
            intents.append({"action": "submit", "number": self.number, "side": side, "price": price, "qty": qty})
            takers[self.number] = ask is not None and price >= ask if side == BUY else bid is not None and price <= bid
            strategy.placed(self.number, side)
            match.submit(self.number, side, price, qty, r["exchange_ts_ns"])
        fills = []
        for n, side, price, qty, partial in match.event(r["event_type"], r["side"], r["price"], r["qty"]):
            taker = takers[n] if partial else takers.pop(n)
            gain = account.fill(side, float(price), qty, taker)
            strategy.filled(n, side, qty, partial)
            fills.append({"number": n, "side": side, "price": price, "qty": qty, "partial": partial, "taker": taker, "realized": gain})
        return (r["symbol"], r["arrival"], r["exchange_ts_ns"], self.submitted, self.cancelled, account.position, account.cash, account.realized, account.unrealized, account.turnover, account.fees, account.rebates, account.equity, intents, fills)


def simulate(events: DataFrame, cfg: Config | None = None) -> DataFrame:
    """A row an event and symbol, with the account after it and the fills it made."""
    cfg = cfg or Config()
    return walk(inputs(events, cfg), ["symbol"], ["arrival"], lambda: Trader(cfg), TICKS)


def fills(ticks: DataFrame) -> DataFrame:
    return ticks.select("symbol", "arrival", "exchange_ts_ns", F.explode("fills").alias("f")).select("symbol", "arrival", "exchange_ts_ns", "f.*")


def intents(ticks: DataFrame) -> DataFrame:
    """Orders sent and cancelled, in order of arrival and position."""
    return ticks.select("symbol", "arrival", "exchange_ts_ns", F.posexplode("intents").alias("nth", "i")).select("symbol", "arrival", "exchange_ts_ns", "nth", "i.*")


def output_hash(ticks: DataFrame) -> DataFrame:
    """Order-free checksum of what a run did: equal for equal runs, whatever the partitioning."""
    cells = [F.xxhash64("symbol", "arrival", F.lit(k), *c) for k, c in enumerate((["number", "price", "qty"], ["nth", "number", "price", "qty"]))]
    f = fills(ticks).select(cells[0].alias("h"))
    return f.union(intents(ticks).select(cells[1])).agg(F.bit_xor("h").alias("hash"), F.count("*").alias("items"))


def final_accounts(ticks: DataFrame) -> DataFrame:
    """The last row of each symbol."""
    cells = ("submitted", "cancelled", "position", "cash", "realized", "unrealized", "turnover", "fees", "rebates", "equity")
    return ticks.groupBy("symbol").agg(F.max_by(F.struct(*cells), "arrival").alias("a"), F.sum(F.size("fills")).alias("fills")).select("symbol", "a.*", "fills")


def equity_curve(ticks: DataFrame) -> DataFrame:
    """(arrival, exchange_ts_ns, equity): the symbols' equities added up after every event.

    Each symbol's changes are summed over ranges of arrival first, so no task holds the whole tape. The changes are stored, as the
    curve reads them more than once and whoever reads the curve would trade the tape anew each time.
    """
    change = F.col("equity") - F.coalesce(F.lag("equity").over(Window.partitionBy("symbol").orderBy("arrival")), F.lit(0.0))
    steps = ticks.withColumn("change", change).groupBy("arrival").agg(F.sum("change").alias("change"), F.max("exchange_ts_ns").alias("exchange_ts_ns"))
    steps = stored(steps, "equity-steps")
    span = steps.agg(F.min("arrival").alias("lo"), F.max("arrival").alias("hi"))
    steps = steps.join(F.broadcast(span)).withColumn("part", F.floor((F.col("arrival") - F.col("lo")) / ((F.col("hi") - F.col("lo") + 1) / F.lit(float(BUCKETS)))))
    ahead = steps.groupBy("part").agg(F.sum("change").alias("s"))
    ahead = ahead.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("ahead"))
    inside = F.sum("change").over(Window.partitionBy("part").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0))
    return steps.join(ahead, "part").select("arrival", "exchange_ts_ns", (F.col("ahead") + inside).alias("equity"))


def bucket_returns(curve: DataFrame, bucket_ns: int = feat.SECOND) -> DataFrame:
    """(bucket, equity, r): equity at the first tick of each bucket of time, and its change from the bucket before that has ticks."""
    first = curve.groupBy(F.floor(F.col("exchange_ts_ns") / bucket_ns).alias("bucket")).agg(F.min_by("equity", "arrival").alias("equity"))
    was = last_before(stored(first, "bucket-equity"), "bucket", "equity", "__was")
    return was.select("bucket", "equity", (F.col("equity") - F.col("__was")).alias("r"))


def report(ticks: DataFrame, bucket_ns: int = feat.SECOND) -> DataFrame:
    """One row: orders, fills, ratios, profit and loss, fees, drawdown (from a peak of 0 or more) and Sharpe ratio."""
    total = final_accounts(ticks).agg(*(F.sum(c).alias(c) for c in ("submitted", "cancelled", "fills", "realized", "unrealized", "turnover", "fees", "rebates")), F.sum(F.col("equity") - F.col("fees") + F.col("rebates")).alias("equity"))
    curve = equity_curve(ticks)
    from_zero = curve.select("arrival", "equity").union(curve.agg(F.min("arrival") - 1, F.lit(0.0)))
    r = bucket_returns(curve, bucket_ns).agg(sharpe(F.col("r")).alias("sharpe"))
    ratio = F.when(F.col("submitted") > 0, F.col("fills") / F.nullif(F.col("submitted"), F.lit(0))).otherwise(0.0)
    return total.withColumn("fill_ratio", ratio).join(drawdown(from_zero, "arrival")).join(r)


def holdout(events: DataFrame, share: float) -> DataFrame:
    """Events of the last share of the tape's time."""
    t = events.agg(F.min("exchange_ts_ns").alias("lo"), F.max("exchange_ts_ns").alias("hi"))
    start = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) * F.lit(1 - share)).cast("long")
    return events.join(F.broadcast(t.select(start.alias("__start")))).where("exchange_ts_ns >= __start").drop("__start")
