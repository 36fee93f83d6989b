"""Deterministic tapes from row numbers: expressions over spark.range, so any size is made in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.schema import ADD, BUY, CANCEL, DELETE, EXECUTE, REPLACE, SELL, TRADE, UNKNOWN_SIDE, canonical

# The symbols of the research tape.
SYMBOLS = ("AAPL0001", "MSFT0002", "NVDA0003", "AMZN0004", "GOOG0005", "META0006", "TSLA0007", "AMD00008")


def _pick(index, values):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def research_tape(spark: SparkSession, n: int, symbols: int = 1) -> DataFrame:
    """Cycles of six steps: a bid, an offer, a sell print at the bid, a buy print at the offer, and both orders deleted.

    A symbol's orders have ids of their own, so tapes of several symbols stay apart.
    """
    symbols = min(max(symbols, 1), len(SYMBOLS))
    i, slot = F.col("id"), F.col("id") % symbols
    cycle, step = F.floor(i / (symbols * 6)), F.floor(i / symbols) % 6
    mid = 10_000 + cycle % 97
    buys = step.isin(0, 3, 4)
    price = F.when(step.isin(0, 2), mid - 1).when(step.isin(1, 3), mid + 1).otherwise(0)
    side = F.when(step.isin(4, 5), UNKNOWN_SIDE).when(buys, BUY).otherwise(SELL)
    order_id = F.when(step.isin(2, 3), 0).otherwise((cycle * 2 + F.when(step.isin(0, 4), 1).otherwise(2)) * len(SYMBOLS) + slot)
    return spark.range(n).select(
        *canonical(arrival=i, venue=F.lit(0), event_type=_pick(step, (ADD, ADD, TRADE, TRADE, DELETE, DELETE)), sequence=i + 1, exchange_ts_ns=i + 1, ingest_ts_ns=i + 1001, symbol=_pick(slot, SYMBOLS), order_id=order_id, qty=F.when(step >= 4, 0).otherwise(100), price=price, side=side, raw_type=F.lit(65) + step)
    )


def lifecycle_tape(spark: SparkSession, n: int, symbols: int = 8, venues: int = 3) -> DataFrame:
    """Cycles of five steps: a bid, an offer, an execution, a cancel and a replace, dealt over venues."""
    i = F.col("id")
    slot, cycle, step = i % symbols, F.floor(i / (symbols * 5)), F.floor(i / symbols) % 5
    base, price = 100_000_000 + cycle * 1000 + slot * 10, 10_000 + (cycle + slot) % 64
    order_id = base + _pick(step, (1, 2, 1, 2, 3))
    return spark.range(n).select(
        *canonical(
            arrival=i, venue=slot % venues, event_type=_pick(step, (ADD, ADD, EXECUTE, CANCEL, REPLACE)), sequence=F.floor(i / symbols) * F.ceil((F.lit(symbols) - slot % venues) / F.lit(venues)) + F.floor(slot / venues) + 1, exchange_ts_ns=i + 1, ingest_ts_ns=i + 1001, symbol=F.concat(F.lit("SY"), slot.cast("string")),
            order_id=order_id, reference_order_id=F.when(step == 4, base + 1).otherwise(0), qty=_pick(step, (100, 120, 40, 30, 50)), price=F.when(step == 0, price).when(step == 1, price + 20).when(step == 4, price + 1).otherwise(0), side=_pick(step, (BUY, SELL, UNKNOWN_SIDE, UNKNOWN_SIDE, BUY)), raw_type=F.lit(65) + step,
        )
    )


def dual_feed(events: DataFrame, loss_a: float, loss_b: float, seed: int = 1) -> DataFrame:
    """Feeds A and B of a tape, each losing events on its own; the draw is a hash of venue and sequence, so it repeats."""
    out = None
    for k, (feed, loss) in enumerate((("A", loss_a), ("B", loss_b))):
        draw = F.pmod(F.xxhash64("venue", "sequence", F.lit(seed), F.lit(feed)), F.lit(1_000_000)) / 1e6
        part = events.where(draw >= loss).withColumn("feed", F.lit(feed)).withColumn("arrival", F.col("arrival") * 2 + (F.lit(k) + F.col("sequence")) % 2)
        out = part if out is None else out.unionByName(part)
    return out
