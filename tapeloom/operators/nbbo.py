"""Consolidated best bid and offer over venues, its changes, and as-of lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tapeloom.operators.book import with_tops
from tapeloom.schema import VENUES

N_VENUES = len(VENUES)
BBO = ("bid_price", "bid_qty", "bid_venue", "ask_price", "ask_qty", "ask_venue")
SEQUENCES = ("bid_venue_sequence", "ask_venue_sequence")


def consolidate(tops: DataFrame, sequences: bool = False) -> DataFrame:
    """Every event of a symbol with the best of all venues' latest tops; ties go to the lower venue. Crossed markets are left as they are.

    With `sequences`, also the number of the message that gave each side's venue its top.

    Five forward fills over one window, so one shuffle by symbol; prices and venues are packed into one number to take a maximum of.
    """
    symbol = Window.partitionBy("symbol").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    own = F.struct("bid_price", "bid_qty", "ask_price", "ask_qty", *(["sequence"] if sequences else []))
    filled = tops.select("*", *(F.last(F.when(F.col("venue") == v, own), ignorenulls=True).over(symbol).alias(f"v{v}") for v in range(N_VENUES)))
    bid = F.greatest(*(F.col(f"v{v}.bid_price") * 8 + (7 - v) for v in range(N_VENUES)))
    ask = F.least(*(F.col(f"v{v}.ask_price") * 8 + v for v in range(N_VENUES)))
    filled = filled.withColumn("b", bid).withColumn("a", ask).withColumn("bid_venue", (7 - F.col("b") % 8).cast("short")).withColumn("ask_venue", (F.col("a") % 8).cast("short"))

    def of(venue: str, field: str):
        out = F.lit(None)
        for v in range(N_VENUES):
            out = F.when(F.col(venue) == v, F.col(f"v{v}.{field}")).otherwise(out)
        return out

    keep = [c for c in tops.columns if c not in ("bid_price", "bid_qty", "ask_price", "ask_qty")]
    told = [of(f"{side}_venue", "sequence").alias(f"{side}_venue_sequence") for side in ("bid", "ask")] if sequences else []
    return filled.select(*keep, *told, F.expr("b div 8").alias("bid_price"), of("bid_venue", "bid_qty").alias("bid_qty"), "bid_venue", F.expr("a div 8").alias("ask_price"), of("ask_venue", "ask_qty").alias("ask_qty"), "ask_venue")


def nbbo(events: DataFrame, compat: bool = False, keep: list[str] | None = None) -> DataFrame:
    """`keep` names the events' columns that are wanted after it; arrival, venue and symbol must be among them."""
    return consolidate(with_tops(events, compat, keep))


def changes(quotes: DataFrame, fields: tuple = BBO) -> DataFrame:
    """Rows whose best bid or offer differs from the symbol's row before, nulls equal to each other."""
    before = F.lag(F.struct(*fields)).over(Window.partitionBy("symbol").orderBy("arrival"))
    return quotes.withColumn("was", before).where(F.col("was").isNull() | ~F.col("was").eqNullSafe(F.struct(*fields))).where("was IS NOT NULL OR bid_price IS NOT NULL OR ask_price IS NOT NULL").drop("was")


def journal(events: DataFrame) -> DataFrame:
    """Changes of the best bid and offer among events that changed their venue's top."""
    return changes(nbbo(events).where("changed_top"))


def provenance(events: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The journal with the venues' message numbers: a row where any of the ten fields differs from the row before."""
    columns = list(dict.fromkeys([*(keep or events.columns), "arrival", "venue", "symbol", "sequence"]))
    moved = with_tops(events, keep=columns).where("changed_top")
    return changes(consolidate(moved, sequences=True), (*BBO, *SEQUENCES))


def asof(left: DataFrame, right: DataFrame, values: list[str], by: str = "symbol", at: str = "ts", right_at: str = "exchange_ts_ns", order: str = "arrival") -> DataFrame:
    """left (by, at, ...) with `values` of the right row of the largest time not after `at`; of rows of one time the first wins.

    A union and one forward fill: one shuffle by key, no range join. `found` is false where there is none.
    """
    first = Window.partitionBy(by, right_at).orderBy(order)
    r = right.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    value = F.struct(*values, F.col(right_at).alias("__at"))
    both = r.select(F.col(by), F.col(right_at).alias(at), F.lit(0).alias("__side"), value.alias("__value"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__left"))
    both = both.unionByName(left.select(by, at, F.lit(1).alias("__side"), F.lit(None).cast(both.schema["__value"].dataType).alias("__value"), F.struct("*").alias("__left")))
    fill = Window.partitionBy(by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    done = both.withColumn("__value", F.last("__value", ignorenulls=True).over(fill)).where("__side = 1")
    return done.select("__left.*", *(F.col(f"__value.{v}").alias(v) for v in values), F.col("__value.__at").alias("quote_ts"), F.col("__value").isNotNull().alias("found"))


def asof_point(quotes: DataFrame, symbol: str, ts: int) -> DataFrame:
    """The one row in force at a time: a filter that reaches the scan and a top-1."""
    return quotes.where((F.col("symbol") == symbol) & (F.col("exchange_ts_ns") <= ts)).orderBy(F.desc("exchange_ts_ns"), "arrival").limit(1)
