"""The canonical event row and its codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Codes of venues, sides and event types.
VENUES = {"NASDAQ": 0, "IEX": 1, "CBOE": 2, "CME": 3, "BITFINEX": 4}
BUY, SELL, UNKNOWN_SIDE = 0, 1, 2
ADD, ADD_MPID, EXECUTE, EXECUTE_PRICE, CANCEL, DELETE, REPLACE, TRADE, CROSS_TRADE, IMBALANCE, SYSTEM, DIRECTORY = range(12)
UNKNOWN_TYPE = 255
TYPE_NAMES = ("Add", "AddMpid", "Execute", "ExecutePrice", "Cancel", "Delete", "Replace", "Trade", "CrossTrade", "Imbalance", "System", "StockDirectory")

BOOK_TYPES = (ADD, ADD_MPID, EXECUTE, EXECUTE_PRICE, CANCEL, DELETE, REPLACE)
FEATURE_TRADES = (TRADE, CROSS_TRADE)
MATCHING_TRADES = (TRADE, EXECUTE_PRICE, CROSS_TRADE)
U32 = (1 << 32) - 1

BOOK_EVENTS = T.StructType(
    [
        T.StructField("arrival", T.LongType()),
        T.StructField("venue", T.ShortType()),
        T.StructField("event_type", T.ShortType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("exchange_ts_ns", T.LongType()),
        T.StructField("ingest_ts_ns", T.LongType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("match_id", T.LongType()),
        T.StructField("reference_order_id", T.LongType()),
        T.StructField("qty", T.LongType()),
        T.StructField("price", T.LongType()),
        T.StructField("prev_qty", T.LongType()),
        T.StructField("prev_price", T.LongType()),
        T.StructField("side", T.ShortType()),
        T.StructField("mpid", T.StringType()),
        T.StructField("raw_type", T.ShortType()),
    ]
)
COLUMNS = BOOK_EVENTS.fieldNames()
NBBO_EVENTS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("arrival", "exchange_ts_ns", "ingest_ts_ns")]
    + [T.StructField("symbol", T.StringType()), T.StructField("venue", T.ShortType())]
    + [T.StructField(n, T.LongType()) for n in ("sequence", "bid_price", "bid_qty", "ask_price", "ask_qty")]
    + [T.StructField("bid_venue", T.ShortType()), T.StructField("ask_venue", T.ShortType())]
)


def canonical(**columns: Column | str) -> list[Column]:
    """A select list in schema order; what is not named is 0, an empty mpid null, an unknown side 2."""
    blank = {"side": F.lit(UNKNOWN_SIDE), "mpid": F.lit(None), "symbol": F.lit("")}
    out = []
    for f in BOOK_EVENTS:
        c = columns.get(f.name, blank.get(f.name, F.lit(0)))
        out.append((F.col(c) if isinstance(c, str) else c).cast(f.dataType).alias(f.name))
    return out


def type_name(column: str = "event_type") -> Column:
    names = F.create_map(*(F.lit(x) for k, n in enumerate(TYPE_NAMES) for x in (k, n)))
    return F.coalesce(F.element_at(names, F.col(column).cast("int")), F.lit("Unknown"))
