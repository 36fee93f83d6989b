"""The replay service's requests as DataFrame queries."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, functions as F

from tapeloom import __version__
from tapeloom.operators.nbbo import asof_point
from tapeloom.schema import UNKNOWN_TYPE


def in_window(start_ns: int = 0, end_ns: int = 0, column: str = "exchange_ts_ns") -> Column:
    """Both ends included; 0 leaves an end open."""
    out = F.lit(True)
    if start_ns:
        out = out & (F.col(column) >= start_ns)
    if end_ns:
        out = out & (F.col(column) <= end_ns)
    return out


def _range(df: DataFrame, symbol: str, start_ns: int, end_ns: int, limit: int) -> DataFrame:
    if symbol:
        df = df.where(F.rtrim("symbol") == symbol.strip())
    df = df.where(in_window(start_ns, end_ns))
    return df.orderBy("arrival").limit(limit) if limit else df


def stream_ticks(events: DataFrame, symbol: str = "", start_ns: int = 0, end_ns: int = 0, limit: int = 0) -> DataFrame:
    """Events of a symbol (empty: all) in a time range, the first `limit` by arrival (0: all)."""
    return _range(events, symbol, start_ns, end_ns, limit)


def stream_nbbo(quotes: DataFrame, symbol: str = "", start_ns: int = 0, end_ns: int = 0, limit: int = 0) -> DataFrame:
    return _range(quotes, symbol, start_ns, end_ns, limit)


def scan_status(scanned: DataFrame) -> DataFrame:
    """One row, code, reason and bad: how a permissive scan (arrival, status) ended. OK, or DATA_LOSS with the first damage's reason and how many records are bad."""
    bad = F.col("status") != "ok"
    lost = scanned.agg(F.min_by("status", F.when(bad, F.col("arrival"))).alias("reason"), F.count_if(bad).alias("bad"))
    return lost.select(F.when(F.col("bad") > 0, "DATA_LOSS").otherwise("OK").alias("code"), F.when(F.col("bad") > 0, F.col("reason")).alias("reason"), "bad")


def query_nbbo(quotes: DataFrame, symbol: str, ts_ns: int) -> dict:
    """The quote in force at a time, with found."""
    row = asof_point(quotes, symbol, ts_ns).first()
    return {"found": row is not None, **(row.asDict() if row else {})}


def store_stats(events: DataFrame) -> DataFrame:
    t = F.col("exchange_ts_ns")
    return events.agg(F.count("*").alias("records"), F.min(t).alias("min_ts"), F.max(t).alias("max_ts"), F.min_by(t, "arrival").alias("first_ts"), F.max_by(t, "arrival").alias("last_ts"))


def health(events: DataFrame, quotes: DataFrame) -> DataFrame:
    e = events.agg(F.count("*").alias("book_records"), F.countDistinct("symbol").alias("symbols"))
    return e.join(quotes.agg(F.count("*").alias("nbbo_records"))).select(F.lit("SERVING").alias("status"), "book_records", "nbbo_records", "symbols")


def decode(events: DataFrame) -> DataFrame:
    """What a client gets: trimmed symbol, whether there is an mpid, unknown types as they are."""
    return events.withColumn("symbol", F.rtrim("symbol")).withColumn("has_mpid", F.col("mpid").isNotNull()).withColumn("known_type", F.col("event_type") != UNKNOWN_TYPE)


MODE = "replay queries over recorded market data; no live exchange"


class Catalog:
    """The tables that a session serves, as views; the quotes are cached as they are asked for at random."""

    def __init__(self, events: DataFrame, quotes: DataFrame, book_path: str = "", nbbo_path: str = ""):
        self.began, self.paths = time.monotonic(), {"book_journal_path": book_path, "nbbo_journal_path": nbbo_path}
        self.events, self.quotes = events, quotes.cache()
        events.createOrReplaceTempView("book_events")
        self.quotes.createOrReplaceTempView("nbbo_events")

    def health(self) -> dict:
        """Counts, the journals' paths, seconds since the catalog was made, build and mode."""
        served = {"uptime_seconds": time.monotonic() - self.began, "build_id": f"tapeloom-{__version__}", "service_mode": MODE}
        return health(self.events, self.quotes).first().asDict() | self.paths | served

    def close(self) -> None:
        self.quotes.unpersist()

    def nbbo(self, symbol: str, ts_ns: int) -> dict:
        return query_nbbo(self.quotes, symbol, ts_ns)

    def ticks(self, *args, **kwargs):
        return stream_ticks(self.events, *args, **kwargs).toLocalIterator()
