"""Queries of sequencing, decoding, generators and simulated trading."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import codecs, stats
from tapeloom.operators import backtest, book, sequence
from tapeloom.plans import replays
from tapeloom.plans.market import HOUR, WINDOW, _copies, tape_sql
from tapeloom.shared import stored
from tapeloom.sources import crypto, decode, synthetic
from tapeloom.sources.adapter import book_events

MM = backtest.Config("market_maker", {"size": 20, "half_spread": 2}, cap=0.5, ofi_window_ns=WINDOW)
OFI = backtest.Config("ofi", {"size": 20, "half_spread": 2, "threshold": 60.0, "max_position": 60}, cap=0.5, ofi_window_ns=WINDOW)


def sequence_release(spark, d):
    """A tape with losses, copies and late events, through each venue's tracker."""
    ev = book_events(spark, d).where("sequence % 53 <> 0").withColumn("arrival", F.col("arrival") + F.when(F.col("sequence") % 11 == 0, 40).otherwise(0) * 5)
    return sequence.sequenced(ev, 64).select("venue", "arrival", "sequence", "status", "release")


def sequence_stats(spark, d):
    return sequence.tracker_stats(_copies(book_events(spark, d)), 64)


def accepted_by_feed(spark, d):
    return sequence.accepted_by_feed(_copies(book_events(spark, d)))


def crc_witness(spark, d):
    """The tape's checksum, and whether it is the same in other ranges."""
    ev = book_events(spark, d)
    both = sequence.witnessed(ev).union(sequence.witnessed(ev.repartition(7), parts=9))
    return both.agg(F.first("crc").alias("crc"), (F.min("crc") == F.max("crc")).alias("same"), F.max("events").alias("events"))


def itch_type_counts(spark, d):
    ev = book_events(spark, d).withColumn("exchange_ts_ns", F.col("exchange_ts_ns") % (1 << 47))
    sent = ev.select("arrival", "sequence", "ingest_ts_ns", decode.itch_payload(F.col("event_type")).alias("payload"))
    return decode.parse_stats(sent, decode.ITCH).select(F.chr("raw_type").alias("type"), "status", "n")


def crypto_lowering(spark, d):
    """Frames made from the events table: an order a user, moved by views and signups, removed by errors."""
    ev = spark.read.parquet(f"{d}/events.parquet")
    row = F.concat(F.lit("["), F.col("user_id"), F.lit(","), F.when(F.col("event_type") == "error", F.lit("0")).otherwise(F.col("value").cast("string")), F.lit(","), F.when(F.col("event_id") % 2 == 0, 1.5).otherwise(-0.25), F.lit("]"))
    frame = F.when(F.col("event_id") % 1000 == 0, F.concat(F.lit("[7,["), row, F.lit("],"), F.col("event_id") + 1, F.lit("]"))).otherwise(F.concat(F.lit("[7,"), row, F.lit(","), F.col("event_id") + 1, F.lit("]")))
    frames = ev.select(F.col("event_id").alias("arrival"), F.lit("tBTCUSD").alias("symbol"), F.col("event_id").alias("exchange_ts_ns"), frame.alias("frame"))
    low = crypto.lower(crypto.synced(crypto.parse_frames(frames)))
    return low.where("status = 'ok'").select("arrival", "event_type", "order_id", "qty", "price", "prev_qty", "prev_price", "side")


def research_tape(spark, d):
    return synthetic.research_tape(spark, 6000, 4).groupBy("symbol", "event_type", "side").agg(F.count("*").alias("n"), F.sum("price").alias("price_sum"), F.sum("qty").alias("qty_sum"))


def lifecycle_book(spark, d):
    """Final levels of the lifecycle tape by the engine."""
    tape = synthetic.lifecycle_tape(spark, 4000)
    return book.with_tops(book.enrich(tape)).groupBy("venue", "symbol").agg(F.max_by("bid_price", "arrival").alias("bid_price"), F.max_by("ask_price", "arrival").alias("ask_price"), F.count("*").alias("events"))


def sim_fills_mm(spark, d):
    return backtest.fills(backtest.simulate(book_events(spark, d), MM)).select("symbol", "arrival", "number", "side", "price", "qty", "partial", "taker", F.round("realized", 6).alias("realized"))


def sim_fills_ofi(spark, d):
    return backtest.fills(backtest.simulate(book_events(spark, d), OFI)).select("symbol", "arrival", "number", "side", "price", "qty", "partial", "taker", F.round("realized", 6).alias("realized"))


def intents_mm(spark, d):
    return backtest.intents(backtest.simulate(book_events(spark, d), MM)).groupBy("symbol", "action").agg(F.count("*").alias("n"), F.coalesce(F.sum("qty"), F.lit(0)).alias("qty"))


def shard_witness(spark, d):
    """Checksums of the tape for 1, 2, 4 and 8 shards."""
    ev = book_events(spark, d)
    out = None
    for n in (1, 2, 4, 8):
        one = codecs.shard_witness(ev, n).select(F.lit(n).alias("shards"), "events", "witness")
        out = one if out is None else out.union(one)
    return out.groupBy("witness").agg(F.count("*").alias("runs"), F.max("events").alias("events")).select("runs", "events")


def symbol_codes(spark, d):
    ev = book_events(spark, d).groupBy("symbol").agg(F.count("*").alias("n"))
    code = codecs.symbol_to_u64(F.col("symbol"))
    return ev.select(F.col("symbol"), code.alias("code"), codecs.u64_to_symbol(code).alias("back"), "n")


def pnl_by_symbol(spark, d):
    return backtest.final_accounts(backtest.simulate(book_events(spark, d), MM)).select("symbol", "submitted", "position", F.round("cash", 4).alias("cash"), F.round("realized", 4).alias("realized"), F.round("equity", 4).alias("equity"), "fills")


def equity_buckets(spark, d):
    curve = backtest.equity_curve(backtest.simulate(book_events(spark, d), MM))
    return backtest.bucket_returns(curve, 24 * HOUR).select("bucket", F.round("equity", 4).alias("equity"), F.round("r", 4).alias("r"))


def experiment_report(spark, d):
    found = backtest.report(stored(backtest.simulate(book_events(spark, d), MM), "simulated"), 24 * HOUR)
    return found.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes))


def risk_metrics(spark, d):
    ticks = stored(backtest.simulate(book_events(spark, d), MM), "simulated")
    curve = backtest.equity_curve(ticks)
    r = backtest.bucket_returns(curve, 24 * HOUR).where("r IS NOT NULL").select("r")
    found = stats.risk_metrics(r, curve.select(F.col("arrival").alias("at"), "equity"), backtest.fills(ticks).where("realized <> 0").select(F.col("realized").alias("pnl")))
    places = {"sharpe": 9, "sortino": 9, "win_rate": 9, "max_drawdown": 6, "avg_trade": 6}
    return found.select(*(F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in found.columns))


def ofi_holdout_report(spark, d):
    """Trading of the last 30 % of the tape, with the bootstrap of its daily equity changes."""
    curve = backtest.equity_curve(backtest.simulate(backtest.holdout(book_events(spark, d), 0.3), OFI))
    r = backtest.bucket_returns(curve, HOUR).where("r IS NOT NULL AND r <> 0")
    return stats.bootstrap(r, "r", "bucket", 10).select("p_value", "n")


QUERIES = {f.__name__: f for f in (
    sequence_release, sequence_stats, accepted_by_feed, crc_witness, itch_type_counts, crypto_lowering, research_tape, lifecycle_book, sim_fills_mm, sim_fills_ofi, intents_mm, shard_witness, symbol_codes, pnl_by_symbol, equity_buckets, experiment_report, risk_metrics, ofi_holdout_report,
)}

_OCTETS = lambda x, n: f"list_transform(range({n}), lambda i: ({x} >> (8 * i)) & 255)"
_EVENT_OCTETS = " || ".join(["[CAST(venue AS BIGINT), event_type]", _OCTETS("seq", 8), _OCTETS("ns", 8), "list_transform(range(8), "
    "lambda i: CAST(ascii(substr(rpad(symbol, 8, ' '), CAST(i + 1 AS BIGINT), "
        "1)) AS BIGINT))", _OCTETS("order_id", 8), _OCTETS("CAST(qty AS BIGINT)", 4), _OCTETS("CAST(price AS BIGINT)", 4)])
#: CRC-32 by its table: each event's bytes by themselves, then the sums in a row, each carried over the next event's zero bytes by four tables.
_CRC = f"""SELECT list_reduce(list(c ORDER BY arrival), lambda a, c: xor(xor(xor(z[(a & 255) + 1], z[((a >> 8) & 255) + 257]), xor(z[((a >> 16) & 255) + 513],
        z[((a >> 24) & 255) + 769])), c)) crc, TRUE same, count(*) AS events
FROM (SELECT arrival, xor(list_reduce(list_prepend(4294967295::BIGINT, CAST({_EVENT_OCTETS} AS BIGINT[])), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])),
        4294967295) c FROM ev, tb),
    (SELECT list_transform(range(1024), lambda k: list_reduce(list_prepend((k % 256) << (8 * (k // 256)), list_transform(range(42), lambda i: 0::BIGINT)),
        lambda c, b: xor(c >> 8, t[(c & 255) + 1]))) z FROM tb) GROUP BY z"""

ORACLE_SQL = {
    **replays.ORACLE_SQL,
    "crc_witness": tape_sql(""", tb AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE
        WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) t)""", _CRC),
    "accepted_by_feed": tape_sql(""", copies AS (SELECT venue, seq, 'A' feed, arrival * 2 arrival FROM ev WHERE seq % 7 <> 0 UNION ALL
        SELECT venue, seq, 'B', arrival * 2 + 1 FROM ev WHERE seq % 5 <> 0)""",
        "SELECT feed, count(*) accepted FROM (SELECT feed, row_number() OVER (PARTITION BY venue, seq ORDER BY arrival) rn FROM copies) WHERE rn = 1 "
            "GROUP BY feed"),
    "research_tape": """WITH t AS (SELECT i, i % 4 slot, i // 24 AS cycle, (i // 4) % 6 step FROM range(6000) r(i))
        SELECT list_extract(['AAPL0001', 'MSFT0002', 'NVDA0003', 'AMZN0004'], slot + 1) symbol, list_extract([0, 0, 7, 7, 5, 5], step + 1) event_type,
        list_extract([0, 1, 1, 0, 2, 2], step + 1) side, count(*) n,
            CAST(sum(CASE WHEN step IN (0, 2) THEN 9999 + cycle % 97 WHEN step IN (1, 3) THEN 10001 + cycle % 97 ELSE 0 END) AS BIGINT) price_sum,
            CAST(sum(CASE WHEN step >= 4 THEN 0 ELSE 100 END) AS BIGINT) qty_sum FROM t GROUP BY ALL""",
    "shard_witness": tape_sql("", "SELECT CAST(4 AS BIGINT) runs, count(*) events FROM ev"),
    "symbol_codes": tape_sql("", "SELECT symbol, CAST(('0x' || hex(rpad(symbol, 8, ' '))) AS BIGINT) code, symbol AS back, count(*) n FROM ev GROUP BY ALL"),
    "itch_type_counts": tape_sql("", "SELECT CASE event_type WHEN 0 THEN 'A' WHEN 2 THEN 'E' WHEN 4 THEN 'X' WHEN 5 THEN 'D' "
        "WHEN 7 THEN 'P' END AS type, 'ok' status, count(*) n FROM ev GROUP BY ALL"),
    # A price of 0 removes an order whatever event gave it; a frame out of sequence ends an epoch; numbers out of range are rejected.
    "crypto_lowering": """WITH ep AS (SELECT event_id, user_id, value, event_type = 'error' OR value = 0 gone, event_id % 1000 = 0 snap, count(*) FILTER (event_id % 1000 = 0)
        OVER (ORDER BY event_id) epoch, CASE WHEN event_id % 2 = 0 THEN 1500000 ELSE 250000 END q, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END side FROM events),
        gp AS (SELECT *, NOT snap AND event_id <> coalesce(lag(event_id) OVER (PARTITION BY epoch ORDER BY event_id), -2) + 1 gap FROM ep),
        lo AS (SELECT *, epoch = 0 OR bool_or(gap) OVER (PARTITION BY epoch ORDER BY event_id) lost FROM gp),
        ev AS (SELECT *, CASE WHEN gone THEN 0 ELSE CAST(floor(value * 10000 + 0.5) AS BIGINT) END px FROM lo
            WHERE NOT lost AND (gone OR value BETWEEN 0 AND 4294967295 / 10000.0::DOUBLE)),
        w AS (SELECT *, lag({'g': gone, 'p': px, 'q': q}) OVER (PARTITION BY epoch, user_id ORDER BY event_id) was FROM ev)
        SELECT event_id * 65536 arrival, CASE WHEN gone THEN 4 WHEN was IS NOT NULL AND NOT was.g THEN 6 ELSE 0 END event_type, user_id order_id, CASE
        WHEN gone THEN 0 ELSE q END qty, px price,
            CASE WHEN NOT gone AND was IS NOT NULL AND NOT was.g THEN was.q ELSE 0 END prev_qty, CASE WHEN NOT gone AND was IS NOT NULL
            AND NOT was.g THEN was.p ELSE 0 END prev_price, side FROM w WHERE NOT gone OR (was IS NOT NULL AND NOT was.g)""",
}

