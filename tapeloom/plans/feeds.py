"""Queries of decoders, framing and journals: the tape is written in a venue's form, read back, and every field compared.

Also risk measures of a curve that the tape itself gives, without a simulation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tapeloom.functions import stats
from tapeloom.operators import backtest, nbbo
from tapeloom.plans.market import _CHANGES, HOUR, QUOTED, tape_sql
from tapeloom.shared import fresh_path
from tapeloom.sources import captures, decode, files
from tapeloom.sources.adapter import book_events

FIELDS = ["arrival", "event_type", "sequence", "exchange_ts_ns", "symbol", "order_id", "match_id", "qty", "price", "side"]
PER_DATAGRAM = 16
DAY_MS = 86_400_000


def _sent(ev: DataFrame, payload: Column) -> DataFrame:
    return ev.select("arrival", "sequence", "ingest_ts_ns", payload.alias("payload")).where("payload IS NOT NULL")


# -- venue forms ----------------------------------------------------------------------------------------------------
def _le(c: Column, n: int) -> Column:
    """Hex digits of a number's bytes, lowest first."""
    pairs = F.regexp_extract_all(F.lpad(F.hex(c.cast("long")), 2 * n, "0"), F.lit("(..)"), F.lit(1))
    return F.array_join(F.reverse(pairs), "")


def _be(c: Column, n: int) -> Column:
    return F.lpad(F.hex(c.cast("long")), 2 * n, "0")


def pitch_payload() -> Column:
    """The PITCH line of an add, execute, cancel or trade; null for other types. Times are milliseconds of the day."""
    number = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    oid = F.lpad(F.conv(F.col("order_id").cast("string"), 10, 36), 12, "0")
    head = lambda t: [F.lpad(F.expr(f"(exchange_ts_ns div 1000000) % {DAY_MS}").cast("string"), 8, "0"), F.lit(t), oid]
    sided = [F.when(F.col("side") == 0, "B").otherwise("S"), number("qty", 6), F.rpad("symbol", 6, " "), number("price", 10)]
    match = F.lpad(F.conv(F.col("sequence").cast("string"), 10, 36), 12, "0")
    line = F.when(F.col("event_type") == 0, F.concat(*head("A"), *sided, F.lit("Y"))).when(F.col("event_type") == 2, F.concat(*head("E"), number("qty", 6), match))
    line = line.when(F.col("event_type") == 4, F.concat(*head("X"), number("qty", 6))).when(F.col("event_type") == 7, F.concat(*head("P"), *sided, match))
    return line.cast("binary")


def deep_payload() -> Column:
    """The DEEP+ message of an add, delete, execute at a price or trade; null for other types."""
    letter = lambda t: F.lit(t.encode().hex())
    named = [_le(F.col("exchange_ts_ns"), 8), F.hex(F.rpad("symbol", 8, " ").cast("binary"))]
    order, tail = [*named, _le(F.col("order_id"), 8)], [_le(F.col("qty"), 4), _le(F.col("price"), 8)]
    out = F.when(F.col("event_type") == 0, F.concat(letter("a"), F.when(F.col("side") == 0, "38").otherwise("35"), *order, *tail))
    out = out.when(F.col("event_type") == 5, F.concat(letter("R"), F.lit("00"), *order)).when(F.col("event_type") == 2, F.concat(letter("L"), F.lit("00"), *order, *tail, _le(F.col("sequence"), 8)))
    return F.unhex(out.when(F.col("event_type") == 7, F.concat(letter("T"), F.lit("00"), *named, *tail, _le(F.col("sequence"), 8))))


def _itch_tape(spark: SparkSession, d: str) -> DataFrame:
    return book_events(spark, d).withColumn("exchange_ts_ns", F.col("exchange_ts_ns") % (1 << 47)).withColumn("match_id", F.col("sequence"))


def itch_roundtrip(spark, d):
    """The tape as ITCH messages and back, all fields."""
    return decode.decode(_sent(_itch_tape(spark, d), decode.itch_payload(F.col("event_type"))), decode.ITCH).select(*FIELDS)


def pitch_roundtrip(spark, d):
    return decode.decode(_sent(book_events(spark, d), pitch_payload()), decode.PITCH).select(*FIELDS)


def deep_roundtrip(spark, d):
    return decode.decode(_sent(book_events(spark, d), deep_payload()), decode.DEEP).select(*FIELDS)


def mold_roundtrip(spark, d):
    """ITCH messages of each venue in datagrams of 16, framed and decoded: the numbers of the messages come from the datagrams."""
    sent = _itch_tape(spark, d).withColumn("payload", decode.itch_payload(F.col("event_type"))).where("payload IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("venue").orderBy("arrival")) - 1
    cell = F.struct("sequence", F.concat(_be(F.length("payload"), 2), F.hex("payload")).alias("hex"))
    packs = sent.withColumn("pack", F.floor(nth / PER_DATAGRAM)).groupBy("venue", "pack").agg(F.array_sort(F.collect_list(cell)).alias("cells"))  # 16 messages
    body = F.concat(F.lit(b"TAPE      ".hex()), _be(F.col("cells")[0]["sequence"], 8), _be(F.size("cells"), 2), F.array_join(F.transform("cells", lambda c: c["hex"]), ""))
    grams = packs.select((F.col("pack") * 8 + F.col("venue")).alias("arrival"), F.lit(0).cast("long").alias("ingest_ts_ns"), F.unhex(body).alias("payload"))
    back = decode.decode(files.framed(grams, "itch"), decode.ITCH)
    return back.select(F.expr("(arrival div 65536) % 8").alias("feed"), *FIELDS[1:])


# -- captures -------------------------------------------------------------------------------------------------------
RANGE = 64 << 10  # small, so that a file of the provided tape is several tasks


def _captured(spark: SparkSession, d: str, walk: str) -> DataFrame:
    path = fresh_path(spark, walk)
    captures.write_capture(_itch_tape(spark, d).select("arrival", decode.itch_payload(F.col("event_type")).alias("payload")), path, walk, parts=2)
    back = captures.read_capture(spark, path, walk, every=RANGE)
    return decode.decode(decode.as_messages(back), decode.ITCH).select(*(c for c in FIELDS if c not in ("arrival", "sequence")))


def capture_itch(spark, d):
    """The tape written as files of messages with lengths, and read again in ranges."""
    return _captured(spark, d, "itch_lengths")


def capture_raw(spark, d):
    return _captured(spark, d, "itch_raw")


def capture_pcap(spark, d):
    """The same in network packets of 16 messages."""
    return _captured(spark, d, "pcap")


PACKET, MESSAGE = 8, 4  # entries


def _sbe_packets(spark: SparkSession, d: str) -> DataFrame:
    """The tape as packets of two book messages and one of another template; trades are implied entries, some numbers are null or 0."""
    nth = F.row_number().over(Window.partitionBy("venue").orderBy("arrival")) - 1
    ev = book_events(spark, d).withColumn("nth", nth).withColumn("pack", F.expr(f"nth div {PACKET}"))
    action = F.when(F.col("arrival") % 31 == 0, 9).when(F.col("event_type") == 0, 0).when(F.col("event_type") == 2, 1).when(F.col("event_type") == 4, 2).otherwise(3 + F.col("order_id") % 2)
    price = F.when(F.col("event_type") == 5, F.lit((1 << 63) - 1)).otherwise(F.col("price") * 100_000 + 37)
    security = F.when(F.col("arrival") % 17 == 0, (1 << 31) - 1).otherwise(F.substring("symbol", 4, 8).cast("long"))
    report = F.when(F.col("sequence") % 13 == 0, 0).otherwise(F.col("sequence"))
    kind = F.when(F.col("event_type") == 7, "4A").when(F.col("arrival") % 19 == 0, "45").when(F.col("side") == 0, "30").otherwise("31")
    entry = F.concat(_le(price, 8), _le(F.col("qty"), 4), _le(security, 4), _le(report, 4), F.lit("00" * 5), _be(action, 1), kind, F.lit("00" * 5))
    cells = F.array_sort(F.collect_list(F.struct("nth", "exchange_ts_ns", entry.alias("hex"))))  # 8 entries
    packs = ev.groupBy("venue", "pack").agg(cells.alias("cells"))
    body = lambda first: F.slice("cells", first, MESSAGE)
    sized = lambda template, inner: F.concat(_le(F.length(inner) / 2 + 10, 2), F.lit("0000"), _le(F.lit(template), 2), F.lit("00000000"), inner)
    book = lambda time, some: sized(32, F.concat(_le(time, 8), F.lit("000000"), _le(F.lit(32), 2), _be(F.size(some), 1), F.array_join(F.transform(some, lambda c: c["hex"]), "")))
    sent = F.col("cells")[0]["exchange_ts_ns"]
    whole = F.concat(_le(F.col("pack"), 4), _le(sent + 1, 8), book(sent, body(1)), sized(4, F.lit("00" * 6)), book(F.lit(0), body(MESSAGE + 1)))
    return packs.select((F.col("pack") * 8 + F.col("venue")).alias("arrival"), F.lit(0).cast("long").alias("ingest_ts_ns"), F.unhex(whole).alias("payload"))


def mdp3_roundtrip(spark, d):
    """The tape as packets of repeating groups and back."""
    return decode.decode_sbe(_sbe_packets(spark, d)).select(*(c for c in FIELDS if c not in ("match_id", "order_id")))


# -- journals -------------------------------------------------------------------------------------------------------
def journal_roundtrip(spark, d):
    """The tape written as book journals and read again, record numbers as arrival."""
    path = fresh_path(spark, "journal")
    ev = book_events(spark, d)
    files.write_journal(ev, path)
    back = files.read_journal(spark, path)
    return back.select(F.col("arrival").alias("record"), "venue", *FIELDS[1:])


def nbbo_journal_roundtrip(spark, d):
    path = fresh_path(spark, "quotes")
    files.write_journal(nbbo.changes(nbbo.nbbo(book_events(spark, d), keep=QUOTED)), path, "nbbo")
    return files.read_journal(spark, path, "nbbo").select(F.col("arrival").alias("record"), "symbol", "exchange_ts_ns", "bid_price", "bid_qty", "ask_price", "ask_qty")


def journal_counts(spark, d):
    """Records of a journal by its files' sizes alone, and after appending it again."""
    path = fresh_path(spark, "journal")
    ev = book_events(spark, d)
    files.write_journal(ev, path)
    once = files.count_records(path)
    files.write_journal(ev, path, append=True)
    return spark.createDataFrame([(once, files.count_records(path))], "once long, twice long")


# -- measures of a curve that the tape gives ------------------------------------------------------------------------
def _trades(spark: SparkSession, d: str) -> DataFrame:
    """What each trade is worth against a fair price of 10000."""
    return book_events(spark, d).where("event_type = 7").select("symbol", "arrival", "exchange_ts_ns", (F.when(F.col("side") == 0, F.col("qty")).otherwise(-F.col("qty")) * (F.lit(10_000) - F.col("price") + F.col("order_id") + F.expr("sequence % 5 - 1"))).cast("double").alias("pnl"))


def _curve(trades: DataFrame) -> DataFrame:
    return backtest.equity_curve(trades.select("symbol", "arrival", "exchange_ts_ns", F.sum("pnl").over(Window.partitionBy("symbol").orderBy("arrival")).alias("equity")))


def tape_buckets(spark, d):
    return backtest.bucket_returns(_curve(_trades(spark, d)), 24 * HOUR).select("bucket", F.round("equity", 4).alias("equity"), F.round("r", 4).alias("r"))


def tape_risk(spark, d):
    trades = _trades(spark, d)
    curve = _curve(trades)
    r = backtest.bucket_returns(curve, 24 * HOUR).where("r IS NOT NULL").select("r")
    out = stats.risk_metrics(r, curve.select(F.col("arrival").alias("at"), "equity"), trades.select("pnl"))
    return out.select(*(F.round(c, 6).alias(c) for c in ("sharpe", "sortino", "win_rate", "avg_trade", "max_drawdown")), "n_returns", "n_trades")


QUERIES = {f.__name__: f for f in (capture_itch, capture_raw, capture_pcap, mdp3_roundtrip, itch_roundtrip, pitch_roundtrip, deep_roundtrip, mold_roundtrip, journal_roundtrip, nbbo_journal_roundtrip, journal_counts, tape_buckets, tape_risk)}

#: What each message type carries: an absent number is 0, an absent name empty, an absent side 2.
_ITCH = """, sent AS (SELECT arrival, venue, event_type, seq, ns % 140737488355328 ns, CASE WHEN event_type IN (0, 7) THEN symbol ELSE '' END symbol, order_id,
    CASE WHEN event_type IN (2, 7) THEN seq ELSE 0 END match_id, CASE WHEN event_type = 5 THEN 0 ELSE qty END qty, CASE
        WHEN event_type IN (0, 7) THEN price ELSE 0 END price, CASE WHEN event_type IN (0, 7) THEN side ELSE 2 END side FROM ev)"""
_OUT = "event_type, seq AS sequence, ns exchange_ts_ns, symbol, order_id, match_id, qty, price, side"
_CURVE = """, tr AS (SELECT arrival, ns, CAST(CASE WHEN side = 0 THEN qty ELSE -qty END * (10000 - price + order_id + seq % 5 - 1) AS DOUBLE) pnl FROM ev
        WHERE event_type = 7),
    cu AS (SELECT *, sum(pnl) OVER (ORDER BY arrival) equity FROM tr), bu AS (SELECT ns // 86400000000000 bucket, arg_min(equity, arrival) equity
        FROM cu GROUP BY 1), re AS (SELECT bucket, equity, equity - lag(equity) OVER (ORDER BY bucket) r FROM bu)"""

_PARTS_OF = "event_type, ns exchange_ts_ns, symbol, order_id, match_id, qty, price, side"

ORACLE_SQL = {
    **{name: tape_sql(_ITCH, f"SELECT {_PARTS_OF} FROM sent") for name in ("capture_itch", "capture_raw", "capture_pcap")},
    "mdp3_roundtrip": tape_sql(f""", placed AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY arrival) - 1 nth FROM ev),
        packed AS (SELECT *, nth // {PACKET} pack, first_value(ns) OVER (PARTITION BY venue, nth // {PACKET} ORDER BY nth) sent FROM placed),
        shown AS (SELECT *, row_number() OVER (PARTITION BY venue, pack ORDER BY nth) - 1 k FROM packed WHERE event_type <> 7)""",
        f"""SELECT (pack * 8 + venue) * 256 + k arrival, CASE WHEN arrival % 31 = 0 THEN 255 WHEN event_type = 0 THEN 0 WHEN event_type = 2 THEN 6
        ELSE 5 END event_type,
        CASE WHEN seq % 13 = 0 THEN pack * 4294967296 + nth % {MESSAGE} ELSE seq END AS sequence, CASE WHEN nth % {PACKET} < {MESSAGE} THEN sent
        ELSE sent + 1 END exchange_ts_ns,
        CASE WHEN arrival % 17 = 0 THEN '' ELSE substr(symbol, 4) END symbol, qty, CASE WHEN event_type = 5 THEN 0 ELSE price END price, CASE
        WHEN arrival % 19 = 0 THEN 2 ELSE side END side FROM shown"""),
    "itch_roundtrip": tape_sql(_ITCH, f"SELECT arrival, {_OUT} FROM sent"),
    "pitch_roundtrip": tape_sql("", f"""SELECT arrival, event_type, seq AS sequence, (ns // 1000000) % {DAY_MS} * 1000000 exchange_ts_ns, CASE
        WHEN event_type IN (0, 7) THEN symbol ELSE '' END symbol, order_id,
        CASE WHEN event_type IN (2, 7) THEN seq ELSE 0 END match_id, qty, CASE WHEN event_type IN (0, 7) THEN price ELSE 0 END price, CASE
        WHEN event_type IN (0, 7) THEN side ELSE 2 END side FROM ev WHERE event_type IN (0, 2, 4, 7)"""),
    "deep_roundtrip": tape_sql("", """SELECT arrival, CASE event_type WHEN 2 THEN 3 ELSE event_type END event_type, seq AS sequence, ns exchange_ts_ns, symbol,
        CASE WHEN event_type = 7 THEN 0 ELSE order_id END order_id,
        CASE WHEN event_type IN (2, 7) THEN seq ELSE 0 END match_id, CASE WHEN event_type = 5 THEN 0 ELSE qty END qty, CASE WHEN event_type = 5 THEN 0
        ELSE price END price, CASE WHEN event_type = 0 THEN side ELSE 2 END side FROM ev WHERE event_type IN (0, 2, 5, 7)"""),
    "mold_roundtrip": tape_sql(_ITCH, f"SELECT venue feed, {_OUT} FROM sent"),
    "journal_roundtrip": tape_sql("", "SELECT row_number() OVER (ORDER BY arrival) - 1 record, venue, event_type, seq AS sequence, ns exchange_ts_ns, symbol, "
        "order_id, 0 match_id, qty, price, side FROM ev"),
    "nbbo_journal_roundtrip": tape_sql(_CHANGES, "SELECT row_number() OVER (ORDER BY arrival) - 1 record, symbol, ns exchange_ts_ns, bid_price, bid_qty, "
        "ask_price, ask_qty FROM ch"),
    "journal_counts": tape_sql("", "SELECT count(*) once, 2 * count(*) twice FROM ev"),
    "tape_buckets": tape_sql(_CURVE, "SELECT bucket, round(equity, 4) equity, round(r, 4) r FROM re"),
    "tape_risk": tape_sql(_CURVE, """SELECT (SELECT round(avg(r) / stddev_pop(r), 6) FROM re) sharpe, (SELECT round(avg(r) / sqrt(avg(CASE
        WHEN r < 0 THEN r * r END)), 6) FROM re) sortino, (SELECT count(r) FROM re) n_returns,
        round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) win_rate, round(avg(pnl), 6) avg_trade, count(*) n_trades, (SELECT round(max(peak - equity),
        6) FROM (SELECT equity, max(equity) OVER (ORDER BY arrival) peak FROM cu)) max_drawdown FROM tr"""),
}
