"""Queries of every message type, of damaged journals and of feeds that lose their place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeloom.functions.ranks import running_sum
from tapeloom.operators import service
from tapeloom.plans.feeds import DAY_MS, FIELDS, _be, _le, _sent
from tapeloom.plans.market import tape_sql
from tapeloom.shared import fresh_path
from tapeloom.sources import captures, crypto, decode, files
from tapeloom.sources.adapter import book_events

ALL_FIELDS = [*FIELDS, "reference_order_id", "mpid"]


def _dressed(spark: SparkSession, d: str) -> DataFrame:
    """The tape with what other message types carry: a price, a maker's name, an older order."""
    ev = book_events(spark, d).withColumn("exchange_ts_ns", F.col("exchange_ts_ns") % (1 << 47)).withColumn("price", 9000 + F.col("arrival") % 2000)
    ev = ev.withColumn("side", (F.col("arrival") % 3).cast("short")).withColumn("reference_order_id", F.col("order_id") + 7)
    return ev.withColumn("mpid", F.concat(F.lit("MP"), (10 + F.col("arrival") % 90).cast("string")))


def _by_letter(letters: str, bodies: dict[str, list]) -> Column:
    """A message whose letter is arrival modulo the letters, from its parts."""
    out = F.lit(None).cast("string")
    for k, t in enumerate(letters):
        out = F.when(F.col("arrival") % len(letters) == k, F.concat(*bodies[t])).otherwise(out)
    return out


ITCH_LETTERS, PITCH_LETTERS, DEEP_LETTERS = "AFECXDUPQISR", "AdE1XrP2", "aMRLTSE"
_SIDES = ("B", "S", " ")


def _side(codes: tuple) -> Column:
    return F.when(F.col("side") == 0, codes[0]).when(F.col("side") == 1, codes[1]).otherwise(codes[2])


def itch_all_types(spark, d):
    """All twelve ITCH messages and back."""
    n, name = lambda c, k: _be(F.col(c), k), F.hex(F.rpad("symbol", 8, " ").cast("binary"))
    blank, letter = lambda k: F.lit("00" * k), lambda t: F.lit(t.encode().hex())
    head = [blank(4), n("exchange_ts_ns", 6)]
    order, match = [*head, n("order_id", 8)], n("sequence", 8)
    add = [*order, _side(tuple(x.encode().hex() for x in _SIDES)), n("qty", 4), name, n("price", 4)]
    bodies = {
        "A": add, "F": [*add, F.hex(F.col("mpid").cast("binary"))], "E": [*order, n("qty", 4), match], "C": [*order, n("qty", 4), match, blank(1), n("price", 4)], "X": [*order, n("qty", 4)], "D": order,
        "U": [*head, n("reference_order_id", 8), n("order_id", 8), n("qty", 4), n("price", 4)], "P": [*add, match], "Q": [*head, n("qty", 8), name, n("price", 4), match, blank(1)],
        "I": [*head, blank(8), n("qty", 8), blank(1), name, blank(14)], "S": [*head, blank(1)], "R": [*head, name, blank(20)],
    }
    sent = _sent(_dressed(spark, d), F.unhex(_by_letter(ITCH_LETTERS, {t: [letter(t), *parts] for t, parts in bodies.items()})))
    return decode.decode(sent, decode.ITCH).select(*ALL_FIELDS)


def pitch_all_types(spark, d):
    """All eight PITCH lines and back; long prices have two digits more."""
    number = lambda c, k: F.lpad(F.col(c).cast("string"), k, "0")
    base36 = lambda c: F.lpad(F.conv(F.col(c).cast("string"), 10, 36), 12, "0")
    head = lambda t: [F.lpad(F.expr(f"(exchange_ts_ns div 1000000) % {DAY_MS}").cast("string"), 8, "0"), F.lit(t), base36("order_id")]
    sided, name, long_price = [_side(_SIDES), number("qty", 6)], lambda k: F.rpad("symbol", k, " "), F.concat(number("price", 12), F.lit("37"))
    bodies = {
        "A": [*sided, name(6), number("price", 10), F.lit("Y")], "d": [*sided, name(8), number("price", 10), F.lit("Y"), "mpid", F.lit(" ")], "1": [*sided, name(8), long_price, F.lit("Y"), "mpid", F.lit(" ")],
        "E": [number("qty", 6), base36("sequence")], "X": [number("qty", 6)], "P": [*sided, name(6), number("price", 10), base36("sequence")], "r": [*sided, name(8), number("price", 10), base36("sequence")], "2": [*sided, name(8), long_price, base36("sequence")],
    }
    sent = _sent(_dressed(spark, d), _by_letter(PITCH_LETTERS, {t: [*head(t), *parts] for t, parts in bodies.items()}).cast("binary"))
    return decode.decode(sent, decode.PITCH).select(*ALL_FIELDS)


def deep_all_types(spark, d):
    """All seven DEEP+ messages and back."""
    n, letter = lambda c, k: _le(F.col(c), k), lambda t: F.lit(t.encode().hex())
    time, name = n("exchange_ts_ns", 8), F.hex(F.rpad("symbol", 8, " ").cast("binary"))
    order, sized, match, flag = [time, name, n("order_id", 8)], [n("qty", 4), n("price", 8)], n("sequence", 8), F.lit("00")
    bodies = {
        "a": [_side(("38", "35", "00")), *order, *sized], "M": [flag, *order, *sized], "R": [flag, *order], "L": [flag, *order, *sized, match], "T": [flag, time, name, *sized, match], "S": [flag, time], "E": [flag, time, name],
    }
    sent = _sent(_dressed(spark, d), F.unhex(_by_letter(DEEP_LETTERS, {t: [letter(t), *parts] for t, parts in bodies.items()})))
    return decode.decode(sent, decode.DEEP).select(*ALL_FIELDS)


# -- damaged journals ---------------------------------------------------------------------------------------------
BAD_EVERY, BAD_AT = 101, 50


def _damaged(spark: SparkSession, ev: DataFrame) -> str:
    """Journals in which every 101st record has a wrong byte, and the last file a torn tail."""
    sound, path = fresh_path(spark, "journal"), fresh_path(spark, "damaged")
    files.write_journal(ev, sound, parts=4)
    names = files._files(sound)[1]
    base = path.split("://", 1)[-1] if path.startswith("file://") else path

    def spoil(batches):
        fs = captures._system(sound)
        fs.create_dir(base, recursive=True)
        for b in batches:
            for f, last in zip(b.column("file").to_pylist(), b.column("last").to_pylist()):
                width, n = 24 + files.FORMATS["book"][1], 0
                with fs.open_input_file(f) as src, fs.open_output_stream(f"{base}/{f.rsplit('/', 1)[-1]}") as out:
                    out.write(src.read(files.HEADER))
                    for raw, _ in files.blocks(src, files.HEADER, src.size(), width):
                        rows = np.frombuffer(bytearray(raw), np.uint8).reshape(-1, width)
                        number = rows[:, :8].copy().view("<u8")[:, 0]
                        rows[number % BAD_EVERY == BAD_AT, 24 + 44] ^= 1
                        out.write(rows.tobytes())
                        n += len(rows)
                    out.write(b"torn tail!" * last)
                yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    listed = spark.createDataFrame([(f, int(f == names[-1])) for f in names], "file string, last int").repartition(len(names))
    listed.mapInArrow(spoil, "n long").agg(F.sum("n")).collect()  # a number
    return path


def damaged_journal(spark, d):
    """What a permissive scan says of every record, and what a sound record holds."""
    rows = files.read_journal(spark, _damaged(spark, book_events(spark, d)), permissive=True, records=500)
    ok = F.col("status") == "ok"
    return rows.select(F.col("arrival").alias("record"), "status", F.when(ok, F.col("symbol")).alias("symbol"), F.when(ok, F.col("order_id")).alias("order_id"))


def failsafe_journal(spark, d):
    """The same journals, read as they are by default: bad records are left out."""
    return files.read_journal(spark, _damaged(spark, book_events(spark, d)), records=500).select(F.col("arrival").alias("record"), "symbol", "order_id", "qty", "price")


def journal_data_loss(spark, d):
    """How a replay of a sound and of a damaged journal ends."""
    ev = book_events(spark, d)
    sound = fresh_path(spark, "journal")
    files.write_journal(ev, sound)
    status = lambda name, path: service.scan_status(files.read_journal(spark, path, permissive=True)).select(F.lit(name).alias("journal"), "*")
    return status("sound", sound).union(status("damaged", _damaged(spark, ev)))


# -- crypto feeds with gaps -----------------------------------------------------------------------------------------
SNAPSHOT_EVERY, LOST_EVERY, BARE_EVERY = 200, 61, 41


def _gappy_frames(spark: SparkSession, d: str) -> DataFrame:
    """Three channels with a snapshot every 200 frames; some frames are lost, some have no number."""
    ev = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value", (F.col("user_id") % 3).alias("channel"), F.lit(1).cast("long").alias("one"))
    ev = running_sum(ev, "event_id", "one", "n", by=["channel"])  # by ranges, as a channel's frames are made and parsed where they are numbered
    price = F.when(F.col("event_type") == "error", F.lit("0")).otherwise(F.col("value").cast("string"))
    row = F.concat(F.lit("["), F.col("user_id"), F.lit(","), price, F.lit(","), F.when(F.col("event_id") % 2 == 0, 1.5).otherwise(-0.25), F.lit("]"))
    body = F.when(F.col("n") % SNAPSHOT_EVERY == 1, F.concat(F.lit("["), row, F.lit("]"))).otherwise(row)
    number = F.when(F.col("n") % BARE_EVERY == 3, 0).otherwise(F.col("n"))
    frame = F.concat(F.lit("["), F.col("user_id") % 3, F.lit(","), body, F.lit(","), number, F.lit("]"))
    kept = ev.where(F.col("n") % LOST_EVERY != 7)
    return kept.select(F.col("event_id").alias("arrival"), F.concat(F.lit("tS"), F.col("user_id") % 3, F.lit("USD")).alias("symbol"), F.col("event_id").alias("exchange_ts_ns"), frame.alias("frame"))


def crypto_resync_stats(spark, d):
    return crypto.sync_stats(crypto.parse_frames(_gappy_frames(spark, d))).select("symbol", "snapshots", "gaps", "ignored", "applied")


def crypto_resync_events(spark, d):
    """Events of the frames that a client in step applies; after a gap nothing counts until the next snapshot."""
    return crypto.events(_gappy_frames(spark, d)).select("arrival", "symbol", "event_type", "sequence", "order_id", "qty", "price", "prev_qty", "prev_price", "side")


QUERIES = {f.__name__: f for f in (itch_all_types, pitch_all_types, deep_all_types, damaged_journal, failsafe_journal, journal_data_loss, crypto_resync_stats, crypto_resync_events)}

# What each type carries; an absent number is 0, an absent name empty or null, an absent side 2.
_KINDS = {"A": 0, "F": 1, "E": 2, "C": 3, "X": 4, "D": 5, "U": 6, "P": 7, "Q": 8, "I": 9, "S": 10, "R": 11}


def _all_types_sql(letters: str, kinds: dict[str, int], has: dict[str, str], time: str = "ns") -> str:
    """`has`: field -> the letters of the types that carry it."""
    dressed = f""", dressed AS (SELECT arrival, seq, ns % 140737488355328 ns, symbol, order_id, order_id + 7 older, seq AS match_no, qty,
        9000 + arrival % 2000 px, arrival % 3 s, 'MP' || (10 + arrival % 90) maker FROM ev),
        lettered AS (SELECT *, substr('{letters}', CAST(arrival % {len(letters)} + 1 AS BIGINT), 1) t FROM dressed)"""
    value = {"symbol": ("symbol", "''"), "order_id": ("order_id", "0"), "match_id": ("match_no", "0"), "qty": ("qty", "0"), "price": ("px", "0"), "side": ("s", "2"), "reference_order_id": ("older", "0"), "mpid": ("maker", "NULL")}
    cells = [f"CASE WHEN contains('{has.get(f, '')}', t) THEN {there} ELSE {absent} END {f}" for f, (there, absent) in value.items()]
    kind = "CASE t " + " ".join(f"WHEN '{t}' THEN {k}" for t, k in kinds.items()) + " END event_type"
    return tape_sql(dressed, f"SELECT arrival, {kind}, seq AS sequence, {time} exchange_ts_ns, {', '.join(cells)} FROM lettered")


_BAD = f"record % {BAD_EVERY} = {BAD_AT}"
_RECORDS = ", rec AS (SELECT *, row_number() OVER (ORDER BY arrival) - 1 record FROM ev)"
_FRAMES = f"""fr AS (SELECT event_id, user_id, 'tS' || (user_id % 3) || 'USD' symbol, row_number() OVER (PARTITION BY user_id % 3
        ORDER BY event_id) n, event_type = 'error' OR value = 0 gone, value,
    CAST(floor(value * 10000 + 0.5) AS BIGINT) px, CASE WHEN event_id % 2 = 0 THEN 1500000 ELSE 250000 END q, CASE WHEN event_id % 2 = 0 THEN 0
        ELSE 1 END side FROM events),
kept AS (SELECT *, n % {SNAPSHOT_EVERY} = 1 snap, CASE WHEN n % {BARE_EVERY} = 3 THEN 0 ELSE n END number FROM fr WHERE n % {LOST_EVERY} <> 7),
ep AS (SELECT *, count(*) FILTER (snap) OVER (PARTITION BY symbol ORDER BY event_id) epoch FROM kept),
ls AS (SELECT *, last_value(nullif(number, 0) IGNORE NULLS) OVER (PARTITION BY symbol, epoch ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING) before FROM ep),
gp AS (SELECT *, NOT snap AND number <> 0 AND number <> coalesce(before, -1) + 1 gap FROM ls),
lo AS (SELECT *, epoch = 0 OR bool_or(gap) OVER (PARTITION BY symbol, epoch ORDER BY event_id) lost FROM gp)"""

ORACLE_SQL = {
    "itch_all_types": _all_types_sql(ITCH_LETTERS, _KINDS, {"symbol": "AFPQIR", "order_id": "AFECXDUP", "match_id": "ECPQ", "qty": "AFECXUPQI", "price": "AFCUPQ", "side": "AFP", "reference_order_id": "U", "mpid": "F"}),
    "pitch_all_types": _all_types_sql(PITCH_LETTERS, {"A": 0, "d": 1, "1": 1, "E": 2, "X": 4, "P": 7, "r": 7, "2": 7}, {"symbol": "Ad1Pr2", "order_id": PITCH_LETTERS, "match_id": "EPr2", "qty": PITCH_LETTERS, "price": "Ad1Pr2", "side": "Ad1Pr2", "mpid": "d1"}, f"(ns // 1000000) % {DAY_MS} * 1000000"),
    "deep_all_types": _all_types_sql(DEEP_LETTERS, {"a": 0, "M": 6, "R": 5, "L": 3, "T": 7, "S": 10, "E": 10}, {"symbol": "aMRLTE", "order_id": "aMRL", "match_id": "LT", "qty": "aMLT", "price": "aMLT", "side": "a"}),
    "damaged_journal": tape_sql(_RECORDS, f"""SELECT record, CASE WHEN {_BAD} THEN 'record_crc' ELSE 'ok' END status, CASE
        WHEN NOT {_BAD} THEN symbol END symbol, CASE WHEN NOT {_BAD} THEN order_id END order_id FROM rec
        UNION ALL SELECT count(*), 'unexpected_eof', NULL, NULL FROM rec"""),
    "failsafe_journal": tape_sql(_RECORDS, f"SELECT record, symbol, order_id, qty, price FROM rec WHERE NOT {_BAD}"),
    "journal_data_loss": tape_sql(_RECORDS, f"SELECT 'sound' journal, 'OK' code, CAST(NULL AS VARCHAR) reason, CAST(0 AS BIGINT) bad UNION ALL "
        f"SELECT 'damaged', 'DATA_LOSS', 'record_crc', count(*) FILTER ({_BAD}) + 1 FROM rec"),
    "crypto_resync_stats": f"""WITH {_FRAMES}
SELECT symbol, count(*) FILTER (snap) snapshots, count(DISTINCT CASE WHEN lost AND epoch > 0 THEN epoch END) gaps, count(*) FILTER (NOT snap
        AND lost) - count(DISTINCT CASE WHEN lost AND epoch > 0 THEN epoch END) ignored,
    count(*) FILTER (NOT snap AND NOT lost) applied FROM lo GROUP BY symbol""",
    "crypto_resync_events": f"""WITH {_FRAMES},
w AS (SELECT *, lag({{'g': gone, 'p': px, 'q': q}}) OVER (PARTITION BY symbol, epoch, user_id ORDER BY event_id) was FROM lo
        WHERE NOT lost AND (gone OR value BETWEEN 0 AND 4294967295 / 10000.0::DOUBLE))
SELECT event_id * 65536 arrival, symbol, CASE WHEN gone THEN 4 WHEN was IS NOT NULL AND NOT was.g THEN 6
        ELSE 0 END event_type, number AS sequence, user_id order_id, CASE WHEN gone THEN 0 ELSE q END qty, CASE WHEN gone THEN 0 ELSE px END price,
    CASE WHEN NOT gone AND was IS NOT NULL AND NOT was.g THEN was.q ELSE 0 END prev_qty, CASE WHEN NOT gone AND was IS NOT NULL AND NOT was.g THEN was.p
        ELSE 0 END prev_price, side FROM w WHERE NOT gone OR (was IS NOT NULL AND NOT was.g)""",
}
