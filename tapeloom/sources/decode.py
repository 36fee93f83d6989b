"""Venue messages to canonical events, vectorised over Arrow batches.

A layout names, for each message type, the event type, the size and where its fields lie. The messages of one type in a batch are one
matrix of bytes, and a field is a few numpy operations on its columns, so no Python code runs by message. (Catalyst expressions over
substring, hex and conv give the same rows at a fraction of the speed, as each field goes through strings.)
Input rows have payload (binary), sequence, ingest_ts_ns and arrival.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tapeloom.schema import ADD, ADD_MPID, BOOK_EVENTS, BUY, CANCEL, COLUMNS, CROSS_TRADE, DELETE, DIRECTORY, EXECUTE, EXECUTE_PRICE, IMBALANCE, REPLACE, SELL, SYSTEM, TRADE, U32, UNKNOWN_SIDE, UNKNOWN_TYPE, VENUES, canonical

Reader = Callable[[np.ndarray], np.ndarray]  # a matrix of bytes, a row a message -> a value a message


# -- reading fields -----------------------------------------------------------------------------------------------
def big_endian(at: int, n: int) -> Reader:
    """Unsigned number; 8 bytes wrap to signed."""

    def read(m):
        wide = np.zeros((len(m), 8), np.uint8)
        wide[:, 8 - n :] = m[:, at : at + n]
        return wide.view(">i8")[:, 0].astype(np.int64)

    return read


def little_endian(at: int, n: int) -> Reader:
    def read(m):
        wide = np.zeros((len(m), 8), np.uint8)
        wide[:, :n] = m[:, at : at + n]
        return wide.view("<i8")[:, 0]

    return read


def text(at: int, n: int) -> Reader:
    """Trimmed of spaces and NULs at its end; the distinct values are decoded once a batch."""

    def read(m):
        raw = np.ascontiguousarray(m[:, at : at + n]).view(f"S{n}")[:, 0]
        distinct, back = np.unique(raw, return_inverse=True)
        return np.array([x.decode("latin-1").rstrip(" \x00") for x in distinct.tolist()], object)[back]

    return read


def digits(at: int, n: int) -> Reader:
    """Decimal digits; 0 if there is anything else."""

    def read(m):
        d = m[:, at : at + n] - np.uint8(48)
        return np.where((d <= 9).all(1), d.astype(np.int64) @ (10 ** np.arange(n - 1, -1, -1, dtype=np.int64)), 0)

    return read


def base36(at: int, n: int = 12) -> Reader:
    """Digits and capitals in base 36; 0 if there is anything else."""

    def read(m):
        c = m[:, at : at + n].astype(np.int64)
        d = np.where((c >= 48) & (c <= 57), c - 48, np.where((c >= 65) & (c <= 90), c - 55, -1))
        return np.where((d >= 0).all(1), d @ (36 ** np.arange(n - 1, -1, -1, dtype=np.int64)), 0)

    return read


def then(read: Reader, change: Callable[[np.ndarray], np.ndarray]) -> Reader:
    return lambda m: change(read(m))


def saturated(value: np.ndarray) -> np.ndarray:
    """A price that does not fit 32 bits is the largest that does; one that wrapped to a negative number did not fit."""
    return np.where((value > U32) | (value < 0), U32, value)


def low32(value: np.ndarray) -> np.ndarray:
    return value & U32


def side(at: int, buy: str, sell: str) -> Reader:
    return lambda m: np.where(m[:, at] == ord(buy), BUY, np.where(m[:, at] == ord(sell), SELL, UNKNOWN_SIDE))


# -- layouts ------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Layout:
    venue: int
    type_at: int
    exact: bool
    least: int
    #: type letter -> (event type, size, field -> reader)
    messages: dict = field(hash=False)


def _itch() -> Layout:
    """Offsets from the type letter; the time is six bytes at 5 in every message."""
    be, time = big_endian, {"exchange_ts_ns": big_endian(5, 6)}
    order = time | {"order_id": be(11, 8)}
    add = order | {"side": side(19, "B", "S"), "qty": be(20, 4), "symbol": text(24, 8), "price": be(32, 4)}
    taken = order | {"qty": be(19, 4)}
    messages = {
        "A": (ADD, 36, add),
        "F": (ADD_MPID, 40, add | {"mpid": text(36, 4)}),
        "E": (EXECUTE, 31, taken | {"match_id": be(23, 8)}),
        "C": (EXECUTE_PRICE, 36, taken | {"match_id": be(23, 8), "price": be(32, 4)}),
        "X": (CANCEL, 23, taken),
        "D": (DELETE, 19, order),
        "U": (REPLACE, 35, time | {"reference_order_id": be(11, 8), "order_id": be(19, 8), "qty": be(27, 4), "price": be(31, 4)}),
        "P": (TRADE, 44, add | {"match_id": be(36, 8)}),
        "Q": (CROSS_TRADE, 40, time | {"qty": then(be(11, 8), low32), "symbol": text(19, 8), "price": be(27, 4), "match_id": be(31, 8)}),
        "I": (IMBALANCE, 50, time | {"qty": then(be(19, 8), low32), "symbol": text(28, 8)}),
        "S": (SYSTEM, 12, time),
        "R": (DIRECTORY, 39, time | {"symbol": text(11, 8)}),
    }
    return Layout(VENUES["NASDAQ"], 0, False, 1, messages)


def _pitch() -> Layout:
    """ASCII fields from the start of the line; the time is milliseconds in eight digits at 0."""
    price = lambda at: then(digits(at, 10), saturated)
    long_price = lambda at: then(digits(at, 14), lambda v: saturated(v // 100))
    order = {"exchange_ts_ns": then(digits(0, 8), lambda v: v * 1_000_000), "order_id": base36(9)}
    sided = order | {"side": side(21, "B", "S"), "qty": digits(22, 6)}
    messages = {
        "A": (ADD, 45, sided | {"symbol": text(28, 6), "price": price(34)}),
        "d": (ADD_MPID, 52, sided | {"symbol": text(28, 8), "price": price(36), "mpid": text(47, 4)}),
        "1": (ADD_MPID, 56, sided | {"symbol": text(28, 8), "price": long_price(36), "mpid": text(51, 4)}),
        "E": (EXECUTE, 39, order | {"qty": digits(21, 6), "match_id": base36(27)}),
        "X": (CANCEL, 27, order | {"qty": digits(21, 6)}),
        "P": (TRADE, 56, sided | {"symbol": text(28, 6), "price": price(34), "match_id": base36(44)}),
        "r": (TRADE, 58, sided | {"symbol": text(28, 8), "price": price(36), "match_id": base36(46)}),
        "2": (TRADE, 62, sided | {"symbol": text(28, 8), "price": long_price(36), "match_id": base36(50)}),
    }
    return Layout(VENUES["CBOE"], 8, True, 9, messages)


def _deep() -> Layout:
    """Little-endian fields from the type letter; the time is eight bytes at 2."""
    le, time = little_endian, {"exchange_ts_ns": little_endian(2, 8)}
    named = time | {"symbol": text(10, 8)}
    price = lambda at: then(little_endian(at, 8), saturated)
    order = named | {"order_id": le(18, 8)}
    sized = order | {"qty": le(26, 4), "price": price(30)}
    messages = {
        "S": (SYSTEM, 10, time),
        "E": (SYSTEM, 18, named),
        "a": (ADD, 38, sized | {"side": side(1, "8", "5")}),
        "M": (REPLACE, 38, sized),
        "R": (DELETE, 26, order),
        "L": (EXECUTE_PRICE, 46, sized | {"match_id": le(38, 8)}),
        "T": (TRADE, 38, named | {"qty": le(18, 4), "price": price(22), "match_id": le(30, 8)}),
    }
    return Layout(VENUES["IEX"], 0, True, 1, messages)


ITCH, PITCH, DEEP = _itch(), _pitch(), _deep()
LAYOUTS = {"itch": ITCH, "pitch": PITCH, "deep": DEEP}
_ARROW = {"bigint": pa.int64(), "smallint": pa.int16(), "string": pa.string()}


def decode_batch(payload: pa.Array, layout: Layout) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Fields of a batch of messages that the layout gives, and their status."""
    payload = pa.concat_arrays([payload.fill_null(b"")])  # without an offset
    n = len(payload)
    starts = np.frombuffer(payload.buffers()[1], np.int64 if pa.types.is_large_binary(payload.type) else np.int32, n + 1).astype(np.int64)
    data = np.frombuffer(payload.buffers()[2] or b"", np.uint8)
    size = np.diff(starts)
    letter = np.zeros(n, np.uint8)
    lettered = size > layout.type_at
    letter[lettered] = data[starts[:-1][lettered] + layout.type_at]
    status = np.where(size < layout.least, "malformed", "unknown").astype(object)
    out = {"event_type": np.full(n, UNKNOWN_TYPE, np.int64), "raw_type": letter.astype(np.int64), "side": np.full(n, UNKNOWN_SIDE, np.int64), "symbol": np.full(n, "", object), "mpid": np.full(n, None, object)}
    for t, (kind, width, fields) in layout.messages.items():
        own = lettered & (letter == ord(t)) & (size >= layout.least)
        fits = own & ((size == width) if layout.exact else (size >= width))
        status[own & ~fits] = "malformed"
        rows = np.flatnonzero(fits)
        if not len(rows):
            continue
        status[rows] = "ok"
        out["event_type"][rows] = kind
        matrix = data[starts[rows][:, None] + np.arange(width)]
        for name, read in fields.items():
            if name not in out:
                out[name] = np.zeros(n, np.int64)
            out[name][rows] = read(matrix)
    return out, status


def decode(messages: DataFrame, layout: Layout, keep_malformed: bool = False) -> DataFrame:
    """Canonical events and status: ok, unknown (a type that is not in the layout; the event is kept) or malformed (dropped unless asked for)."""
    kinds = [(f.name, f.dataType.simpleString()) for f in BOOK_EVENTS]

    def run(batches):
        for b in batches:
            found, status = decode_batch(b.column("payload"), layout)
            keep = np.arange(b.num_rows) if keep_malformed else np.flatnonzero(status != "malformed")
            cells = []
            for name, kind in kinds:
                if name in ("arrival", "sequence", "ingest_ts_ns"):
                    cells.append(b.column(name).take(pa.array(keep)))
                elif name == "venue":
                    cells.append(pa.array(np.full(len(keep), layout.venue, np.int16)))
                elif name in found:
                    cells.append(pa.array(found[name][keep], from_pandas=True).cast(_ARROW[kind]))
                else:
                    cells.append(pa.array(np.zeros(len(keep), np.int64)).cast(_ARROW[kind]))
            yield pa.RecordBatch.from_arrays([*cells, pa.array(status[keep], pa.string())], [*COLUMNS, "status"])

    schema = ", ".join(f"{n} {k}" for n, k in kinds) + ", status string"
    cells = [F.col(c).cast("long").alias(c) for c in ("arrival", "sequence", "ingest_ts_ns")]
    return messages.select(*cells, F.col("payload").cast("binary").alias("payload")).mapInArrow(run, schema)


def parse_stats(messages: DataFrame, layout: Layout) -> DataFrame:
    """Counts by type letter and status."""
    return decode(messages, layout, True).groupBy("raw_type", "status").agg(F.count("*").alias("n"))


def as_messages(payloads: DataFrame, ingest_ts_ns: int = 0) -> DataFrame:
    """(arrival, payload) as decoder input, with the arrival as the sequence."""
    return payloads.select("arrival", "payload", F.col("arrival").alias("sequence"), F.lit(ingest_ts_ns).cast("long").alias("ingest_ts_ns"))


# -- packets of many messages ---------------------------------------------------------------------------------------
TEMPLATE_BOOK = 32
_NULL_PRICE, _NULL_ID = (1 << 63) - 1, (1 << 31) - 1
_ACTIONS = {0: ADD, 1: REPLACE, 2: DELETE, 3: DELETE, 4: DELETE}


def sbe_packet(packet: bytes, stats: dict | None = None) -> list[tuple]:
    """(event_type, sequence, time, symbol, qty, price, side) of the book entries of one packet."""
    stats = {} if stats is None else stats

    def count(what):
        stats[what] = stats.get(what, 0) + 1

    num = lambda at, n, signed=False: int.from_bytes(packet[at : at + n], "little", signed=signed)
    if len(packet) < 12:
        count("malformed")
        return []
    packet_seq, sent, at, out = num(0, 4), num(4, 8), 12, []
    while at + 10 <= len(packet):
        size, template = num(at, 2), num(at + 4, 2)
        if size < 10 or at + size > len(packet):
            count("malformed")
            break
        count("parsed")
        count(f"template {template % 256}")
        start, end = at + 10, at + size
        at = end
        if template != TEMPLATE_BOOK:
            continue
        if end - start < 14:
            count("malformed")
            continue
        time, width, entries = num(start, 8) or sent, num(start + 11, 2), num(start + 13, 1)
        if width < 32 or start + 14 + entries * width > end:
            count("malformed")
            continue
        for i in range(entries):
            e = start + 14 + i * width
            kind = chr(packet[e + 26])
            if kind == "J":  # implied
                continue
            price, qty, security, report = num(e, 8, True), num(e + 8, 4, True), num(e + 12, 4, True), num(e + 16, 4)
            ticks = 0 if price == _NULL_PRICE else max(0, min(price // 100_000 if price > 0 else 0, U32))
            symbol = "" if security == _NULL_ID else str(security)[:8]
            out.append((_ACTIONS.get(packet[e + 25], UNKNOWN_TYPE), report or packet_seq << 32 | i, time, symbol, max(qty, 0), ticks, {"0": BUY, "1": SELL}.get(kind, UNKNOWN_SIDE)))
            count("book events")
    return out


def _numbers(data: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    """Little-endian numbers at places of a batch's bytes."""
    form = np.dtype(kind)
    return data[at[:, None] + np.arange(form.itemsize)].view(form)[:, 0] if len(at) else np.zeros(0, form)


def sbe_columns(payload: pa.Array) -> dict[str, np.ndarray]:
    """What sbe_packet gives, for a batch of packets at once, with the packet of each entry and its number in it.

    The first messages of all packets are looked at together, then the second ones, and so on; the entries of all book messages
    are then laid out by their counts and widths, and a field is one gather.
    """
    payload = pa.concat_arrays([payload.fill_null(b"")]).cast(pa.large_binary())
    bounds = np.frombuffer(payload.buffers()[1], np.int64, len(payload) + 1)
    data = np.frombuffer(payload.buffers()[2] or b"", np.uint8)
    begin, end = bounds[:-1], bounds[1:]
    packet = np.flatnonzero(end - begin >= 12)
    at, found = begin[packet] + 12, []
    while len(packet):
        fits = at + 10 <= end[packet]
        packet, at = packet[fits], at[fits]
        size = _numbers(data, at, "<u2").astype(np.int64)
        sound = (size >= 10) & (at + size <= end[packet])
        packet, at, size = packet[sound], at[sound], size[sound]
        found.append((packet, at + 10, at + size, _numbers(data, at + 4, "<u2")))
        at = at + size
    owner, start, stop, template = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))
    book = (template == TEMPLATE_BOOK) & (stop - start >= 14)
    owner, start, stop = owner[book], start[book], stop[book]
    time, width, entries = _numbers(data, start, "<u8").view(np.int64), _numbers(data, start + 11, "<u2").astype(np.int64), _numbers(data, start + 13, "u1").astype(np.int64)
    sound = (width >= 32) & (start + 14 + entries * width <= stop)
    owner, start, time, width, entries = owner[sound], start[sound], time[sound], width[sound], entries[sound]
    order = np.lexsort((start, owner))  # a packet's messages in a row
    owner, start, time, width, entries = owner[order], start[order], time[order], width[order], entries[order]
    message = np.repeat(np.arange(len(owner)), entries)
    nth = np.arange(len(message)) - np.repeat(np.cumsum(entries) - entries, entries)
    e = start[message] + 14 + nth * width[message]
    kind = data[e + 26]
    real = kind != ord("J")  # implied
    e, kind, message, nth = e[real], kind[real], message[real], nth[real]
    of = owner[message]
    price, qty, security, report = _numbers(data, e, "<i8"), _numbers(data, e + 8, "<i4").astype(np.int64), _numbers(data, e + 12, "<i4"), _numbers(data, e + 16, "<u4").astype(np.int64)
    actions = np.full(256, UNKNOWN_TYPE, np.int64)
    actions[list(_ACTIONS)] = list(_ACTIONS.values())
    sides = np.full(256, UNKNOWN_SIDE, np.int64)
    sides[[ord("0"), ord("1")]] = BUY, SELL
    packet_seq, sent = _numbers(data, begin[of], "<u4").astype(np.int64), _numbers(data, begin[of] + 4, "<u8").view(np.int64)
    names, back = np.unique(security, return_inverse=True)
    first = np.searchsorted(of, of)
    return {
        "packet": of,
        "nth": np.arange(len(of)) - first,
        "event_type": actions[data[e + 25]],
        "sequence": np.where(report != 0, report, packet_seq << 32 | nth),
        "ts": np.where(time[message] != 0, time[message], sent),
        "symbol": np.array(["" if n == _NULL_ID else str(n)[:8] for n in names.tolist()], object)[back],
        "qty": np.maximum(qty, 0),
        "price": np.where((price == _NULL_PRICE) | (price <= 0), 0, np.minimum(price // 100_000, U32)),
        "side": sides[kind],
    }


_SBE = "arrival long, ingest long, event_type short, sequence long, ts long, symbol string, qty long, price long, side short"


def decode_sbe(packets: DataFrame) -> DataFrame:
    """Canonical events of (arrival, payload, ingest_ts_ns) packets; arrival is the packet's times 256 plus the entry's number."""

    def expand(batches):
        kinds = {"long": pa.int64(), "short": pa.int16(), "string": pa.string()}
        for b in batches:
            found = sbe_columns(b.column("payload"))
            of = pa.array(found["packet"])
            found["arrival"] = b.column("arrival").take(of).to_numpy() * 256 + found["nth"]
            found["ingest"] = b.column("ingest_ts_ns").take(of)
            named = [c.split() for c in _SBE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(found[n]).cast(kinds[t]) for n, t in named], [n for n, _ in named])

    flat = packets.select("arrival", F.col("payload").cast("binary").alias("payload"), "ingest_ts_ns").mapInArrow(expand, _SBE)
    return flat.select(*canonical(arrival="arrival", venue=F.lit(VENUES["CME"]), event_type="event_type", sequence="sequence", exchange_ts_ns="ts", ingest_ts_ns="ingest", symbol="symbol", order_id="sequence", qty="qty", price="price", side="side", raw_type=F.lit(TEMPLATE_BOOK)))


# -- the way back: messages from events, for tests and captures -------------------------------------------------------
def itch_payload(event_type: Column) -> Column:
    """Bytes of the ITCH message of a canonical event; null for types that have none. Exact inverse of the decoder for these types."""
    hexed = lambda c, n: F.lpad(F.hex(c.cast("long")), 2 * n, "0")
    h = lambda name, n: F.substring(hexed(F.col(name), n), -2 * n, 2 * n)
    letter = lambda t: F.lit(t.encode().hex())
    sym = F.hex(F.rpad(F.col("symbol"), 8, " ").cast("binary"))
    side = F.when(F.col("side") == BUY, F.lit("42")).when(F.col("side") == SELL, F.lit("53")).otherwise(F.lit("20"))
    head = [F.lit("00000000"), h("exchange_ts_ns", 6)]
    order = [*head, h("order_id", 8)]
    add = [*order, side, h("qty", 4), sym, h("price", 4)]
    bodies = {
        ADD: [letter("A"), *add],
        EXECUTE: [letter("E"), *order, h("qty", 4), h("match_id", 8)],
        EXECUTE_PRICE: [letter("C"), *order, h("qty", 4), h("match_id", 8), F.lit("59"), h("price", 4)],
        CANCEL: [letter("X"), *order, h("qty", 4)],
        DELETE: [letter("D"), *order],
        REPLACE: [letter("U"), *head, h("reference_order_id", 8), h("order_id", 8), h("qty", 4), h("price", 4)],
        TRADE: [letter("P"), *add, h("match_id", 8)],
    }
    out = F.lit(None).cast("string")
    for kind, parts in bodies.items():
        out = F.when(event_type == kind, F.concat(*parts)).otherwise(out)
    return F.unhex(out)


__all__ = ["COLUMNS", "DEEP", "ITCH", "LAYOUTS", "PITCH", "as_messages", "decode", "decode_sbe", "itch_payload", "parse_stats", "sbe_columns", "sbe_packet"]
