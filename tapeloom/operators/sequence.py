"""Sequencing, arbitration, merge order and comparison of tapes."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tapeloom.functions.ranks import global_rank, last_before, running_max_before
from tapeloom.operators.walks import Walker, walk

IN_ORDER, DUPLICATE, GAP_BUFFERED, GAP_TOO_LARGE = "in_order", "duplicate", "gap_buffered", "gap_too_large"
LOOKBACK = 64
ORDER = ["arrival", "sequence"]  # what arrives at once is met in order of sequence


# -- set-oriented forms -------------------------------------------------------------------------------------------
def forward_fill_time(events: DataFrame, by: list[str] = ()) -> DataFrame:
    """Times of 0 inherit the last time before, of all or of their own keys."""
    time = F.nullif(F.col("exchange_ts_ns"), F.lit(0))
    if not by:
        filled = last_before(events.withColumn("__time", time), "arrival", "__time", "__last")
        known = F.coalesce("__time", "__last", F.lit(0).cast("long"))
        return filled.withColumn("exchange_ts_ns", known).drop("__time", "__last")
    w = Window.partitionBy(*by).orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last(time, ignorenulls=True).over(w)
    return events.withColumn("exchange_ts_ns", F.coalesce(filled, F.lit(0).cast("long")))


def clock_filter(events: DataFrame, by: list[str] = ()) -> DataFrame:
    """Adds rejected: whether an event is older than one that arrived before it, of all or of its own keys."""
    if not by:
        seen = running_max_before(events, "arrival", "exchange_ts_ns", "__seen")
        return seen.withColumn("rejected", F.col("exchange_ts_ns") < F.coalesce("__seen", F.lit(0).cast("long"))).drop("__seen")
    w = Window.partitionBy(*by).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("rejected", F.col("exchange_ts_ns") < F.coalesce(F.max("exchange_ts_ns").over(w), F.lit(0).cast("long")))


def arbitrate(copies: DataFrame) -> DataFrame:
    """The first copy of each venue's sequence number; loses none. A minimum by key, combined before the shuffle."""
    rest = [c for c in copies.columns if c not in ("venue", "sequence", "arrival")]
    first = copies.groupBy("venue", "sequence").agg(F.min(F.struct("arrival", *rest)).alias("f"))
    return first.select("venue", "sequence", "f.*").select(*copies.columns)


def accepted_by_feed(copies: DataFrame) -> DataFrame:
    return arbitrate(copies).groupBy("feed").agg(F.count("*").alias("accepted"))


def gap_report(events: DataFrame) -> DataFrame:
    """(venue, gap_begin, gap_end, missing): sequence numbers from 1 that never arrive."""
    distinct = events.select("venue", "sequence").where("sequence > 0").distinct()
    begin = F.coalesce(F.lag("sequence").over(Window.partitionBy("venue").orderBy("sequence")), F.lit(0)) + 1
    gaps = distinct.withColumn("gap_begin", begin).withColumn("gap_end", F.col("sequence") - 1).where("gap_end >= gap_begin")
    return gaps.withColumn("missing", F.col("gap_end") - F.col("gap_begin") + 1).drop("sequence")


def merge_order(events: DataFrame, rank: bool = True) -> DataFrame:
    """The order in which a greedy merge of the venues' queues by (time, venue, sequence, type) releases events.

    An event waits for all before it in its venue, so its key is the largest of its venue so far. merge_rank is from 1.
    """
    key = F.struct(F.col("exchange_ts_ns").alias("t"), F.col("venue").alias("v"), F.col("sequence").alias("s"), F.col("raw_type").alias("r"))
    w = Window.partitionBy("venue").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    keyed = events.withColumn("__k", F.max(key).over(w)).withColumn("__t", F.col("__k.t"))
    if not rank:
        return keyed.orderBy("__k", "arrival").drop("__k", "__t")
    return global_rank(keyed, "__t", ["__k", "arrival"], "merge_rank").drop("__k", "__t")


def diff(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys on which two tapes differ, nulls equal to each other."""
    left, right = a.select(*key, F.struct(*values).alias("x")), b.select(*key, F.struct(*values).alias("y"))
    met = left.join(right, key, "full_outer")
    kind = F.when(F.col("y").isNull(), "left only").when(F.col("x").isNull(), "right only").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return met.withColumn("difference", kind).where("difference IS NOT NULL")


def first_difference(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    return diff(a, b, key, values).orderBy(*key).limit(1)


def divergence(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    kinds = {"changed": "changed", "left_only": "left only", "right_only": "right only"}
    return diff(a, b, key, values).agg(*(F.count(F.when(F.col("difference") == v, 1)).alias(k) for k, v in kinds.items()), F.count("*").alias("total"))


# -- the tracker as a state machine -------------------------------------------------------------------------------
@dataclass
class Tracker:
    """Sequence state of one venue: what comes next, what is held back, and a bounded memory of what came.

    Compat mode jumps to an event that is too far ahead without publishing it; it may come back from memory when its successor
    arrives. Strict mode publishes it.
    """

    window: int
    compat: bool = False
    next: int = 1
    held: dict = field(default_factory=dict)
    memory: dict = field(default_factory=dict)
    stats: dict = field(default_factory=lambda: dict.fromkeys(("accepted", "duplicate", "buffered", "too_large", "evicted", "requests", "reinjected"), 0))

    def _release(self, out: list) -> None:
        while self.next in self.held:
            out.append(self.held.pop(self.next))
            self.next += 1

    def _remember(self, seq: int, event) -> None:
        self.memory[seq] = event
        if len(self.memory) > self.window + LOOKBACK:
            del self.memory[min(self.memory)]

    def observe(self, seq: int, event) -> tuple[str, tuple | None, list]:
        """Status, the missing range if any, and the events that are released."""
        out: list = []
        if seq == 0 or seq < self.next:
            self.stats["duplicate"] += 1
            return DUPLICATE, None, out
        self._remember(seq, event)
        if seq == self.next:
            self.next += 1
            out.append(event)
            self._release(out)
            self.stats["accepted"] += len(out)
            return IN_ORDER, None, out
        missing = self.next, seq - 1
        if seq - self.next <= self.window:
            if seq in self.held:
                self.stats["duplicate"] += 1
                return DUPLICATE, None, out
            self.held[seq] = event
            self.stats["buffered"] += 1
            self.stats["requests"] += 1
            for s in range(missing[0], missing[1] + 1):  # recovery: what memory has is given back
                if s in self.memory and s not in self.held:
                    self.held[s] = self.memory[s]
                    self.stats["reinjected"] += 1
            self._release(out)
            self.stats["accepted"] += len(out)
            return GAP_BUFFERED, missing, out
        self.stats["too_large"] += 1
        self.stats["requests"] += 1
        self.force(seq)
        if not self.compat:
            self.next += 1
            out.append(event)
            self._release(out)
            self.stats["accepted"] += len(out)
        return GAP_TOO_LARGE, missing, out

    def force(self, seq: int) -> None:
        """Goes on at `seq`; what was held back before it is dropped."""
        old = [s for s in self.held if s < seq]
        for s in old:
            del self.held[s]
        self.stats["evicted"] += len(old)
        self.next = max(self.next, seq)


class ReleaseWalk(Walker):
    """One venue's arrivals. Rows that may still be released wait in the state: those that are held back, and those that the
    tracker's memory may give back, so a window and its slack at most."""

    def __init__(self, window: int, compat: bool):
        self.tracker, self.n, self.seen, self.waiting = Tracker(window, compat), 0, 0, {}

    def feed(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        first, status, release, late = self.seen, [], [None] * rows.num_rows, []
        for number, seq in enumerate(rows.column("sequence").to_pylist(), first):
            kind, _, out = self.tracker.observe(seq, number)
            status.append(kind)
            for r in out:
                self.n += 1
                if r >= first:
                    release[r - first] = self.n
                else:
                    late.append((*self.waiting.pop(r), self.n))
        self.seen += rows.num_rows
        alive = {*self.tracker.held.values(), *self.tracker.memory.values()}
        late += [(*self.waiting.pop(n), None) for n in self.waiting.keys() - alive]
        known = [i for i, n in enumerate(release) if n is not None or i + first not in alive]
        for i in set(range(rows.num_rows)).difference(known):
            self.waiting[i + first] = rows.take(pa.array([i])), status[i]  # a copy, so that the batch may go
        taken = rows.take(pa.array(known, pa.int64()))
        done = self._out(taken, [status[i] for i in known], [release[i] for i in known])
        return pa.concat_batches([done, *(self._out(r, [k], [n]) for r, k, n in late)])

    def end(self) -> pa.RecordBatch | None:
        left = [self._out(r, [k], [None]) for r, k in self.waiting.values()]
        return pa.concat_batches(left) if left else None

    @staticmethod
    def _out(rows: pa.RecordBatch, status: list, release: list) -> pa.RecordBatch:
        cells = [*rows.columns, pa.array(status, pa.string()), pa.array(release, pa.int64())]
        return pa.RecordBatch.from_arrays(cells, [*rows.schema.names, "status", "release"])


def sequenced(events: DataFrame, window: int = 1024, compat: bool = False) -> DataFrame:
    """Events in the order in which each venue's tracker releases them, as release (from 1), and the status that each met on arrival."""
    types = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    return walk(events, ["venue"], ORDER, partial(ReleaseWalk, window, compat), f"{types}, status string, release long")


class StatsWalk(Walker):
    def __init__(self, window: int, compat: bool):
        self.tracker, self.venue = Tracker(window, compat), None

    def feed(self, rows: pa.RecordBatch) -> None:
        self.venue = rows.column("venue")[0].as_py()
        for seq in rows.column("sequence").to_pylist():
            self.tracker.observe(seq, seq)

    def end(self) -> pa.RecordBatch:
        names = list(self.tracker.stats)
        return pa.RecordBatch.from_arrays([pa.array([self.venue], pa.int16()), *(pa.array([self.tracker.stats[n]], pa.int64()) for n in names)], ["venue", *names])


def tracker_stats(events: DataFrame, window: int = 1024, compat: bool = False) -> DataFrame:
    schema = "venue short, " + ", ".join(f"{n} long" for n in Tracker(1).stats)
    return walk(events.select("venue", "sequence", "arrival"), ["venue"], ORDER, partial(StatsWalk, window, compat), schema)


class RequestWalk(Walker):
    """One venue's arrivals with their status, and the range of numbers that each of them asks for."""

    def __init__(self, window: int, compat: bool):
        self.tracker = Tracker(window, compat)

    def feed(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        seen = [self.tracker.observe(seq, seq)[:2] for seq in rows.column("sequence").to_pylist()]
        begin, end = ([gap and gap[k] for _, gap in seen] for k in (0, 1))
        cells = [rows.column(c) for c in ("venue", "arrival", "sequence")]
        cells += [pa.array([s for s, _ in seen], pa.string()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())]
        return pa.RecordBatch.from_arrays(cells, ["venue", "arrival", "sequence", "status", "gap_begin", "gap_end"])


def observed(events: DataFrame, window: int = 1024, compat: bool = False) -> DataFrame:
    """(venue, arrival, sequence, status, gap_begin, gap_end) of every arrival: what its venue's tracker says of it, and asks for."""
    schema = "venue short, arrival long, sequence long, status string, gap_begin long, gap_end long"
    return walk(events.select("venue", "arrival", "sequence"), ["venue"], ORDER, partial(RequestWalk, window, compat), schema)


REASONS = {GAP_BUFFERED: "gap_detected", GAP_TOO_LARGE: "gap_too_large"}


def requests(seen: DataFrame) -> DataFrame:
    """Of observed(): (venue, arrival, gap_begin, gap_end, missing, reason) of every request for recovery."""
    reason = F.element_at(F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair)), F.col("status"))
    asked = seen.where(F.col("status").isin(*REASONS))
    return asked.select("venue", "arrival", "gap_begin", "gap_end", (F.col("gap_end") - F.col("gap_begin") + 1).alias("missing"), reason.alias("reason"))


def recovered(seen: DataFrame, window: int = 1024) -> DataFrame:
    """Of observed(): (venue, requested_at, sequence, stored_at, reinjected): stored events that a request finds in its range.

    A request for too many numbers is not answered. The store holds the last window + LOOKBACK numbers of a venue, of a number that
    came more than once the latest event before the request. An event that is still held back is found but not given back again; one
    that the tracker jumped over (in compat mode) is, and is released by that.

    An interval join: ranges of `window` numbers at most and stored numbers meet in buckets of `window` numbers, two a range at most.
    """
    at = lambda c: F.floor(F.col(c) / window)
    kept = seen.select("venue", F.col("sequence").alias("number"), F.col("arrival").alias("stored_at"), "status", at("sequence").alias("bucket"))
    asked = requests(seen).where(F.col("reason") == REASONS[GAP_BUFFERED]).withColumnRenamed("arrival", "requested_at")
    asked = asked.withColumn("bucket", F.explode(F.sequence(at("gap_begin"), at("gap_end"))))
    horizon = F.col("number") > F.col("gap_end") - (window + LOOKBACK)
    # A number of the range is less than the request's own, so at one arrival it comes first.
    met = asked.join(kept, ["venue", "bucket"]).where("number BETWEEN gap_begin AND gap_end AND stored_at <= requested_at").where(horizon)
    latest = met.groupBy("venue", "requested_at", F.col("number").alias("sequence")).agg(F.max(F.struct("stored_at", "status")).alias("s"))
    return latest.select("venue", "requested_at", "sequence", F.col("s.stored_at").alias("stored_at"), (F.col("s.status") == GAP_TOO_LARGE).alias("reinjected"))


# -- witness ------------------------------------------------------------------------------------------------------
def _combine(a: int, b: int, length: int) -> int:
    """CRC-32 of two strings in a row from their CRCs and the second's length: a's is carried over `length` zero bytes by squaring."""
    if not length:
        return a
    odd = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit

    def times(m, v):
        out = 0
        for row in m:
            if v & 1:
                out ^= row
            v >>= 1
            if not v:
                break
        return out

    square = lambda m: [times(m, row) for row in m]
    power = square(square(odd))  # four zero bits
    while length:
        power = square(power)
        if length & 1:
            a = times(power, a)
        length >>= 1
    return a ^ b


#: The bytes of an event, little-endian: venue, type, sequence, time, symbol, order id, quantity and price.
WITNESS = np.dtype([("venue", "u1"), ("event_type", "u1"), ("sequence", "<u8"), ("exchange_ts_ns", "<u8"), ("symbol", "S8"), ("order_id", "<u8"), ("qty", "<u4"), ("price", "<u4")])


def witness_bytes(batch: pa.RecordBatch) -> bytes:
    """A batch's events as one matrix of bytes; symbols are filled up with spaces."""
    rows = np.empty(batch.num_rows, WITNESS)
    for name in WITNESS.names:
        if name == "symbol":
            rows[name] = np.char.ljust(np.array(batch.column(name).to_pylist(), "S8"), 8, b" ")
        else:
            rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
    return rows.tobytes()


def chained_crc(rows: DataFrame, to_bytes, width: int, order: str = "arrival", parts: int | None = None) -> DataFrame:
    """One row, crc and events: the chained CRC-32 of all rows in order, each `width` bytes that `to_bytes` gives for a batch.

    Ranges of the order are summed by tasks, as many as Spark makes of them (or `parts`). The CRC of texts in a row is the exclusive or of
    each one's, carried over as many zero bytes as stand after it; so ranges are carried each by itself, and the rest is Spark's bit_xor.
    """

    def crc(batches):
        value, n, first = 0, 0, None
        for b in batches:
            if b.num_rows and first is None:
                first = b.column("__order")[0].as_py()
            value, n = zlib.crc32(to_bytes(b), value), n + b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([value]), pa.array([n])], ["first", "crc", "n"])

    def carry(batches):
        for b in batches:
            carried = [_combine(c, 0, k * width) for c, k in zip(b.column("crc").to_pylist(), b.column("after").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(carried, pa.int64()), b.column("n")], ["crc", "n"])

    dealt = [parts] if parts else []
    ranged = rows.withColumn("__order", F.col(order).cast("long")).repartitionByRange(*dealt, "__order").sortWithinPartitions("__order")
    ranges = ranged.mapInArrow(crc, "first long, crc long, n long")
    after = F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).cast("long")  # a row a range
    carried = ranges.select("crc", "n", after.alias("after")).mapInArrow(carry, "crc long, n long")
    return carried.agg(F.coalesce(F.expr("bit_xor(crc)"), F.lit(0)).cast("long").alias("crc"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("events"))


def witnessed(events: DataFrame, order: str = "arrival", parts: int | None = None) -> DataFrame:
    """One row, crc and events: the checksum of a tape."""
    return chained_crc(events.select(*dict.fromkeys([*WITNESS.names, order])), witness_bytes, WITNESS.itemsize, order, parts)


def witness(events: DataFrame, order: str = "arrival", parts: int | None = None) -> int:
    """witnessed() as a number."""
    return witnessed(events, order, parts).first()["crc"]
