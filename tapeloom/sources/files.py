"""Binary files as Spark data sources: journals of fixed-size records and captures of messages, read by byte ranges.

Journals are split at record borders, so a large file is many tasks, and are followed while they grow. Captures are in sources.captures. Paths may be any that pyarrow's file systems know; a folder is all its files in order of name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tapeloom.schema import BOOK_EVENTS
from tapeloom.shared import stored

# File formats. A record is a 24-byte envelope and a payload of C structs with their padding, little-endian.
VERSION = 1
ENVELOPE = [("monotonic_seq", "<u8"), ("ingest_ts_ns", "<u8"), ("payload_len", "<u4"), ("crc", "<u4")]
FORMATS = {
    "book": (b"MFJN", 88, {"venue": (0, "u1"), "event_type": (1, "u1"), "sequence": (8, "<u8"), "exchange_ts_ns": (16, "<u8"), "symbol": (32, "S8"), "order_id": (40, "<u8"), "match_id": (48, "<u8"), "reference_order_id": (56, "<u8"), "qty": (64, "<u4"), "price": (68, "<u4"), "prev_qty": (72, "<u4"), "prev_price": (76, "<u4"), "side": (80, "u1"), "mpid": (81, "S4"), "has_mpid": (85, "u1"), "raw_type": (86, "u1")}),
    "nbbo": (b"MFNB", 64, {"symbol": (0, "<u8"), "exchange_ts_ns": (8, "<u8"), "has_bid": (24, "u1"), "has_ask": (25, "u1"), "bid_price": (28, "<u4"), "bid_qty": (32, "<u4"), "ask_price": (36, "<u4"), "ask_qty": (40, "<u4"), "bid_venue": (44, "u1"), "ask_venue": (45, "u1"), "bid_venue_sequence": (48, "<u8"), "ask_venue_sequence": (56, "<u8")}),
}
HEADER = 8
BLOCK = 16_384  # records that a reader holds at a time
MOST_PARTS = 256  # partitions of a scan; where `records` would give more, each takes more records
BOOK_SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BOOK_EVENTS) + ", status string"
NBBO_SCHEMA = "arrival long, symbol string, exchange_ts_ns long, ingest_ts_ns long, bid_price long, bid_qty long, ask_price long, ask_qty long, bid_venue short, ask_venue short, bid_venue_sequence long, ask_venue_sequence long, status string"


def record_dtype(kind: str) -> np.dtype:
    _, size, fields = FORMATS[kind]
    names, formats, offsets = [], [], []
    for at, (name, form) in enumerate(ENVELOPE):
        names.append(f"env_{name}")
        formats.append(form)
        offsets.append((0, 8, 16, 20)[at])
    for name, (at, form) in fields.items():
        names.append(name)
        formats.append(form)
        offsets.append(24 + at)
    return np.dtype({"names": names, "formats": formats, "offsets": offsets, "itemsize": 24 + size})


def _files(path: str) -> tuple[pafs.FileSystem, list[str]]:
    fs, base = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(base)
    if info.type == pafs.FileType.Directory:
        return fs, sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return fs, [base]


def blocks(src, start: int, end: int, width: int):
    """The records from byte `start` to `end`, BLOCK at a time, each with how many records came before it: a reader holds a block, whatever the range."""
    src.seek(start)
    for at in range(start, end, BLOCK * width):
        yield src.read(min(BLOCK * width, end - at)), (at - start) // width


def _sums(raw: bytes, width: int, n: int) -> np.ndarray:
    """Checksums of the first n records' payloads."""
    view = memoryview(raw)
    return np.fromiter((zlib.crc32(view[k * width + 24 : (k + 1) * width]) for k in range(n)), np.uint32, n)


class _Range(InputPartition):
    def __init__(self, file: str, start: int, end: int, first: int, error: str = ""):
        super().__init__((file, start, end))
        self.file, self.start, self.end, self.first, self.error = file, start, end, first, error


class JournalSource(DataSource):
    """format "tape_journal": options path, kind (book or nbbo), records (a partition, or as many more as leave about MOST_PARTS), mode (permissive keeps bad rows with their status).

    A record whose checksum fails is left out; a wrong length or a torn tail ends the file. In permissive mode a row says so.
    """

    @classmethod
    def name(cls) -> str:
        return "tape_journal"

    def schema(self) -> str:
        return BOOK_SCHEMA if self.options.get("kind", "book") == "book" else NBBO_SCHEMA

    def reader(self, schema):
        return JournalReader(dict(self.options))

    def streamReader(self, schema):
        return JournalFollower(dict(self.options))


class JournalReader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind, self.path = options.get("kind", "book"), options["path"]
        self.step = int(options.get("records", 1_000_000))
        self.permissive = options.get("mode", "failsafe") == "permissive"

    def partitions(self):
        magic, size, _ = FORMATS[self.kind]
        fs, files = _files(self.path)
        out, first = [], 0
        step = max(self.step, -(-sum(fs.get_file_info(f).size for f in files) // ((24 + size) * MOST_PARTS)))
        for f in files:
            with fs.open_input_file(f) as src:
                head, length = src.read(HEADER), src.size()
            if len(head) < HEADER or head[:4] != magic or int.from_bytes(head[4:], "little") != VERSION:
                raise ValueError(f"{f}: not a version {VERSION} {self.kind} journal")
            width = 24 + size
            n, torn = divmod(length - HEADER, width)
            for at in range(0, n, step):
                out.append(_Range(f, HEADER + at * width, HEADER + min(n, at + step) * width, first + at))
            if torn and self.permissive:
                out.append(_Range(f, 0, 0, first + n, "unexpected_eof"))
            first += n
        return out

    def read(self, part):
        if part is None:  # there are no ranges
            return
        if part.error:
            yield _journal_batch(self.kind, np.zeros(1, record_dtype(self.kind)), np.array([part.first]), [part.error])
            return
        fs, _ = _files(self.path)
        size = FORMATS[self.kind][1]
        with fs.open_input_file(part.file) as src:
            for raw, past in blocks(src, part.start, part.end, 24 + size):
                rows = np.frombuffer(raw, record_dtype(self.kind))
                at = part.first + past + np.arange(len(rows))
                long = np.flatnonzero(rows["env_payload_len"] != size)
                stop = int(long[0]) if len(long) else len(rows)
                bad = _sums(raw, 24 + size, stop) != rows["env_crc"][:stop]
                status = np.where(bad, "record_crc", "ok").astype(object)
                keep = np.arange(stop) if self.permissive else np.flatnonzero(~bad)
                if len(keep):
                    yield _journal_batch(self.kind, rows[keep], at[keep], status[keep].tolist())
                if stop < len(rows):
                    if self.permissive:
                        yield _journal_batch(self.kind, np.zeros(1, rows.dtype), at[stop : stop + 1], ["record_size"])
                    return


class JournalFollower(DataSourceStreamReader):
    """Journals of a folder while they grow. The offset says for every file how many bytes of whole records were read.

    A file shorter than its header and a torn record wait until the rest is there. arrival is the record number that is written in
    the record, which goes on over files. A record whose checksum or length is wrong is left out (in permissive mode a row says so);
    records have one size, so those after it are read.
    """

    def __init__(self, options: dict):
        self.batch = JournalReader(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        magic, size, _ = FORMATS[self.batch.kind]
        fs, files = _files(self.batch.path)
        out = {}
        for f in files:
            with fs.open_input_file(f) as src:
                head, length = src.read(HEADER), src.size()
            if len(head) < HEADER:
                continue
            if head[:4] != magic or int.from_bytes(head[4:], "little") != VERSION:
                raise ValueError(f"{f}: not a version {VERSION} {self.batch.kind} journal")
            width = 24 + size
            out[f] = HEADER + (length - HEADER) // width * width
        return out

    def partitions(self, start: dict, end: dict):
        step = self.batch.step * (24 + FORMATS[self.batch.kind][1])
        return [_Range(f, at, min(stop, at + step), 0) for f, stop in end.items() for at in range(start.get(f, HEADER), stop, step)]

    def read(self, part):
        size = FORMATS[self.batch.kind][1]
        fs, _ = _files(self.batch.path)
        with fs.open_input_file(part.file) as src:
            for raw, _past in blocks(src, part.start, part.end, 24 + size):
                rows = np.frombuffer(raw, record_dtype(self.batch.kind))
                sums = _sums(raw, 24 + size, len(rows))
                status = np.where(rows["env_payload_len"] != size, "record_size", np.where(sums != rows["env_crc"], "record_crc", "ok")).astype(object)
                keep = np.arange(len(rows)) if self.batch.permissive else np.flatnonzero(status == "ok")
                if len(keep):
                    yield _journal_batch(self.batch.kind, rows[keep], rows["env_monotonic_seq"][keep], status[keep].tolist())

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def _names(raw: np.ndarray) -> pa.Array:
    return pa.array([b.decode("latin-1").rstrip(" \x00") for b in raw.tolist()], pa.string())


def _journal_batch(kind: str, rows: np.ndarray, arrival: np.ndarray, status: list) -> pa.RecordBatch:

    names = [c.split()[0] for c in (BOOK_SCHEMA if kind == "book" else NBBO_SCHEMA).split(", ")]
    types = [c.split()[1] for c in (BOOK_SCHEMA if kind == "book" else NBBO_SCHEMA).split(", ")]
    arrow = {"bigint": pa.int64(), "long": pa.int64(), "smallint": pa.int16(), "short": pa.int16(), "string": pa.string()}
    out = []
    for n, t in zip(names, types):
        if n == "arrival":
            out.append(pa.array(arrival.astype(np.int64)))
        elif n == "ingest_ts_ns":
            out.append(pa.array(rows["env_ingest_ts_ns"].view(np.int64) if rows["env_ingest_ts_ns"].flags.c_contiguous else rows["env_ingest_ts_ns"].astype(np.int64)))
        elif n == "status":
            out.append(pa.array(status, pa.string()))
        elif n == "mpid":
            out.append(pa.array([m.decode("latin-1").rstrip(" \x00") if h else None for m, h in zip(rows["mpid"].tolist(), rows["has_mpid"].tolist())], pa.string()))
        elif n == "symbol" and kind == "nbbo":
            out.append(_names(np.frombuffer(rows["symbol"].astype(">u8").tobytes(), "S8")))
        elif n == "symbol":
            out.append(_names(rows["symbol"]))
        elif kind == "nbbo" and n.split("_")[0] in ("bid", "ask"):
            there = rows[f"has_{n.split('_')[0]}"].astype(bool)
            out.append(pa.array(rows[n].astype(np.int64), mask=~there).cast(arrow[t]))
        else:
            out.append(pa.array(rows[n].astype(np.int64)).cast(arrow[t]))
    return pa.RecordBatch.from_arrays(out, names)


def _fixed_text(column: pa.Array, width: int, pad: bytes) -> np.ndarray:
    """Texts cut and filled up to `width` bytes; the distinct ones are encoded once."""
    coded = column.fill_null("").dictionary_encode()
    known = np.array([v.encode("latin-1")[:width].ljust(width, pad) for v in coded.dictionary.to_pylist()] or [b""], f"S{width}")
    return known[coded.indices.to_numpy(zero_copy_only=False)]


def quote_payloads(batch: pa.RecordBatch) -> bytes:
    """The payloads of a batch of quotes (with their venues' message numbers), as the quote journal has them."""
    _, size, fields = FORMATS["nbbo"]
    names = [*fields, "ingest_ts_ns"]
    dtype = np.dtype({"names": names, "formats": [*(form for _, form in fields.values()), "<u8"], "offsets": [*(at for at, _ in fields.values()), 16], "itemsize": size})
    rows = np.zeros(batch.num_rows, dtype)
    for f in names:
        if f == "symbol":
            raw = np.char.ljust(np.array([v or "" for v in batch.column("symbol").to_pylist()], "S8"), 8, b" ")
            rows[f] = np.frombuffer(raw.astype("S8").tobytes(), ">u8")
        elif f in ("has_bid", "has_ask"):
            rows[f] = batch.column(f[4:] + "_price").is_valid().to_numpy(zero_copy_only=False)
        else:
            rows[f] = batch.column(f).fill_null(0).to_numpy(zero_copy_only=False)
    return rows.tobytes()


def write_journal(events: DataFrame, path: str, kind: str = "book", order: str = "arrival", parts: int = 8, append: bool = False) -> int:
    """Writes a folder of journal files in `order` and returns the records. Appending goes on with the record numbers after those there.

    The rows are put in order once and stored; record numbers come from what is stored, so a plan that gives other ranges when it is run
    again changes nothing. Files are written under a name of the attempt and renamed, so a task that runs again leaves no half of a file.
    """
    fs, base = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    there = 0
    if append and fs.get_file_info(base).type == pafs.FileType.Directory:
        there = count_records(path, kind)
    elif fs.get_file_info(base).type == pafs.FileType.Directory:
        fs.delete_dir_contents(base)
    fs.create_dir(base, recursive=True)
    run = f"{there:020d}"
    magic, size, fields = FORMATS[kind]
    nbbo = kind == "nbbo"
    ordered = events.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("__row", F.monotonically_increasing_id())
    ordered = stored(ordered, "journal-rows")
    sizes = ordered.groupBy(F.shiftright("__row", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # a row a file
    ranges = np.array([r["p"] for r in sizes], np.int64)
    before = np.cumsum([0, *(r["n"] for r in sizes)])

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        width = 24 + size
        held, first, n = f"{base}/.{part}.{TaskContext.get().taskAttemptId()}.tmp", None, 0
        with fs.open_output_stream(held) as out:
            out.write(magic + VERSION.to_bytes(4, "little"))
            for b in batches:
                number = b.column("__row").to_numpy()
                number = there + before[np.searchsorted(ranges, number >> 33)] + (number & ((1 << 33) - 1))
                if first is None and b.num_rows:
                    first = int(number[0])
                raw = bytearray(b.num_rows * width)
                rows = np.frombuffer(raw, record_dtype(kind))
                for f in fields:
                    if f == "symbol":
                        sym = _fixed_text(b.column(f), 8, b" ")
                        rows[f] = np.frombuffer(sym.tobytes(), ">u8") if nbbo else sym
                    elif f == "mpid":
                        rows[f] = _fixed_text(b.column(f), 4, b"\0")
                    elif f == "has_mpid":
                        rows[f] = b.column("mpid").is_valid().to_numpy(zero_copy_only=False)
                    elif f in ("has_bid", "has_ask"):
                        rows[f] = b.column(f[4:] + "_price").is_valid().to_numpy(zero_copy_only=False)
                    elif f in b.schema.names:
                        rows[f] = b.column(f).fill_null(0).to_numpy(zero_copy_only=False)
                ingest = b.column("ingest_ts_ns").fill_null(0).to_numpy(zero_copy_only=False)
                whole = np.frombuffer(raw, np.uint8).reshape(-1, width)
                whole[:, 24 + 16 : 24 + 24].view("<u8")[:, 0] = ingest  # the payload has it too
                rows["env_monotonic_seq"] = number
                rows["env_ingest_ts_ns"], rows["env_payload_len"] = ingest, size
                view = memoryview(raw)
                rows["env_crc"] = [zlib.crc32(view[at + 24 : at + width]) for at in range(0, len(raw), width)]
                out.write(view)
                n += len(rows)
        if first is None:
            fs.delete_file(held)
        else:
            fs.move(held, f"{base}/{run}-{first:020d}.journal")
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    if not sizes:
        with fs.open_output_stream(f"{base}/{run}-{there:020d}.journal") as out:
            out.write(magic + VERSION.to_bytes(4, "little"))
        return 0
    dealt = ordered.repartitionById(parts, F.shiftright("__row", 33).cast("int")).sortWithinPartitions("__row")  # as they were put in order
    return dealt.mapInArrow(write, "n long").agg(F.sum("n")).first()[0]


def count_records(path: str, kind: str = "book") -> int:
    """From file sizes alone; a torn tail is an error."""
    fs, files = _files(path)
    width, total = 24 + FORMATS[kind][1], 0
    for f in files:
        n, torn = divmod(fs.get_file_info(f).size - HEADER, width)
        if torn:
            raise ValueError(f"{f}: size is not a whole number of records")
        total += n
    return total


def read_journal(spark: SparkSession, path: str, kind: str = "book", permissive: bool = False, **options) -> DataFrame:
    spark.dataSource.register(JournalSource)
    df = spark.read.format("tape_journal").options(path=path, kind=kind, mode="permissive" if permissive else "failsafe", **options).load()
    return df if permissive else df.drop("status")


def follow_journal(spark: SparkSession, path: str, kind: str = "book", permissive: bool = False, **options) -> DataFrame:
    """A stream of the records of the journals in a folder as they grow."""
    spark.dataSource.register(JournalSource)
    df = spark.readStream.format("tape_journal").options(path=path, kind=kind, mode="permissive" if permissive else "failsafe", **options).load()
    return df if permissive else df.drop("status")


# -- captures -----------------------------------------------------------------------------------------------------
def looks_like_text(head: bytes) -> bool:
    """Of the first 4 KB over 95 % printable, more than ten commas and five lines: a table, not a capture."""
    head = head[:4096]
    printable = sum(32 <= c < 127 or c in (9, 10, 13) for c in head)
    return bool(head) and printable > 0.95 * len(head) and head.count(b",") > 10 and head.count(b"\n") > 5


#: Sizes of ITCH messages by type letter, for files without lengths.
ITCH_SIZES = {"S": 12, "R": 39, "A": 36, "F": 40, "E": 31, "C": 36, "X": 23, "D": 19, "U": 35, "P": 44, "Q": 40, "I": 50}


def walk_length_prefixed(data: bytes, start: int = 0):
    """Big-endian lengths and messages; empty ones are skipped, a torn one ends the walk."""
    at = start
    while at + 2 <= len(data):
        n = int.from_bytes(data[at : at + 2], "big")
        at += 2
        if at + n > len(data):
            return
        if n:
            yield data[at : at + n]
        at += n


def walk_raw_itch(data: bytes):
    at = 0
    while at < len(data):
        n = ITCH_SIZES.get(chr(data[at]))
        if n is None:
            raise ValueError(f"unknown message type {data[at]:#x} at {at}")
        if at + n > len(data):
            return
        yield data[at : at + n]
        at += n


def walk_cert(data: bytes):
    """Eight bytes that are passed over, a big-endian length and a packet."""
    at = 0
    while at + 10 <= len(data):
        n = int.from_bytes(data[at + 8 : at + 10], "big")
        at += 10
        if n == 0:
            continue
        if at + n > len(data):
            return
        yield data[at : at + n]
        at += n


def walk_pcap(data: bytes, skip: int = 40, order: str = "little"):
    """Messages of UDP over IPv4 over Ethernet: `skip` bytes of transport header, then lengths in `order` and messages."""
    if looks_like_text(data):
        raise ValueError("text, not a capture")
    if data[:4] not in (b"\xd4\xc3\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d"):
        raise ValueError("not a capture file")
    records = "little" if data[:1] in (b"\xd4", b"\x4d") else "big"
    at = 24
    while at + 16 <= len(data):
        n = int.from_bytes(data[at + 8 : at + 12], records)
        frame = data[at + 16 : at + 16 + n]
        at += 16 + n
        if len(frame) < 34 or frame[12:14] != b"\x08\x00" or frame[23] != 17:
            continue
        ip = (frame[14] & 15) * 4
        body = frame[14 + ip + 8 :]
        pos = skip
        while pos + 2 <= len(body):
            m = int.from_bytes(body[pos : pos + 2], order)
            pos += 2
            if pos + m > len(body):
                break
            if m:
                yield body[pos : pos + m]
            pos += m


WALKERS = {"itch_lengths": walk_length_prefixed, "itch_raw": walk_raw_itch, "cert": walk_cert, "pcap": walk_pcap}


def read_capture(spark: SparkSession, path: str, walk: str = "itch_lengths", **options) -> DataFrame:
    """(file, arrival, payload), arrival from 1 in a file; see captures.read_capture."""
    from tapeloom.sources import captures

    return captures.read_capture(spark, path, walk, **options)


# -- datagrams ----------------------------------------------------------------------------------------------------
def frame(datagram: bytes, protocol: str) -> list[tuple[int, bytes]]:
    """(sequence, message) of one datagram; what does not fit its length ends it."""
    if protocol == "itch":  # session 10, sequence 8, count 2
        if len(datagram) < 20:
            return []
        first, count, end, at = int.from_bytes(datagram[10:18], "big"), int.from_bytes(datagram[18:20], "big"), len(datagram), 20
    elif protocol == "deep":  # 36 bytes, of which length at 8, count at 10, first sequence at 20
        if len(datagram) < 36:
            return []
        first, count, at = int.from_bytes(datagram[20:28], "big"), int.from_bytes(datagram[10:12], "big"), 36
        end = 36 + int.from_bytes(datagram[8:10], "big")
        if end > len(datagram):
            return []
    elif protocol == "pitch":
        lines = [x for x in datagram.split(b"\n") if x]
        return [(int(x[:8]) if x[:8].isdigit() and len(x) >= 8 else 0, x) for x in lines]
    else:
        raise ValueError(protocol)
    out = []
    for k in range(count):
        if at + 2 > end:
            break
        n = int.from_bytes(datagram[at : at + 2], "big")
        at += 2
        if at + n > end:
            break
        out.append((first + k, datagram[at : at + n]))
        at += n
    return out


def framed(datagrams: DataFrame, protocol: str) -> DataFrame:
    """(arrival, ingest_ts_ns, payload) datagrams as decoder input; works on batch and streaming frames alike."""

    def split(batches):
        for b in batches:
            rows = [(a * 65536 + k, t, s, m) for a, t, d in zip(*(b.column(c).to_pylist() for c in ("arrival", "ingest_ts_ns", "payload"))) for k, (s, m) in enumerate(frame(d or b"", protocol))]
            cells = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["arrival", "ingest_ts_ns", "sequence", "payload"])

    return datagrams.select("arrival", "ingest_ts_ns", "payload").mapInArrow(split, "arrival long, ingest_ts_ns long, sequence long, payload binary")


def pack_mold(messages: list[bytes], first: int = 1, session: bytes = b"TEST      ", most: int = 16, most_bytes: int = 1400) -> list[bytes]:
    """Datagrams of at most `most` messages and `most_bytes` bytes."""
    out, held, size = [], [], 20
    for m in [*messages, None]:
        if held and (m is None or len(held) == most or size + 2 + len(m) > most_bytes):
            out.append(session[:10].ljust(10) + first.to_bytes(8, "big") + len(held).to_bytes(2, "big") + b"".join(len(x).to_bytes(2, "big") + x for x in held))
            first, held, size = first + len(held), [], 20
        if m is not None:
            held.append(m)
            size += 2 + len(m)
    return out
