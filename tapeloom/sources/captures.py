"""Captures of messages: read in ranges of whole records, written, and followed while they grow.

A capture's records can only be found from its start. One light pass a file, in bounded memory, notes a border every few megabytes
(file, offset, number of the first message); the table of borders is stored, and the ranges between them are read by as many tasks. As a stream, a
file is followed from the last whole record on; a torn tail waits until the rest of it is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tapeloom.shared import stored
from tapeloom.sources.files import ITCH_SIZES, _files, looks_like_text

EVERY = 8 << 20
BLOCK = 4 << 20
MOST_TASKS = 100_000
INDEX = "file string, begin long, end long, first long, used long"
ROWS = "file string, arrival long, payload binary"
MAGIC = (b"\xd4\xc3\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d")  # fixed values


class Lengths:
    """Big-endian lengths and messages; empty ones are passed over."""

    head, least = 0, 2

    def begin(self, head: bytes) -> None:
        """Looks at the file's first bytes."""

    def size(self, data: bytes, at: int) -> int:
        return 2 + (data[at] << 8 | data[at + 1])

    def messages(self, data: bytes, at: int, end: int) -> list[bytes]:
        return [data[at + 2 : end]] if end > at + 2 else []


class RawItch(Lengths):
    """Messages without lengths; the type letter gives the size."""

    least = 1

    def size(self, data, at):
        n = ITCH_SIZES.get(chr(data[at]))
        if n is None:
            raise ValueError(f"unknown message type {data[at]:#x}")
        return n

    def messages(self, data, at, end):
        return [data[at:end]]


class Cert(Lengths):
    """Eight bytes that are passed over, a big-endian length and a packet."""

    least = 10

    def size(self, data, at):
        return 10 + (data[at + 8] << 8 | data[at + 9])

    def messages(self, data, at, end):
        return [data[at + 10 : end]] if end > at + 10 else []


class Pcap(Lengths):
    """Packets of UDP over IPv4 over Ethernet: `skip` bytes of transport header, then lengths in `order` and messages."""

    head, least = 24, 16

    def __init__(self, skip: int = 40, order: str = "little"):
        self.skip, self.order, self.records = skip, order, "little"

    def begin(self, head):
        if looks_like_text(head):
            raise ValueError("text, not a capture")
        if head[:4] not in MAGIC:
            raise ValueError("not a capture file")
        self.records = "little" if head[:1] in (b"\xd4", b"\x4d") else "big"

    def size(self, data, at):
        return 16 + int.from_bytes(data[at + 8 : at + 12], self.records)

    def messages(self, data, at, end):
        at += 16
        if end - at < 34 or data[at + 12 : at + 14] != b"\x08\x00" or data[at + 23] != 17:
            return []
        pos, out = at + 14 + (data[at + 14] & 15) * 4 + 8 + self.skip, []
        while pos + 2 <= end:
            n = int.from_bytes(data[pos : pos + 2], self.order)
            pos += 2
            if pos + n > end:
                break
            if n:
                out.append(data[pos : pos + n])
            pos += n
        return out


def form_of(walk: str, skip: int = 40, order: str = "little") -> Lengths:
    forms = {"itch_lengths": Lengths, "itch_raw": RawItch, "cert": Cert, "pcap": lambda: Pcap(int(skip), order)}
    return forms[walk]()


def records(src, form: Lengths, begin: int, end: int | None = None) -> Iterator[tuple[int, int, list[bytes]]]:
    """(offset, offset after it, messages) of the whole records of an open file from a record's border on; a block is held at a time."""
    src.seek(0)
    form.begin(src.read(4096))
    at = max(begin, form.head)
    src.seek(at)
    data, i = b"", 0
    while end is None or at < end:
        n = form.size(data, i) if len(data) - i >= form.least else None
        if n is None or i + n > len(data):
            more = src.read(max(BLOCK, n or 0))
            if not more:
                return
            data, i = data[i:] + more, 0
            continue
        yield at, at + n, form.messages(data, i, i + n)
        at, i = at + n, i + n


def borders(src, form: Lengths, every: int, begin: int = 0, first: int = 1, used: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(begin, end, number of the first message, bytes of messages and lengths before it) of ranges of about `every` bytes."""
    start, lead, spent, at, n = max(begin, form.head), first, used, max(begin, form.head), first
    for _, after, messages in records(src, form, begin):
        n += len(messages)
        used += sum(map(len, messages)) + 2 * len(messages)
        at = after
        if at - start >= every:
            yield start, at, lead, spent
            start, lead, spent = at, n, used
    if at > start:
        yield start, at, lead, spent


def _system(path: str) -> pafs.FileSystem:
    return pafs.FileSystem.from_uri(path)[0] if "://" in path else pafs.LocalFileSystem()


def capture_index(spark: SparkSession, path: str, walk: str = "itch_lengths", every: int = EVERY, **options) -> DataFrame:
    """The borders of a capture's (or a folder's) files, stored; a file is a task."""
    form_of(walk, **options)
    files = _files(path)[1]  # names

    def look(batches):
        fs = _system(path)
        for b in batches:
            for f in b.column("file").to_pylist():
                with fs.open_input_file(f) as src:
                    rows = [(f, *r) for r in borders(src, form_of(walk, **options), every)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.string(), *[pa.int64()] * 4))], [c.split()[0] for c in INDEX.split(", ")])

    named = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), MOST_TASKS)), "file")
    return stored(named.mapInArrow(look, INDEX), "capture-index")


def read_capture(spark: SparkSession, path: str, walk: str = "itch_lengths", every: int = EVERY, max_events: int = 0, max_bytes: int = 0, index: DataFrame | None = None, **options) -> DataFrame:
    """(file, arrival, payload) of every message, arrival from 1 in a file. Options: skip and order (pcap).

    max_events and max_bytes (with two for each length) end each file early. `index` is an earlier capture_index of the same files.
    """
    index = capture_index(spark, path, walk, every, **options) if index is None else index
    if max_events:
        index = index.where(F.col("first") <= max_events)
    if max_bytes:
        index = index.where(F.col("used") <= max_bytes)
    tasks = max(1, min(index.count(), MOST_TASKS))

    def read(batches):
        fs = _system(path)
        for b in batches:
            for f, begin, end, n, used in zip(*(c.to_pylist() for c in b.columns)):
                out = []
                with fs.open_input_file(f) as src:
                    for _, _, messages in records(src, form_of(walk, **options), begin, end):
                        for m in messages:
                            used += len(m) + 2
                            if max_bytes and used > max_bytes or max_events and n > max_events:
                                break
                            out.append((f, n, m))
                            n += 1
                        if len(out) >= 10_000:
                            yield _rows(out)
                            out = []
                yield _rows(out)

    return index.select("file", "begin", "end", "first", "used").repartition(tasks, "file", "begin").mapInArrow(read, ROWS)


def _rows(out: list) -> pa.RecordBatch:
    cells = zip(*out) if out else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.int64(), pa.binary()))], ["file", "arrival", "payload"])


# -- writing ------------------------------------------------------------------------------------------------------
def packed(messages: list[bytes], walk: str, skip: int = 40, order: str = "little", a_packet: int = 16) -> bytes:
    """Records of messages, without the file's head."""
    if walk == "itch_raw":
        return b"".join(messages)
    if walk == "itch_lengths":
        return b"".join(len(m).to_bytes(2, "big") + m for m in messages)
    if walk == "cert":
        return b"".join(bytes(8) + len(m).to_bytes(2, "big") + m for m in messages)
    out = []
    for lo in range(0, len(messages), a_packet):
        body = bytes(skip) + b"".join(len(m).to_bytes(2, order) + m for m in messages[lo : lo + a_packet])
        frame = bytes(12) + b"\x08\x00" + b"\x45" + bytes(8) + b"\x11" + bytes(10) + bytes(8) + body
        out.append(bytes(8) + len(frame).to_bytes(4, "little") * 2 + frame)
    return b"".join(out)


HEADS = {"pcap": MAGIC[0] + bytes(20)}


def write_capture(messages: DataFrame, path: str, walk: str = "itch_lengths", parts: int = 8, **options) -> int:
    """Writes (arrival, payload) in order of arrival as a folder of `parts` files and returns the messages; null payloads are left out.

    Files are written under a name of the attempt and renamed, so a task that runs again leaves no half of a file.
    """
    from pyspark import TaskContext

    fs = _system(path)
    base = pafs.FileSystem.from_uri(path)[1] if "://" in path else path
    fs.create_dir(base, recursive=True)

    def write(batches):
        fs, context, n = _system(path), TaskContext.get(), 0
        held = f"{base}/.{context.partitionId()}.{context.taskAttemptId()}.tmp"
        with fs.open_output_stream(held) as out:
            out.write(HEADS.get(walk, b""))
            for b in batches:
                some = [m for m in b.column("payload").to_pylist() if m is not None]
                out.write(packed(some, walk, **options))
                n += len(some)
        fs.move(held, f"{base}/part-{context.partitionId():05d}.bin")
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    ordered = messages.select("arrival", "payload").repartitionByRange(parts, "arrival").sortWithinPartitions("arrival")
    return ordered.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


# -- following ----------------------------------------------------------------------------------------------------
class _Stretch(InputPartition):
    def __init__(self, file: str, begin: int, end: int, first: int):
        super().__init__((file, begin, end))
        self.file, self.begin, self.end, self.first = file, begin, end, first


class CaptureStream(DataSource):
    """format "tape_capture" for streams: options path (a folder), walk, every, skip and order.

    The offset says for every file how many bytes of whole records were read and how many messages they held.
    """

    @classmethod
    def name(cls) -> str:
        return "tape_capture"

    def schema(self) -> str:
        return ROWS

    def streamReader(self, schema):
        return CaptureFollower(dict(self.options))


class CaptureFollower(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.walk, self.every = options["path"], options.get("walk", "itch_lengths"), int(options.get("every", EVERY))
        self.options = {k: options[k] for k in ("skip", "order") if k in options}
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def _look(self, fs, file: str, begin: int, first: int):
        with fs.open_input_file(file) as src:
            return list(borders(src, form_of(self.walk, **self.options), self.every, begin, first))

    def latestOffset(self) -> dict:
        """Looks only at what came since it looked last."""
        fs, files = _files(self.path)
        for f in files:
            begin, first = self.known.get(f, (0, 1))
            if fs.get_file_info(f).size <= max(begin, form_of(self.walk).head):
                continue
            with fs.open_input_file(f) as src:
                for _, begin, messages in records(src, form_of(self.walk, **self.options), begin):
                    first += len(messages)
            self.known[f] = begin, first
        return {f: list(v) for f, v in sorted(self.known.items())}

    def partitions(self, start: dict, end: dict):
        fs, out = _system(self.path), []
        for f, (stop, last) in end.items():
            begin, first = start.get(f, (0, 1))
            if begin == stop:
                continue
            if stop - begin <= self.every:
                out.append(_Stretch(f, begin, stop, first))
            else:
                out += [_Stretch(f, a, min(b, stop), n) for a, b, n, _ in self._look(fs, f, begin, first) if a < stop]
        return out

    def read(self, part):
        n = part.first
        with _system(self.path).open_input_file(part.file) as src:
            for _, _, messages in records(src, form_of(self.walk, **self.options), part.begin, part.end):
                for m in messages:
                    yield part.file, n, m
                    n += 1

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def follow_capture(spark: SparkSession, path: str, walk: str = "itch_lengths", **options) -> DataFrame:
    """A stream of (file, arrival, payload) of the captures in a folder as they grow."""
    spark.dataSource.register(CaptureStream)
    return spark.readStream.format("tape_capture").options(path=path, walk=walk, **options).load()
