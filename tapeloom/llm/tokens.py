"""Operator 5: token ids of every document in wavelet-matrix shard files.

Documents are range-partitioned and sorted by doc_id, so the shards in order hold all ids in ascending doc_id order.
A task encodes its texts and writes shard files to the shared folder as soon as SHARD_TOKENS ids are there (a document never
spans two files), each under a name of its own attempt; the rows it returns name the files. A task that runs
again writes other files and only the rows of the run that counts are kept, so lost executors leave no mixed shards.
Readers take documents' ids and offsets from the shard files, decode them one by one, and ask their planes by access and rank.

A text is cut at white space and each distinct piece is encoded once a worker by the tokenizers library. The vocabulary's
normaliser works on characters and its pattern never spans white space, so the pieces' ids in turn are the text's;
texts with a special token's string or one of the four separators that only Python splits at are encoded whole. This holds for vocabularies of byte-level BPE in lower case that drop
white space, such as the default; others are refused.

Defined results: a null or empty text has the end id alone; repeated rows and ids are kept, in order of doc_id, then text;
null doc_ids come first; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import string
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tapeloom.llm.common import fresh_path, stored
from tapeloom.llm.wavelet import WaveletMatrix

END_ID = 2
SHARD_TOKENS = 1 << 22
PIECES = 200_000
#: ASCII punctuation that the pre-tokenizer keeps together behind a word; an apostrophe may begin a contraction.
TAIL = string.punctuation.replace("'", "")
PROBE = ("Some", "wörds,", "12", "it's", "|", "end.")


def _byte_level() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary: visible ones stay, the rest follow 255 in turn."""
    seen = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    rest = (b for b in range(256) if b not in set(seen))
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_LEVEL = _byte_level()
#: Lower-case letters of Latin-1 in byte-level form.
FORMS = {c: "".join(BYTE_LEVEL[b] for b in c.encode()) for c in map(chr, range(256)) if c.isalpha() and c == c.lower()}
_loaded: dict[str, "Encoder"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes whole texts through a bounded memory of white-space pieces."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self._check(vocabulary)
        # Python splits at these separators, the vocabulary's pattern does not.
        self.special = ["\x1c", "\x1d", "\x1e", "\x1f"] + [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = max(1, (max(self.tokenizer.get_vocab_size(True) - 1, END_ID)).bit_length())
        self.model, self.tails, self.pieces = self.tokenizer.model, {}, Pieces(self.piece)

    def _check(self, vocabulary: str) -> None:
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        if ids(" ".join(PROBE)) != [i for p in PROBE for i in ids(p)] or ids("AbÉ") != ids("abé"):
            raise ValueError(f"{vocabulary}: pieces between white space are not encoded on their own")

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def forget(self) -> None:
        """Gives the pieces' memory back: Spark keeps a task's worker for later stages, and idle ones would hold them."""
        self.pieces, self.tails = Pieces(self.piece), {}

    def piece(self, piece: str) -> bytes:
        """Words of Latin letters, with punctuation behind them or not, go to the library's model right away, in the form that its
        normaliser and pre-tokenizer would give them; other pieces go through the whole tokenizer."""
        core = piece.rstrip(TAIL)
        low = core.lower()
        if low.isascii():
            if not core.isalpha():
                return self.whole(piece)
            form = low
        else:
            try:
                form = "".join(map(FORMS.__getitem__, low))
            except KeyError:
                return self.whole(piece)
        ids = self.pieces.known(low) if low != piece else None
        if ids is None:
            ids = array("I", [t.id for t in self.model.tokenize(form)]).tobytes()
            if low != piece:
                self.pieces[low] = ids
        if len(core) < len(piece):
            tail = piece[len(core) :]
            if tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails.clear()
                self.tails[tail] = self.whole(tail)
            ids += self.tails[tail]
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian u32."""
        if any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.pieces.__getitem__, text.split()))


class Pieces(dict):
    """Ids by piece. When it is full it becomes the older half, from which what is still used comes back."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def known(self, piece: str) -> bytes | None:
        ids = self.get(piece)
        return self.older.get(piece) if ids is None else ids

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(self) >= PIECES:
            self.older = self.copy()
            self.clear()
        self[piece] = ids
        return ids


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _loaded:
        _loaded.clear()
        _loaded[vocabulary] = Encoder(vocabulary)
    return _loaded[vocabulary]


def write_shards(docs: DataFrame, folder: str, vocabulary: str, shards: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the files; (part, nth, file, n_docs, n_tokens) a file."""
    end = np.array([END_ID], "<u4").tobytes()

    def write(batches):
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(vocabulary)
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        buffer, lengths, ids, nth = [], [], [], 0

        def flush():
            nonlocal buffer, lengths, ids, nth
            name = f"shard-{part:06d}-{nth:05d}-{uuid.uuid4().hex}.tlwm"
            tokens = np.frombuffer(b"".join(buffer), "<u4")
            ends = np.cumsum(lengths)
            data = WaveletMatrix.build(tokens, ends, enc.width, ids).to_bytes()
            with fs.open_output_stream(f"{base}/{name}.tmp") as out:
                out.write(data)
            fs.move(f"{base}/{name}.tmp", f"{base}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((part, pa.int32()), (nth, pa.int32()), (name, pa.string()), (len(ids), pa.int64()), (len(tokens), pa.int64()))], ["part", "nth", "file", "n_docs", "n_tokens"])
            buffer, lengths, ids, nth = [], [], [], nth + 1
            return row

        size = 0
        try:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    piece = b.slice(at, 256)
                    texts = piece.column("text").to_pylist()
                    for doc_id, text in zip(piece.column("doc_id").to_pylist(), texts):
                        coded = enc.encode(text) + end
                        buffer.append(coded)
                        lengths.append(len(coded) // 4)
                        ids.append(doc_id)
                        size += lengths[-1]
                        if size >= shard_tokens:
                            yield flush()
                            size = 0
            if ids:
                yield flush()
        finally:
            enc.forget()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, "part int, nth int, file string, n_docs long, n_tokens long")


def read_shards(files: DataFrame, folder: str) -> DataFrame:
    """A row for each document from the files: doc_id, start, n_tokens, the crc32 of its ids, its first id and how many end ids it has.

    Ids and offsets of documents lie in the files; what all files before hold is added from the table of files. The last two columns come
    from access and rank on the planes, not from the decoded ids.
    """
    # Offsets of shards: a row a file of millions of ids, summed over all files before.
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("part", "nth", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"))
    placed = files.join(offsets, ["part", "nth"]).select("file", "offset").repartition(max(1, files.rdd.getNumPartitions(), int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file")

    def read(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for row in b.to_pylist():
                with fs.open_input_stream(f"{base}/{row['file']}") as f:
                    matrix = WaveletMatrix.from_bytes(f.read())
                tokens = matrix.decode().astype("<u4", copy=False)
                ends = matrix.ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                raw = memoryview(tokens).cast("B")
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(matrix.doc_ids, pa.int64()), pa.array(row["offset"] + starts), pa.array(ends - starts), pa.array(crc, pa.int64()), pa.array(matrix.access_at(starts)), pa.array(matrix.count_in(END_ID, starts, ends))],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "first_id", "n_end_ids"],
                )

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, first_id long, n_end_ids long")


def token_files(docs: DataFrame, vocabulary: str | None = None, shards: int | None = None, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, str]:
    """Writes all shard files; the table of files and their folder."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "token-files")
    shards = shards or max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return stored(write_shards(docs, folder, vocabulary or default_vocabulary(), shards, shard_tokens), "token-index"), folder


def round_trip(docs: DataFrame, **options) -> DataFrame:
    return read_shards(*token_files(docs, **options))


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
