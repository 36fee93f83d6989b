"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

CACHE_WORDS = 200_000  # distinct words that a worker remembers before it starts anew


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not place:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tapeloom-")
        sc.setCheckpointDir(place)
        spark.conf.set("spark.checkpoint.dir", place)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(place)
    return place.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tapeloom/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut and the planner knows its size."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that is never a broadcast: what grows with the input may be small as stored and yet too large for the driver."""
    return df.hint("merge")


def text_bytes(name: str = "text"):
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def held_out(mod: int, rest: int):
    """True where crc32(doc_id as text) mod `mod` is `rest`; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == rest


class WordCache(dict):
    """Word -> value, computed once a word; forgets everything when it is full."""

    def __init__(self, make, most: int = CACHE_WORDS):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.make(word)
        return value

    def array(self, words: list, dtype) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype, len(words))


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def mix(*parts: np.ndarray) -> np.ndarray:
    """Combines 64-bit hashes, in order."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):  # scalars wrap as arrays do
        for p in parts:
            out = (out ^ p) * np.uint64(0xFF51AFD7ED558CCD)
            out = out ^ (out >> np.uint64(32))
    return out


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def platt(margin: np.ndarray, label: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of labels (0/1) on margins, with smoothed targets."""
    pos = float(label.sum())
    neg = len(label) - pos
    want = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (p - want) + 1e-6 * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, train, most: int) -> DataFrame:
    """(doc_id, y, body) of at most `most` labelled training rows, those whose ids hash lowest.

    A doc_id labelled more than once takes its largest label; null ids and labels take no part. A doc_id that stands more than
    once in docs gives one row, the text whose hash is least, so `most` bounds the rows however often an id is repeated.
    The sample's ids are bounded by `most`, so they are broadcast to the scan of the texts.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .where(train)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    found = texts.join(F.broadcast(ids), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("body").alias("h"), "y", "body")).alias("row"))
    return one.select("doc_id", "row.y", "row.body")


#: SQL that DuckDB can run: a CTE with the table of CRC-32, and the CRC-32 of a text's UTF-8 bytes by it.
CRC32_TABLE_SQL = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) crc_t)"""


def crc32_sql(text: str, table: str = "crc_t") -> str:
    """The unsigned CRC-32 of a text; null of null."""
    nibble = lambda at: f"(instr('0123456789ABCDEF', substr(hex(encode({text})), {at}, 1)) - 1)"
    size = f"CAST(octet_length(encode({text})) AS BIGINT)"
    octets = f"list_transform(range({size}), lambda i: CAST(16 * {nibble('2 * i + 1')} + {nibble('2 * i + 2')} AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"
