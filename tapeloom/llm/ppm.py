"""Operator 6: language-model scores by prediction by partial matching over bytes, beside a word unigram base.

A context trie of ORDER bytes is pretrained on all training documents. A byte is coded in the longest context known; a byte not seen
there escapes (method C: a context seen n times with u different bytes escapes with u / (n + u)) to the context one byte
shorter, from which the bytes seen in the longer one are excluded, and in the end to equal shares of the bytes never
seen. A document is its bytes and an end mark, 0xFF, which no UTF-8 text holds; it starts in a context of end marks.

Training counts runs of ORDER + 1 bytes and hashes of words; they are summed in tasks first, then by key. The sums go to tables in the
shared folder, split into parts of PART_ROWS rows at most on average: byte runs by the two bytes before the last, so that a part
has all that its contexts need but for orders 0 and 1 (at most 65 792 numbers, in every part), words by hash. A
worker holds one part at a time and sums what the positions of a chunk cost in each, by document and block by block, so memory does not
grow with the model, nothing is broadcast and nothing but the totals reaches the driver.

Defined results: null and empty texts consist of the end mark; rows with a null doc_id are treated as the empty id's; repeated rows
are scored alike, and count in training as often as they stand; without training documents bytes cost 1/256 each; an empty
table gives an empty result; columns other than doc_id and text play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from tapeloom.llm.common import WordCache, fresh_path, held_out, stored, text_bytes, word_hash

ORDER = 5
END = 0xFF
PART_ROWS = 1_500_000
CHUNK_BYTES, FLUSH_ROWS = 1 << 20, 2_000_000
MOST_CHUNK = 32 << 20  # a chunk takes about five bytes a byte
BLOCK = 1 << 20  # positions that are priced at once
END_WORD = word_hash(b"\xff")  # no word of a UTF-8 text
GRAMS, WORDS = 0, 1


# -- arrays ---------------------------------------------------------------------------------------------------
def byte_runs(bodies: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Every byte with the `order` bytes before it, as a number, and where each document's runs start."""
    pad, end = bytes([END]) * order, bytes([END])
    raw = np.frombuffer(b"".join([x for b in bodies for x in (pad, b, end)]), np.uint8)
    size = np.array([len(b) + 1 for b in bodies], np.int64)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    runs = np.zeros(max(0, len(raw) - order), np.uint64)
    for k in range(order + 1):
        runs = runs << np.uint64(8) | raw[k : len(raw) - order + k]
    keep = np.ones(len(runs), bool)  # runs that span two documents predict padding
    for s in (starts + np.arange(len(size)) * order)[1:]:
        keep[s - order : s] = False
    return runs[keep], starts


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if len(keys) and not (keys[1:] >= keys[:-1]).all():
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        del order
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key among sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Level:
    """Contexts of one length and the bytes seen in them; `rest` and `fresh` are what the next shorter context has besides."""

    grams: np.ndarray
    count: np.ndarray
    contexts: np.ndarray
    seen: np.ndarray
    kinds: np.ndarray
    rest: np.ndarray
    fresh: np.ndarray


def _levels(tables: list[tuple[np.ndarray, np.ndarray]]) -> list[Level]:
    levels: list[Level] = []
    for i, (grams, count) in enumerate(tables):
        context = grams >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(grams) else np.zeros(0, int)
        contexts = context[first]
        seen = np.add.reduceat(count, first) if len(first) else count
        kinds = np.diff(np.append(first, len(grams)))
        rest, fresh = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        if i and len(first):
            below = levels[-1]
            at, _ = find(below.grams, grams & np.uint64((1 << 8 * i) - 1))
            shared = np.add.reduceat(below.count[at], first, dtype=np.int64)
            del at
            up, _ = find(below.contexts, contexts & np.uint64((1 << 8 * (i - 1)) - 1))
            rest = below.seen[up] - shared
            fresh = below.kinds[up] - kinds
        levels.append(Level(grams, _small(count), contexts, _small(seen), kinds.astype(np.int16), _small(rest), fresh.astype(np.int16)))  # a context has 256 bytes at most
        tables[i] = None
    return levels


def _small(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where they fit."""
    return counts.astype(np.int32) if len(counts) and 0 <= counts.min() and counts.max() < 1 << 31 else counts


class Model:
    """The trie of one part: levels 0 to order, and a table that answers for the longest runs at once."""

    def __init__(self, order: int, runs: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray):
        self.order = order
        # Each length is summed from the next longer one, so only the longest is sorted in full.
        tables = [(runs, counts) if len(runs) < 2 or (runs[1:] > runs[:-1]).all() else summed(runs, counts)]
        for i in range(order - 1, 1, -1):
            tables.append(summed(tables[-1][0] & np.uint64((1 << 8 * (i + 1)) - 1), tables[-1][1]))
        del runs, counts
        tables = [summed(pairs & np.uint64(0xFF), pair_counts), summed(pairs, pair_counts), *reversed(tables)] if order > 1 else [summed(pairs & np.uint64(0xFF), pair_counts), summed(pairs, pair_counts)]
        self.levels = _levels(tables)
        del tables
        top = self.levels[order]
        self.cost = np.log10(top.count / np.repeat(top.seen.astype(np.int64) + top.kinds, top.kinds))
        top.count = self.cost  # the longest runs' counts have served
        self.bits = max(10, int(len(top.grams) * 1.5).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.slots[self._slot(top.grams)] = np.arange(len(top.grams), dtype=np.int32)

    def _slot(self, runs: np.ndarray) -> np.ndarray:
        return ((runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def log10(self, runs: np.ndarray) -> np.ndarray:
        """Log10 probability of the last byte of each run after the others."""
        top = self.levels[self.order]
        if not len(top.grams):
            return self._slow(runs)
        at = self.slots[self._slot(runs)]
        out = self.cost[at]
        miss = np.flatnonzero((top.grams[at] != runs) | (at < 0))
        if len(miss):
            rare, back = np.unique(runs[miss], return_inverse=True)
            out[miss] = self._slow(rare)[back]
        return out

    def _slow(self, runs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(runs))
        open_, entered = np.ones(len(runs), bool), np.zeros(len(runs), bool)
        n, u = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
        for i in range(self.order, -1, -1):
            level = self.levels[i]
            part = runs & np.uint64((1 << 8 * (i + 1)) - 1)
            context, known = find(level.contexts, part >> np.uint64(8))
            known &= open_
            new = known & ~entered
            n[new], u[new] = level.seen[context[new]], level.kinds[context[new]]
            gram, hit = find(level.grams, part)
            hit &= known
            out[hit] += self.cost[gram[hit]] if i == self.order else np.log10(level.count[gram[hit]] / (n[hit] + u[hit]))
            open_ &= ~hit
            on = known & ~hit
            paid = on & (u > 0)
            out[paid] += np.log10(u[paid] / (n[paid] + u[paid]))
            entered |= known
            n[on], u[on] = level.rest[context[on]], level.fresh[context[on]]
        never = 256 - len(self.levels[0].grams)
        out[open_] -= np.log10(max(1, never))
        return out


# -- training -------------------------------------------------------------------------------------------------
def _chunks(batches, columns: tuple[str, ...], chunk_bytes: int = CHUNK_BYTES):
    """Lists of column values, of about `chunk_bytes` of text each, or one longer text."""
    held, size = [], 0
    for b in batches:
        for at in range(0, b.num_rows, 256):
            for row in zip(*(b.column(c).slice(at, 256).to_pylist() for c in columns)):
                held.append(row)
                size += len(row[0])
                if size >= chunk_bytes:
                    yield list(zip(*held))
                    held, size = [], 0
    if held:
        yield list(zip(*held))


def _word_ids(bodies: list[bytes], cache: WordCache) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens and where each document's start."""
    split = [b.lower().split() for b in bodies]
    size = np.array([len(w) + 1 for w in split], np.int64)
    ids = np.fromiter((h for words in split for h in (*map(cache.__getitem__, words), END_WORD)), np.uint64, int(size.sum()))
    return ids, np.concatenate([[0], np.cumsum(size)[:-1]])


def counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, key, n): how often each run of bytes and each word stands in all rows of docs."""

    def count(batches):
        cache, held = WordCache(word_hash), {GRAMS: [], WORDS: []}

        def flush(kind):
            keys, n = summed(*(np.concatenate(x) for x in zip(*held[kind])))
            held[kind] = []
            for at in range(0, len(keys), 500_000):
                part = keys[at : at + 500_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(n[at : at + 500_000])], ["kind", "key", "n"])

        for (bodies,) in _chunks(batches, ("body",)):
            for kind, ids in ((GRAMS, byte_runs(bodies, order)[0]), (WORDS, _word_ids(bodies, cache)[0])):
                keys, n = np.unique(ids, return_counts=True)
                held[kind].append((keys, n.astype(np.int64)))
                if sum(len(k) for k, _ in held[kind]) > FLUSH_ROWS:
                    merged = summed(*(np.concatenate(x) for x in zip(*held[kind])))
                    held[kind] = [merged]
                    if len(merged[0]) > FLUSH_ROWS // 2:
                        yield from flush(kind)
        for kind in held:
            if held[kind]:
                yield from flush(kind)

    found = docs.select(text_bytes().alias("body")).mapInArrow(count, "kind int, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class Trained:
    order: int
    folder: str
    parts: tuple[int, int]
    tokens: int
    distinct: int


def train(docs: DataFrame, order: int = ORDER, part_rows: int = PART_ROWS) -> Trained:
    """Counts all rows of docs into tables in the shared folder."""
    if not 1 <= order <= 6:
        raise ValueError("order is 1 to 6")
    spark = docs.sparkSession
    table = stored(counts(docs, order), "ppm-counts")
    total = {r["kind"]: r for r in table.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
    rows = [total[k]["rows"] if k in total else 0 for k in (GRAMS, WORDS)]
    parts = tuple(max(1, -(-r // part_rows)) for r in rows)
    folder = fresh_path(spark, "ppm-model")
    last_two = F.expr("shiftright(key, 8) & 65535")
    place = F.when(F.col("kind") == GRAMS, last_two % parts[0]).otherwise((F.shiftrightunsigned("key", 40) % parts[1]).cast("int"))
    placed = table.withColumn("part", place.cast("int"))
    pairs = placed.where(F.col("kind") == GRAMS).groupBy(F.expr("key & 65535").alias("key")).agg(F.sum("n").alias("n")).select(F.lit(2).alias("kind"), "key", "n", F.lit(0).alias("part"))
    # Ranges of keys, so a part's files in order of name hold its keys in order.
    ranged = placed.select("kind", "key", "n", "part").unionByName(pairs).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "kind", "part", "key")
    ranged.sortWithinPartitions("kind", "part", "key").write.partitionBy("kind", "part").parquet(folder)
    words = total.get(WORDS)
    return Trained(order, folder, parts, words["n"] if words else 0, words["rows"] if words else 0)


def _table(folder: str, kind: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending as signed numbers, and counts."""
    fs, base = pafs.FileSystem.from_uri(folder)
    found = fs.get_file_info(pafs.FileSelector(f"{base}/kind={kind}/part={part}", allow_not_found=True))
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for path in sorted(f.path for f in found if f.base_name.endswith(".parquet")):
        with fs.open_input_file(path) as src:
            got = pq.read_table(src, columns=["key", "n"], use_threads=False)
        keys.append(got.column("key").to_numpy())
        counts.append(got.column("n").to_numpy())
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    if len(counts) and counts.max() < 1 << 32:
        counts = counts.astype(np.uint32)
    return summed(keys, counts)


_held: dict[tuple, object] = {}


def _release() -> None:
    """Gives the parts' memory back: Spark keeps a task's worker for later tasks, and idle ones would hold a part each."""
    _held.clear()
    pa.default_memory_pool().release_unused()


def _part(trained: Trained, kind: int, part: int):
    """One part of a model, the last that this task used of its kind."""
    key = (trained.folder, kind, part)
    if key not in _held:
        for k in [k for k in _held if k[1] == kind]:
            del _held[k]
        if kind == GRAMS:
            (runs, n), (pairs, pair_n) = _table(trained.folder, GRAMS, part), _table(trained.folder, 2, 0)
            n, pair_n = n.astype(np.int64), pair_n.astype(np.int64)
            _held[key] = Model(trained.order, runs.view(np.uint64), n, pairs.view(np.uint64), pair_n)
        else:
            _held[key] = _table(trained.folder, WORDS, part)
    return _held[key]


# -- scoring --------------------------------------------------------------------------------------------------
def _byte_costs(bodies: list[bytes], trained: Trained) -> np.ndarray:
    """Log10 probability of each document's bytes and its end mark; runs are made for one block and part at a time."""
    order, parts = trained.order, trained.parts[0]
    pad, end = bytes([END]) * order, bytes([END])
    raw = np.frombuffer(b"".join([x for b in bodies for x in (pad, b, end)]), np.uint8)
    size = np.array([order + len(b) + 1 for b in bodies], np.int64)
    stops = np.cumsum(size)
    coded = np.ones(len(raw), bool)
    for k in range(order):
        coded[stops - size + k] = False
    cost = np.zeros(len(bodies))
    for part in range(parts):
        model = _part(trained, GRAMS, part)
        for lo in range(order, len(raw), BLOCK):
            hi = min(lo + BLOCK, len(raw))
            place = raw[lo - 1 : hi - 1].astype(np.int32)
            if order > 1:
                place |= raw[lo - 2 : hi - 2].astype(np.int32) << 8
            at = np.flatnonzero(coded[lo:hi] & (place % parts == part)) + lo
            if not len(at):
                continue
            runs = np.zeros(len(at), np.uint64)
            for k in range(order, -1, -1):
                runs = runs << np.uint64(8) | raw[at - k]
            first, last = np.searchsorted(stops, (at[0], at[-1]), side="right")
            doc = np.searchsorted(stops[first : last + 1], at, side="right")
            cost[first : last + 1] += np.bincount(doc, model.log10(runs), last - first + 1)
    return cost


def _word_costs(bodies: list[bytes], trained: Trained, cache: WordCache) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each document, those known, and their log10 probability by counts of words."""
    floor, parts = trained.tokens + 0.1 * (trained.distinct + 1), trained.parts[1]
    bounds = np.flatnonzero(np.diff(np.cumsum([len(b) for b in bodies]) // BLOCK, prepend=-1))
    spans, n_tokens = [], np.zeros(len(bodies), np.int64)
    for lo, hi in zip(bounds, np.append(bounds[1:], len(bodies))):
        words, firsts = _word_ids(bodies[lo:hi], cache)
        n_tokens[lo:hi] = np.diff(np.append(firsts, len(words)))
        spans.append((lo, hi, words))
    n_known, base = np.zeros(len(bodies), np.int64), np.zeros(len(bodies))
    for part in range(parts):
        keys, known = _part(trained, WORDS, part)
        for lo, hi, words in spans:
            at = np.flatnonzero((words >> np.uint64(40)) % np.uint64(parts) == part)
            distinct, back = np.unique(words[at], return_inverse=True)
            where, hit = find(keys, distinct.view(np.int64))
            n = np.zeros(len(distinct), np.int64)
            n[hit] = known[where[hit]]
            doc = np.repeat(np.arange(hi - lo), n_tokens[lo:hi])[at]
            n_known[lo:hi] += np.bincount(doc[(n > 0)[back]], minlength=hi - lo)
            base[lo:hi] += np.bincount(doc, np.log10((n + 0.1) / floor)[back], hi - lo)
    return n_tokens, n_known, base


def score_documents(docs: DataFrame, trained: Trained) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row."""

    def score(batches):
        try:
            yield from scored(batches)
        finally:
            _release()

    def scored(batches):
        cache = WordCache(word_hash)
        # Parts are loaded once a chunk, so there is more in a chunk where there are more parts.
        size = min(MOST_CHUNK, CHUNK_BYTES * (sum(trained.parts) - 1))
        for bodies, ids in _chunks(batches, ("body", "doc_id"), size):
            cost = _byte_costs(bodies, trained)
            n_tokens, n_known, base = _word_costs(bodies, trained, cache)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, (n_tokens, n_known, base, cost))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return texts.mapInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trained = train(docs.where(~held_out(10, 0)))
    scored = score_documents(docs, trained)
    return scored.select("doc_id", held_out(10, 0).alias("held_out"), "n_tokens", "n_known", F.lit(trained.tokens).cast("long").alias("train_tokens"), "base_score", "score")
