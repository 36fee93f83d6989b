"""Operator 12: spelling variants by Levenshtein automata on trie shards.

Words are counted over all texts and sorted. Every SHARD_WORDS of them (or SHARD_LETTERS letters) in order make a shard: a compact trie of
25 bytes a node (a bit a symbol, the first child, the word that ends there), so a shard's size has a bound. Shards are broadcast in
rounds of ROUND_BYTES at most; in a round each task meets every shard with its words. A word's automaton of distance one is its
position and whether the edit is spent. Automaton and trie are walked together, depth first, many words at a time: a state whose edit is not
spent goes on to every child of its node (exact, replaced, inserted) or skips a letter (deleted); one whose edit is spent follows
the only child that its word allows, and is a neighbour if word and node end together. Edits that give the same neighbour are made
once: of a run of equal letters the last is deleted, and no letter is inserted before its like. A shard is a range of words,
so automata of other words die at its first nodes.

A task reduces a word's neighbours to their number and the best form before anything is shuffled. Forms have ten times the word's
count, so chains of forms are short; roots are found by doubling.

Defined results: null and empty texts hold no words; a null doc_id counts as the empty text in the hash; repeated rows count as often as
they stand; a word of any length is whole; words without neighbours have n_near 0; an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.llm.common import CRC32_TABLE_SQL, crc32_sql, fresh_path, stored

LETTERS = r"[A-Za-zÀ-ÿ]"
SHORTEST, LEAST, FACTOR, SLIPS = 7, 2, 10, 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SHARD_WORDS, SHARD_LETTERS = 100_000, 2_000_000
ROUND_BYTES = 64 << 20
QUERY_WORDS, BLOCK = 20_000, 4096

#: a-z and the 64 letters from U+00C0, in the order of their code points; a word's Latin-1 bytes to symbols.
SYMBOL = np.full(256, 255, np.uint8)
SYMBOL[97:123] = np.arange(26)
SYMBOL[192:256] = np.arange(26, 90)
_SHARD = "first string, words string, n binary, bits binary, child binary, ends binary"
_FOUND = "word string, n_near long, form_n long, form string"


# -- words --------------------------------------------------------------------------------------------------------
def words(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, slips: int = SLIPS) -> DataFrame:
    """(word, n): letters in a row, with the slips that the hash of document and word asks for, and how often they stand in all texts."""
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{shortest},}})"))).alias("run"))
    runs = each.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    slipped = F.expr("overlay(run PLACING '' FROM cast(h % length(run) as int) + 1 FOR 1)")
    seen = hashed.select(F.when(F.col("h") % slips == 0, slipped).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return seen.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


# -- tries --------------------------------------------------------------------------------------------------------
class Codes:
    """Words as symbols: `flat` end to end, `at` where each begins, `size` their lengths."""

    def __init__(self, items: list[str]):
        raw = "".join(items).encode("latin-1")
        self.flat = np.append(SYMBOL[np.frombuffer(raw, np.uint8)], np.uint8(255))
        self.size = np.fromiter(map(len, items), np.int64, len(items))
        self.at = np.cumsum(self.size) - self.size

    def symbol(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """255 at a word's end."""
        return np.where(place < self.size[word], self.flat[np.minimum(self.at[word] + place, len(self.flat) - 1)], np.uint8(255))


class Trie:
    """Nodes level by level, a node's children side by side in order of symbol; node 0 is the root."""

    def __init__(self, bits: np.ndarray, child: np.ndarray, ends: np.ndarray):
        self.bits, self.child, self.ends = bits, child, ends  # (nodes, 2) of 64 symbols each; first child; number of the word that ends here, or -1
        self.width = np.bitwise_count(bits).sum(1).astype(np.int64)

    @classmethod
    def of(cls, items: list[str]) -> Trie:
        """Of distinct sorted words."""
        codes, live = Codes(items), np.arange(len(items))
        node, parents, symbols, ends, made = np.zeros(len(items), np.int64), [], [], [np.full(1, -1, np.int32)], 1
        for depth in range(int(codes.size.max(initial=0))):
            keep = codes.size[live] > depth
            live, node = live[keep], node[keep]
            code = codes.flat[codes.at[live] + depth]
            new = np.ones(len(live), bool)
            new[1:] = (node[1:] != node[:-1]) | (code[1:] != code[:-1])
            parents.append(node[new])
            symbols.append(code[new])
            node = made + np.cumsum(new) - 1
            end = np.full(int(new.sum()), -1, np.int32)
            last = codes.size[live] == depth + 1
            end[node[last] - made] = live[last]
            ends.append(end)
            made += len(end)
        bits, child = np.zeros((made, 2), np.uint64), np.zeros(made, np.int32)
        if parents:
            parent, symbol = np.concatenate(parents), np.concatenate(symbols)
            np.bitwise_or.at(bits, (parent, symbol >> 6), np.uint64(1) << (symbol & 63).astype(np.uint64))
            firsts, where = np.unique(parent, return_index=True)
            child[firsts] = where + 1
        return cls(bits, child, np.concatenate(ends))

    def follow(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The child by a symbol, or -1."""
        high = symbol >= 64
        own = self.bits[node, high.astype(np.int8)]
        bit = np.uint64(1) << (symbol & 63).astype(np.uint64)
        rank = np.bitwise_count(own & (bit - np.uint64(1))).astype(np.int64) + np.where(high, np.bitwise_count(self.bits[node, 0]), 0)
        return np.where((own & bit != 0) & (symbol < 128), self.child[node] + rank, -1)

    def symbols_below(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every child of every node: the row of its node, the child, its symbol."""
        row = np.repeat(np.arange(len(node)), self.width[node])
        nth = np.arange(len(row)) - np.repeat(np.cumsum(self.width[node]) - self.width[node], self.width[node])
        octets = np.ascontiguousarray(self.bits[node]).view(np.uint8)
        symbol = np.nonzero(np.unpackbits(octets, axis=1, bitorder="little"))[1]
        return row, self.child[node[row]] + nth, symbol.astype(np.uint8)

    def neighbours(self, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        """(word, number of a word of the trie) of all pairs at distance exactly one, each once."""
        found = []
        every = np.arange(len(codes.size))
        for lo in range(0, len(every), BLOCK):
            w = every[lo : lo + BLOCK]
            stack = [(False, w, np.zeros(len(w), np.int64), np.zeros(len(w), np.int64))]
            while stack:  # the deepest states first
                spent, w, u, i = stack.pop()
                c = codes.symbol(w, i)
                if spent:
                    over = c == 255
                    hit = self.ends[u[over]]
                    found.append((w[over][hit >= 0], hit[hit >= 0]))
                    w, u, i, c = w[~over], u[~over], i[~over], c[~over]
                    u = self.follow(u, c)
                    on = u >= 0
                    if on.any():
                        stack.append((True, w[on], u[on], i[on] + 1))
                    continue
                row, v, s = self.symbols_below(u)
                own = c[row]
                same, over = s == own, own == 255
                if same.any():
                    stack.append((False, w[row[same]], v[same], i[row[same]] + 1))
                put, change = row[~same], row[~same & ~over]
                skip = np.nonzero((c != 255) & (codes.symbol(w, i + 1) != c))[0]
                nodes = np.concatenate([v[~same], v[~same & ~over], u[skip]])
                places = np.concatenate([i[put], i[change] + 1, i[skip] + 1])
                if len(nodes):
                    stack.append((True, w[np.concatenate([put, change, skip])], nodes, places))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int64)


def _shard_row(items: list[str], n: list[int]) -> pa.RecordBatch:
    trie = Trie.of(items)
    cells = [items[0], "\n".join(items), np.array(n, np.int64).tobytes(), trie.bits.tobytes(), trie.child.tobytes(), trie.ends.tobytes()]
    names = [c.split()[0] for c in _SHARD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([c], pa.string() if k < 2 else pa.binary()) for k, c in enumerate(cells)], names)


def _build(most_words: int, most_letters: int):
    def walk(batches):
        items, n, letters = [], [], 0
        for batch in batches:
            for word, count in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                if items and (len(items) == most_words or letters + len(word) > most_letters):
                    yield _shard_row(items, n)
                    items, n, letters = [], [], 0
                items.append(word)
                n.append(count)
                letters += len(word)
        if items:
            yield _shard_row(items, n)

    return walk


def shards(counted: DataFrame, most_words: int = SHARD_WORDS, most_letters: int = SHARD_LETTERS) -> DataFrame:
    """Tries of ranges of the words: at most `most_words` and `most_letters` each (a longer word is a shard of its own)."""
    return counted.sort("word").mapInArrow(_build(most_words, most_letters), _SHARD)


def _search(shared):
    def walk(batches):
        tries = []
        for words_, n, bits, child, ends in shared.value:
            trie = Trie(np.frombuffer(bits, np.uint64).reshape(-1, 2), np.frombuffer(child, np.int32), np.frombuffer(ends, np.int32))
            tries.append((words_.split("\n"), np.frombuffer(n, np.int64), trie))
        for batch in batches:
            asked = batch.column("word").to_pylist()
            codes = Codes(asked)
            for names, n, trie in tries:
                w, near = trie.neighbours(codes)
                order = np.lexsort((near, -n[near], w))  # of equal counts the smaller word
                w, near = w[order], near[order]
                who, first, many = np.unique(w, return_index=True, return_counts=True)
                best = near[first]
                cells = [[asked[k] for k in who.tolist()], many, n[best], [names[k] for k in best.tolist()]]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)], ["word", "n_near", "form_n", "form"])

    return walk


def rounds(table: DataFrame, most: int = ROUND_BYTES) -> list[list[str]]:
    """First words of the shards, in groups of at most `most` bytes (or of one shard); a row a shard reaches the driver."""
    size = sum(F.octet_length(c) for c in ("words", "n", "bits", "child", "ends"))
    out, held = [[]], 0
    for r in table.select("first", size.alias("size")).orderBy("first").toLocalIterator():
        if out[-1] and held + r["size"] > most:
            out.append([])
            held = 0
        out[-1].append(r["first"])
        held += r["size"]
    return [g for g in out if g]


def near_words(counted: DataFrame, table: DataFrame, most: int = ROUND_BYTES, per_task: int = QUERY_WORDS) -> DataFrame:
    """(word, n_near, form_n, form) of every word with a neighbour: how many, and the best one's count and word."""
    spark: SparkSession = counted.sparkSession
    path = fresh_path(spark, "near-words")
    spark.createDataFrame([], _FOUND).write.parquet(path)
    tasks = max(spark.sparkContext.defaultParallelism, counted.count() // per_task + 1)
    asked = counted.select("word").repartition(tasks, "word")
    for group in rounds(table, most):
        rows = table.where(F.col("first").between(group[0], group[-1])).collect()  # `most` bytes, or one shard
        shared = spark.sparkContext.broadcast([tuple(bytes(c) if isinstance(c, bytearray) else c for c in r[1:]) for r in rows])
        asked.mapInArrow(_search(shared), _FOUND).write.mode("append").parquet(path)
        shared.destroy()
    found = spark.read.schema(_FOUND).parquet(path)
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends. Counts grow tenfold a step, so a few doublings are enough."""
    found = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        if onward.join(found.select("root"), "root", "left_semi").limit(1).count() == 0:
            return found
        found = stored(found.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "spelling-roots")


def variants(docs: DataFrame, factor: int = FACTOR, most_words: int = SHARD_WORDS, most: int = ROUND_BYTES) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the texts."""
    counted = stored(words(docs), "spelling-words")
    table = stored(shards(counted, most_words), "spelling-shards")
    near = near_words(counted, table, most)
    known = stored(counted.join(near, "word", "left").withColumn("formed", F.coalesce(F.col("form_n") >= factor * F.col("n"), F.lit(False))), "spelling-near")
    ends = roots(known.where("formed").select("word", "form"))
    return known.join(ends, "word", "left").select(
        "word",
        F.when(F.col("formed"), F.col("form")).alias("form"),
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("formed"), F.col("form_n")).alias("form_n"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = f"""
WITH RECURSIVE {CRC32_TABLE_SQL},
runs AS (SELECT id, translate(run, '{UPPER}', '{LOWER}') run, count(*) c
    FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{SHORTEST},}}')) run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, c, {crc32_sql("(id || ':' || run)")} h FROM runs, crc_table),
slipped AS (SELECT c, CASE WHEN h % {SLIPS} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END word FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) n FROM slipped WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(c) >= {LEAST}),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) rest FROM (SELECT word, n, unnest(range(length(word))) i FROM words)),
pairs AS (SELECT a.word, b.word near, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) n_near, min({{'n': -n, 'near': near}}) b FROM pairs GROUP BY word),
known AS (SELECT word, n, coalesce(n_near, 0) n_near, CASE WHEN -b.n >= {FACTOR} * n THEN b.near END form, CASE WHEN -b.n >= {FACTOR} * n THEN -b.n END form_n FROM words LEFT JOIN best USING (word)),
walk(word, root) AS (SELECT word, form FROM known WHERE form IS NOT NULL UNION ALL SELECT w.word, k.form FROM walk w JOIN known k ON k.word = w.root WHERE k.form IS NOT NULL),
ends AS (SELECT w.word, w.root FROM walk w JOIN known k ON k.word = w.root WHERE k.form IS NULL)
SELECT word, form, coalesce(root, word) root, n, n_near, form_n FROM known LEFT JOIN ends USING (word)
"""
