"""Operator 8: benchmark decontamination by template canonicalisation.

Words lose outer punctuation and case; numbers, names (capitalised inside a sentence) and units become typed placeholders. Runs of one
type are one slot, and units behind a number belong to its slot, so "Mary Ann" may stand for "Bob", "1 200" for "7" and "3 km per hour" for "5mph".
Windows of WINDOW tokens (words and slots) of a document are hashed where all their words are among the benchmark's, by a bitmap of fixed
size; those that pass a bitmap of the benchmark's windows are joined with the benchmark's windows on the hash. Windows with slots count if PLAIN words are in them, so tables of numbers match nothing. Windows
are also hashed with the slots' fillings in place of their types, and a hit of either kind counts. Hits of a document and an item that lie
on one diagonal form an alignment.
The slots of an alignment must be consistent: over the tokens covered, a filling of the item's always stands against the same
filling in the document, and of names back too (numbers may collide; names, numbers and units each on their own; a
tenth of the slots may be at odds, and more of the numbers and units where nine tenths of the item's plain words agree), and at
least MIN_WORDS plain words must be covered. So a question with other numbers or names filled in is found, while text
that merely has its shape is not. A document is contaminated by an item of whose words its consistent alignments together cover at least the
share COVER, or one of them RUN tokens in a row, half of them plain words. Less than that, as a third of a short item, is not told from common phrases.
Apart from templates, windows of lower-cased words are matched as they are, whatever reads as a name: who has the share VERBATIM
of an item's words that way holds a copy, whatever its case or line breaks.

Items shorter than WINDOW tokens make one window of their whole length; those of 11 to 16 have windows of half their
length, so one changed word leaves windows whole. An item without words matches nothing.
Both sides are large-safe: each bitmap is 2**BITMAP_BITS bits whatever the benchmark's size, and the join is a shuffle join
that Spark may broadcast by the size it measured. Windows that more than SHARED items have, as a common instruction, are left out of the
first join where they alone cannot report an item: the words that an item's common windows cover fall short of every rule. A pair that is
reported has another of the item's windows, then, so those pairs are looked up for the common windows as well, by document and hash. Nothing
is lost, and no window joins more than SHARED items but for items that it may report, whose pairs are results.

Defined results: null and empty texts match nothing; repeated rows are each reported (one row a doc_id and item);
rows with null ids take no part; empty tables give an empty result; other columns play no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tapeloom.llm.common import WordCache, mix, stored, text_bytes, word_hash

WINDOW = 8
COVER, VERBATIM = 0.5, 0.9
MIN_WORDS, PLAIN = 4, 2
RUN = 13  # covered tokens in a row that suffice alone
LEAST_WINDOW = 5  # of items of under 2 * WINDOW + 1 tokens
BITMAP_BITS = 23
SHARED = 32  # items; a window that more have is common
WORD, NUMBER, NAME, UNIT, NOTHING, AFTER_NUMBER = range(6)
TEMPLATE, COPY = 0, 1

# Words read as units of measure; those of the second list only behind a number.
UNITS = "mm cm km ft yd mg kg oz lb lbs ml cl dl sec ms min hr hrs day days week weeks month months year years hz khz mhz ghz kw mw kpa bar cal kcal mph kmh percent usd eur gbp dollars euros cents meters metres kilometers kilometres miles grams kilograms pounds liters litres hour hours minutes seconds"
UNITS_AFTER_NUMBER = "m in mi g t l s h w v a k c f j ma pa"
_UNITS, _AFTER = frozenset(UNITS.split()), frozenset(UNITS_AFTER_NUMBER.split())
_OUTER = re.compile(r"^\W+|\W+$")
_NUMBER = re.compile(r"[+-]?[$€£]?\d+([.,:/]\d+)*%?([^\W\d_]*)")
_STOP = re.compile(r"[.!?:][\"')\]»”]*$")
PER = np.uint64(word_hash(b"per") & ~0x1F)
# Bytes that no UTF-8 text holds stand for the end of a line and of a document.
LINE, END = b"\xff", b"\xfe"
SENTINEL = np.uint64(word_hash(END) & ~0x1F)
CHUNK_BYTES = 1 << 20


def _entry(word: bytes) -> tuple[int, int, int, int]:
    """Hash, kind, whether a capital leads, and whether it ends a sentence, of one white-space word."""
    if word == LINE or word == END:
        return word_hash(word), WORD if word == END else NOTHING, 0, 1
    text = word.decode("utf-8", "replace")
    core = text[:-1] if text[-1] in ".,;:!?" else text
    if core.isalpha():  # most words, without patterns
        low = core.lower()
        kind = UNIT if low in _UNITS else AFTER_NUMBER if low in _AFTER else WORD
        return word_hash(low.encode()), kind, int(len(core) > 1 and core[0].isupper() and not core.isupper()), int(text[-1] in ".:!?")
    core = _OUTER.sub("", text)
    low = core.lower()
    parts = low.split("/")
    if not core:
        kind = NOTHING
    elif (m := _NUMBER.fullmatch(low)) and (not m[2] or m[2] in _UNITS or m[2] in _AFTER):
        kind = NUMBER
    elif low in _UNITS or len(parts) > 1 and all(p in _UNITS or p in _AFTER for p in parts):
        kind = UNIT
    else:
        kind = AFTER_NUMBER if low in _AFTER else WORD
    name = len(core) > 1 and core[0].isupper() and not core.isupper()
    return word_hash(low.encode()), kind, int(name), int(bool(_STOP.search(text)))


def _packed(word: bytes) -> int:
    h, kind, name, stop = _entry(word)
    return (h & ~0x1F) | kind << 2 | name << 1 | stop


@dataclass
class Template:
    """Tokens of a text: kind and filling of each, its first word and number of words; and the words themselves."""

    kind: np.ndarray
    fill: np.ndarray
    first: np.ndarray
    size: np.ndarray
    words: np.ndarray

    @property
    def form(self) -> np.ndarray:
        return np.where(self.kind == WORD, self.fill, self.kind.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _kinds(body: bytes, cache: WordCache) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind and hash of each word that has a letter or digit, and whether a capital leads it."""
    packed = cache.array(body.replace(b"\n", b" " + LINE + b" ").split(), np.uint64)
    first = np.ones(len(packed), bool)
    fill, kind = packed & ~np.uint64(0x1F), (packed >> np.uint64(2) & np.uint64(7)).astype(np.int8)
    capital, stop = (packed >> np.uint64(1) & np.uint64(1)).astype(bool), (packed & np.uint64(1)).astype(bool)
    first[1:] = stop[:-1]
    kind = np.where(((kind == WORD) | (kind == AFTER_NUMBER)) & capital & ~first, NAME, kind)
    keep = kind != NOTHING
    return kind[keep], fill[keep], capital[keep]


def tokens(kind: np.ndarray, fill: np.ndarray) -> Template:
    """Runs of one type as one slot; units behind a number, and between units "per", join the slot before."""
    kind = kind.copy()
    after = np.flatnonzero(kind == AFTER_NUMBER)
    if len(after):
        number = np.concatenate([[False], kind[:-1] == NUMBER])
        kind[after] = np.where(number[after], UNIT, WORD)
    unit = kind == UNIT
    if unit.any() and len(kind) > 2:
        per = np.flatnonzero((fill[1:-1] == PER) & unit[:-2] & unit[2:]) + 1
        kind[per] = UNIT
        unit[per] = True
    if not kind.any():
        return Template(kind, fill, np.arange(len(fill)), np.ones(len(fill), np.int64), fill)
    start = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == WORD)])
    start[1:] &= ~(unit[1:] & (kind[:-1] == NUMBER))
    first = np.flatnonzero(start)
    size = np.diff(np.append(first, len(kind)))
    joined, out = np.flatnonzero(size > 1), fill[first]
    for j in joined.tolist():
        out[j] = mix(*fill[first[j] : first[j] + size[j]]) & ~np.uint64(0x1F)
    return Template(kind[first], out, first, size, fill)


def template(body: bytes, cache: WordCache) -> Template:
    return tokens(*_kinds(body, cache)[:2])


def all_windows(form: np.ndarray, lengths: dict[int, list[int]]) -> dict[int, dict[int, np.ndarray]]:
    """By salt and length: the hash of the window that starts at each position. Longer windows carry the shorter ones' hashes on."""
    out, state = {salt: {} for salt in lengths}, np.zeros(len(form), np.uint64)
    for k in range(min(max((n for some in lengths.values() for n in some), default=0), len(form))):
        state = mix(state[: len(form) - k], form[k:])
        for salt, some in lengths.items():
            if k + 1 in some:
                out[salt][k + 1] = mix(state, np.uint64(salt << 8 | k + 1))
    return out


def windows(form: np.ndarray, lengths, salt: int) -> dict[int, np.ndarray]:
    return all_windows(form, {salt: lengths})[salt]


def slot_windows(t: Template, lengths) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: hashes of typed windows, and which of them count: those with PLAIN plain words, or no slot."""
    plain = np.concatenate([[0], np.cumsum(t.kind == WORD)])
    return {n: (h, plain[n:] - plain[:-n] >= min(n, PLAIN)) for n, h in windows(t.form, lengths, TEMPLATE).items()}


def window_of(n: int, window: int = WINDOW) -> int:
    """Window of an item of n tokens: where one changed word in the middle would leave no whole window, half of the rest, or LEAST_WINDOW."""
    return min(window, n) if n < 2 * LEAST_WINDOW + 1 else min(window, (n - 1) // 2)


_GRAMS = {"h": "long", "item_id": "long", "form": "int", "pos": "int", "length": "int", "n_item": "int", "n_plain": "int", "kinds": "array<int>", "fills": "array<long>", "sizes": "array<int>"}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], kinds: dict[str, str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(columns, kinds.values())], list(kinds))


def _schema(kinds: dict[str, str]) -> str:
    return ", ".join(f"{k} {t}" for k, t in kinds.items())


def item_windows(body: bytes, cache: WordCache, window: int = WINDOW) -> list[tuple]:
    """Of one item: hash, form, position, length, words of the item, its plain words, and kinds, fillings and words of the window's tokens."""
    kind, fill, capital = _kinds(body, cache)
    t = tokens(kind, fill)
    if not len(t.kind):
        return []
    rows, n_item, n_plain = [], len(t.words), int((t.kind == WORD).sum())
    signed = lambda x: x.view(np.int64)

    def add(h, form, pos, kinds, fills, sizes):
        rows.append((int(signed(np.array([h], np.uint64))[0]), form, pos, len(kinds), n_item, n_plain, kinds.tolist(), signed(fills).tolist(), sizes.tolist()))

    def typed(t: Template, length: int, at: int, most: int):
        for p, (h, counts) in enumerate(zip(*slot_windows(t, [length])[length])):
            if counts and p < most:
                add(h, TEMPLATE, p + at, t.kind[p : p + length], t.fill[p : p + length], t.size[p : p + length])

    length = window_of(len(t.kind), window)
    typed(t, length, 0, len(t.kind))
    if t.kind.any():
        for p, h in enumerate(windows(t.fill, [length], TEMPLATE)[length]):
            add(h, TEMPLATE, p, np.zeros(length, np.int8), t.fill[p : p + length], t.size[p : p + length])
    if kind[0] == WORD and capital[0]:  # inside a sentence, its first word reads as a name
        inside = tokens(np.concatenate([[NAME], kind[1:]]).astype(kind.dtype), fill)
        typed(inside, min(length, len(inside.kind)), len(t.kind) - len(inside.kind), 1)
    length = window_of(n_item, window)
    for p, h in enumerate(windows(t.words, [length], COPY)[length]):
        add(h, COPY, p, np.zeros(length, np.int8), t.words[p : p + length], np.ones(length, np.int64))
    return rows


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each window of each item, with its tokens."""

    def extract(batches):
        cache = WordCache(_packed)
        for b in batches:
            rows = [(r[0], item, *r[1:]) for item, body in zip(b.column("item_id").to_pylist(), b.column("body").to_pylist()) for r in item_windows(body, cache, window)]
            yield _batch(rows, _GRAMS)

    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("body"))
    return items.mapInArrow(extract, _schema(_GRAMS))


def _bits(hashes: DataFrame) -> np.ndarray:
    """Which values the top BITMAP_BITS bits of the column h take."""
    slot = hashes.select(F.shiftrightunsigned("h", 64 - BITMAP_BITS).alias("slot"))
    words = slot.selectExpr("cast(slot div 64 as int) AS word", "shiftleft(1L, cast(slot % 64 as int)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    bits[words["word"].to_numpy(int)] = words["bits"].to_numpy(np.int64)
    return bits.view(np.uint64)


def _among(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(64 - BITMAP_BITS)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _runs(flag: np.ndarray, least: int) -> np.ndarray:
    """Places of the flags in runs of at least that many."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]])))
    start, size = edge[::2], edge[1::2] - edge[::2]
    start, size = start[size >= least], size[size >= least]
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(start) else start


_HITS = {"doc_id": "long", "doc_pos": "int", "h": "long", "doc_fills": "array<long>"}


def _open_items(common: DataFrame, cover: float) -> DataFrame:
    """(item_id) of the items that their common windows alone may report: bounds of what contaminated() asks for, by the tokens covered."""
    cells = common.select("item_id", "form", "n_item", "pos", F.posexplode("sizes").alias("k", "size"))
    cells = cells.groupBy("item_id", "form", (F.col("pos") + F.col("k")).alias("at")).agg(F.max("size").alias("size"), F.min("n_item").alias("n_item"))
    share = cells.groupBy("item_id", "form").agg((F.sum("size") / F.min("n_item")).alias("share"))
    enough = share.where(F.when(F.col("form") == TEMPLATE, F.col("share") >= cover).otherwise(F.col("share") >= VERBATIM))
    island = F.col("at") - F.row_number().over(Window.partitionBy("item_id").orderBy("at"))
    runs = cells.where(F.col("form") == TEMPLATE).withColumn("island", island).groupBy("item_id", "island").agg(F.count("*").alias("n")).where(F.col("n") >= RUN)
    return enough.select("item_id").union(runs.select("item_id")).distinct()


def _met(hits: DataFrame, grams: DataFrame, on: list[str]) -> DataFrame:
    """Windows of documents with the items' windows of the same hash and plain words: hashes alone may coincide."""
    met = hits.join(grams, on).withColumn("shift", F.col("doc_pos") - F.col("pos"))
    return met.where(F.forall(F.arrays_zip("kinds", "fills", "doc_fills"), lambda c: (c["kinds"] != WORD) | (c["fills"] == c["doc_fills"])))


def _joined(hits: DataFrame, grams: DataFrame, cover: float) -> DataFrame:
    """_met() of all windows, but of pairs that only common windows of other items link."""
    common = grams.select("h", "item_id").distinct().groupBy("h").count().where(F.col("count") > SHARED).select("h")
    common = stored(grams.join(common, "h", "left_semi"), "decontam-common")
    if common.limit(1).count() == 0:
        return _met(hits, grams, ["h"])
    hits = stored(hits, "decontam-windows")
    late = stored(common.join(_open_items(common, cover), "item_id", "left_anti"), "decontam-late")
    early = grams.join(late.select("h", "item_id").distinct(), ["h", "item_id"], "left_anti")
    first = stored(_met(hits, early, ["h"]), "decontam-first")
    asked = first.select("doc_id", "item_id").distinct().join(late, "item_id")
    return first.unionByName(_met(hits, asked, ["doc_id", "h"]))


def alignments(docs: DataFrame, grams: DataFrame, cover: float = COVER) -> DataFrame:
    """Windows of documents that are windows of items, with the shift between them; see _joined()."""
    lengths = [(r[0], r[1]) for r in grams.select("form", "length").distinct().collect()]  # at most WINDOW a form
    lengths = {f: sorted(n for g, n in lengths if g == f) for f in (TEMPLATE, COPY)}
    copies = grams.where(F.col("form") == COPY).select(F.explode("fills").alias("h"))
    shared = docs.sparkSession.sparkContext.broadcast((_bits(grams), _bits(copies), lengths))  # 2 MB

    def found(bodies: list[bytes], cache: WordCache):
        """(document, position, hash, fillings) of the windows that pass, of many texts as one."""
        bits, words, lengths = shared.value
        t = tokens(*_kinds((b" " + END + b" ").join(bodies), cache)[:2])
        known = _among(t.words, words) & (t.words != SENTINEL)
        if not known.any() or not any(lengths.values()):
            return
        slot = t.kind != WORD
        filled = np.logical_and.reduceat(known, t.first)
        token = slot | known[t.first]
        typed = (TEMPLATE, True, t.form, token, t.fill)
        for salt, by_type, form, flag, fill in (typed, (TEMPLATE, False, t.fill, filled, t.fill), (COPY, False, t.words, known, t.words)):
            if not (some := lengths[salt]):
                continue
            at = _runs(flag, some[0])
            ends = np.flatnonzero(fill == SENTINEL)
            plain = np.concatenate([[0], np.cumsum(~slot[at])]) if by_type else None
            for n, h in windows(form[at], some, salt).items():
                last = len(at) - n + 1
                hit = _among(h, bits) & (at[n - 1 :] - at[:last] == n - 1)
                if by_type:
                    hit &= plain[n:] - plain[:-n] >= min(n, PLAIN)
                p = at[:last][hit]
                doc = np.searchsorted(ends, p)
                start = np.concatenate([[0], ends + 1])[doc]
                for d, q, r, x in zip(doc.tolist(), (p - start).tolist(), h[hit].view(np.int64).tolist(), p.tolist()):
                    yield d, q, r, fill[x : x + n].view(np.int64).tolist()

    def extract(batches):
        cache, ids, bodies, size = WordCache(_packed), [], [], 0

        def flush():
            return _batch([(ids[d], *rest) for d, *rest in dict.fromkeys((d, q, r, tuple(f)) for d, q, r, f in found(bodies, cache))], _HITS)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc_id, body in zip(part.column("doc_id").to_pylist(), part.column("body").to_pylist()):
                    ids.append(doc_id)
                    bodies.append(body)
                    size += len(body)
                    if size >= CHUNK_BYTES:
                        yield flush()
                        ids, bodies, size = [], [], 0
        if ids:
            yield flush()

    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return _joined(texts.mapInArrow(extract, _schema(_HITS)), grams, cover)


KEY = ["doc_id", "item_id", "form", "shift"]


def _cells(hits: DataFrame) -> DataFrame:
    """Per alignment and token of the item covered: its kind, whether a window without types covers it, the fillings and its words."""
    return (
        hits.select(*KEY, "pos", F.posexplode(F.arrays_zip("kinds", "fills", "doc_fills", "sizes")).alias("k", "cell"))
        .select(*KEY, (F.col("pos") + F.col("k")).alias("at"), "cell.*")
        .groupBy(*KEY, "at")
        .agg(F.max("kinds").alias("kind"), (F.min("kinds") == WORD).alias("plain"), F.first("fills").alias("fill"), F.first("doc_fills").alias("doc_fill"), F.max("sizes").alias("size"))
    )


def _contradictions(cells: DataFrame) -> DataFrame:
    """Per alignment: plain words covered, slots, and slots whose filling is at odds with another's."""
    pairs = cells.groupBy(*KEY, "kind", "fill", "doc_fill").agg(F.count("*").alias("n"), F.sum(F.col("plain").cast("int")).alias("n_plain"))
    there, back = Window.partitionBy(*KEY, "kind", "fill"), Window.partitionBy(*KEY, "kind", "doc_fill")
    many = F.count("*").over(there) > 1
    odd = F.when(F.col("kind") == NAME, many | (F.count("*").over(back) > 1)).otherwise(many)
    return (
        pairs.withColumn("odd", F.when(F.col("kind") != WORD, odd).otherwise(False))
        .groupBy(*KEY)
        .agg(
            F.sum("n_plain").alias("n_words"),
            F.sum(F.when(F.col("kind") != WORD, F.col("n")).otherwise(0)).alias("n_slots"),
            F.sum(F.when(F.col("odd"), F.col("n")).otherwise(0)).alias("n_odd"),
            F.sum(F.when(F.col("odd") & (F.col("kind") == NAME), F.col("n")).otherwise(0)).alias("n_odd_names"),
            F.sum(F.when(F.col("kind") == WORD, F.col("n")).otherwise(0)).alias("n_agree"),
            F.sum(F.when((F.col("kind") != WORD) & (F.col("fill") != F.col("doc_fill")), F.col("n")).otherwise(0)).alias("n_changed"),
        )
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, item_id, coverage (share of the item's words), slots and changed slots of each contaminated pair."""
    grams = stored(benchmark_windows(benchmark, window), "decontam-grams")
    hits = stored(alignments(docs, grams, cover), "decontam-hits")
    totals = hits.groupBy(*KEY).agg(F.max("n_plain").alias("n_plain"), F.max("n_item").alias("n_item"))
    cells = stored(_cells(hits), "decontam-cells")
    judged = _contradictions(cells).join(totals, KEY)
    steady = (F.col("n_odd") * 10 <= F.col("n_slots")) | ((F.col("n_odd_names") * 10 <= F.col("n_slots")) & (F.col("n_agree") * 10 >= F.col("n_plain") * 9))
    clean = stored(judged.where((F.col("n_words") >= F.least(F.lit(min_words), F.col("n_words") + F.col("n_slots"))) & steady), "decontam-clean")
    sound = stored(cells.join(clean.select(*KEY, "n_item"), KEY), "decontam-sound")
    pair, of = ["doc_id", "item_id"], ["doc_id", "item_id", "form"]
    share = F.sum("size") / F.first("n_item")
    covered = sound.groupBy(*of, "at").agg(F.max("size").alias("size"), F.max("n_item").alias("n_item")).groupBy(*of).agg(share.alias("share"))
    covered = covered.groupBy(*pair).agg(F.max("share").alias("coverage"), F.max(F.when(F.col("form") == TEMPLATE, F.col("share"))).alias("by_template"), F.max(F.when(F.col("form") == COPY, F.col("share"))).alias("by_copy"))
    island = F.col("at") - F.row_number().over(Window.partitionBy(*KEY).orderBy("at"))
    runs = sound.where(F.col("form") == TEMPLATE).withColumn("island", island).groupBy(*KEY, "island").agg(F.count("*").alias("n"), F.sum(F.col("plain").cast("int")).alias("n_plain"))
    long_run = runs.where((F.col("n") >= RUN) & (F.col("n_plain") * 2 >= F.col("n"))).select(*pair).distinct().withColumn("long_run", F.lit(True))
    slots = clean.groupBy(*pair).agg(F.max("n_slots").alias("n_slots"), F.min(F.when(F.col("form") == TEMPLATE, F.col("n_changed"))).alias("n_changed"))
    found = covered.join(slots, pair).join(long_run, pair, "left").where((F.col("by_template") >= cover) | (F.col("by_copy") >= VERBATIM) | F.col("long_run"))
    return found.select(*pair, F.least("coverage", F.lit(1.0)).alias("coverage"), "n_slots", F.coalesce("n_changed", F.lit(0)).cast("long").alias("n_changed"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark)
