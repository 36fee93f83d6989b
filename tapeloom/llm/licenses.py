"""Operator 11: license scans by diagonal voting.

Words are rolled over every whole text: each K words in a row have a hash. These are joined with the places of the same hashes in
the license templates, and a match votes for its diagonal, the text's place less the template's. Words that stand as in the
template vote for one diagonal; where words were put in or left out the votes go on at a neighbouring one, so diagonals within
DRIFT words of each other are merged. A span is verified: its grams are equal as text, not only by hash; the template's words that they
cover are counted, and the span holds where that is SHARE of the template or more in not more than STRETCH times its length.
A template shorter than LONG words must stand whole, on one diagonal. A base phrase's places are its full diagonals.

Tasks send only the grams whose hash is one of the templates' (the others cannot join); templates have MAX_WORDS words at most, so
their table is broadcast. Votes are summed by (row, template, diagonal) before anything is ordered; texts without a match are not shuffled.

Defined results: a null text is an empty one, without words; null and repeated doc_ids are rows of their own; a place is counted
in every phrase that it belongs to; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tapeloom.llm.common import stored, text_bytes

K, DRIFT, SHARE, STRETCH, LONG, LEAST_VOTES = 3, 8, 0.8, 1.5, 12, 2
MAX_WORDS = 100_000
SLICE = 4 << 20  # bytes of text that are looked at together
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases of the base labels, and wordings of well-known licenses.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
WORDINGS = (
    ("agpl-3", "GNU Affero General Public License, version 3"),
    ("cc-by", "Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc0", "CC0 1.0 Universal"),
    ("gpl-2", "GNU General Public License, version 2"),
    ("gpl-3", "GNU General Public License, version 3"),
    ("lgpl", "GNU Lesser General Public License"),
    ("mpl-2", "Mozilla Public License, version 2.0"),
    (
        "apache-2",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    (
        "bsd-3",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ),
)


def word_list(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


# -- rolling hashes -----------------------------------------------------------------------------------------------
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_B = 0x9E3779B97F4A7C15  # odd, so that powers have inverses
_B_INVERSE = pow(_B, -1, 1 << 64)


class Powers:
    """Powers of a number mod 2**64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.held = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.held) < n:
            steps = np.full(max(n, 1 << 16), self.base, np.uint64)
            steps[0] = 1
            self.held = np.multiply.accumulate(steps)
        return self.held[:n]


_UP, _DOWN = Powers(_B), Powers(_B_INVERSE)


def words_of(low: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of lowered UTF-8 bytes; no word goes over one of the places `begins`."""
    n = len(low)
    inside = np.zeros(n + 1, bool)
    inside[:n] = _IN_WORD[low]
    first, last = inside[:n].copy(), inside[:n] & ~inside[1:]
    first[1:] &= ~inside[: n - 1]
    cut = begins[(begins > 0) & (begins < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _UP.upto(n), out=upto[1:])
    return (upto[end] - upto[start]) * _DOWN.upto(n + 1)[start], start, end


def gram_hashes(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of the k words from each place on; the last k - 1 places have none."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ (words[j : j + n] >> np.uint64(29)) ^ words[j : j + n]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out


def _text_grams(text: str, k: int) -> np.ndarray:
    low = _LOWERED[np.frombuffer(text.encode(), np.uint8)]
    return gram_hashes(words_of(low, np.zeros(0, np.int64))[0], k)


def template_grams(spark: SparkSession, templates, k: int = K) -> DataFrame:
    """(h, gram, t, at): every k words of every template; MAX_WORDS rows at most."""
    rows = []
    for t, (_, text) in enumerate(templates):
        words, hashes = word_list(text), _text_grams(text, k)
        rows += [(int(h.view(np.int64)), " ".join(words[i : i + k]), t, i) for i, h in enumerate(hashes)]
    if len(rows) > MAX_WORDS:
        raise ValueError(f"templates have more than {MAX_WORDS} words")
    return spark.createDataFrame(rows, "h long, gram string, t int, at int")


_SEEN = "doc_id long, n_words long, hits array<struct<pos:int,h:long,gram:string>>"
_HIT = pa.list_(pa.struct([("pos", pa.int32()), ("h", pa.int64()), ("gram", pa.string())]))


def _scan(wanted: np.ndarray, k: int):
    """Words of each text, and its grams whose hash is among `wanted` (sorted)."""
    bitmap = np.zeros(1 << 16, bool)
    bitmap[(wanted >> np.uint64(48)).astype(np.int64)] = True

    def slices(offsets):
        lo = 0
        while lo < len(offsets) - 1:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
            yield lo, hi
            lo = hi

    def walk(batches):
        for batch in batches:
            texts = batch.column("body").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            counts, hits = [], []
            for lo, hi in slices(offsets):
                begins = offsets[lo : hi + 1] - offsets[lo]
                low = _LOWERED[data[offsets[lo] : offsets[hi]]]
                value, start, end = _pieces(low, begins)
                bounds = np.searchsorted(start, begins)
                counts.append(np.diff(bounds))
                grams = gram_hashes(value, k)
                maybe = np.nonzero(bitmap[(grams >> np.uint64(48)).astype(np.int64)])[0]
                at = maybe[np.isin(grams[maybe], wanted)]
                doc = np.searchsorted(bounds, at, "right") - 1
                whole = at + k <= bounds[doc + 1]
                at, doc = at[whole], doc[whole]
                own = [[] for _ in range(hi - lo)]
                for j, d in zip(at.tolist(), doc.tolist()):
                    gram = " ".join(low[start[j + i] : end[j + i]].tobytes().decode() for i in range(k))
                    own[d].append({"pos": j - int(bounds[d]), "h": int(grams[j].view(np.int64)), "gram": gram})
                hits += own
            n_words = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_words, pa.array(hits, _HIT)], ["doc_id", "n_words", "hits"])

    return walk


def _pieces(low: np.ndarray, begins: np.ndarray):
    """words_of, a long text cut where no word stands."""
    if len(low) <= 2 * SLICE:
        return words_of(low, begins)
    out, lo = [], 0
    while lo < len(low):
        hi = min(len(low), lo + SLICE)
        while hi < len(low) and _IN_WORD[low[hi]]:
            hi += 1
        value, start, end = words_of(low[lo:hi], begins - lo)
        out.append((value, start + lo, end + lo))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out))


# -- votes --------------------------------------------------------------------------------------------------------
def looked_at(docs: DataFrame, templates, k: int = K) -> DataFrame:
    """(row, doc_id, n_words, hits) of every row of docs."""
    wanted = np.unique(np.concatenate([_text_grams(text, k) for _, text in templates]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return stored(texts.mapInArrow(_scan(wanted, k), _SEEN).withColumn("row", F.monotonically_increasing_id()), "license-hits")


def diagonals(seen: DataFrame, templates, k: int = K) -> DataFrame:
    """(row, t, size, base, diagonal, votes, places): a template's places that stand on a diagonal of a text, and how many."""
    spark = seen.sparkSession
    each = seen.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    met = each.join(F.broadcast(template_grams(spark, templates, k)), ["h", "gram"])
    votes = met.groupBy("row", "t", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"), F.collect_list("at").alias("places"))
    sizes = spark.createDataFrame([(t, len(word_list(text)), t < len(BASE)) for t, (_, text) in enumerate(templates)], "t int, size int, base boolean")
    return votes.join(F.broadcast(sizes), "t")


def spans(votes: DataFrame, k: int = K, drift: int = DRIFT) -> DataFrame:
    """(row, t, base, start, share, holds): neighbouring diagonals merged, with the share of the template's words that they cover."""
    full = F.col("votes") == F.col("size") - k + 1
    strong = votes.where(F.when(F.col("size") < LONG, full).otherwise(F.col("votes") >= LEAST_VOTES))
    by = Window.partitionBy("row", "t").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > F.when(F.col("size") < LONG, 0).otherwise(drift), F.lit(True))
    numbered = strong.withColumn("apart", apart).withColumn("span", F.count_if("apart").over(by))
    lo, hi = F.min(F.col("diagonal") + F.array_min("places")), F.max(F.col("diagonal") + F.array_max("places") + k)
    covered = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("places")), lambda p: F.sequence(p, p + (k - 1)))))
    found = numbered.groupBy("row", "t", "size", "base", "span").agg(lo.alias("start"), hi.alias("stop"), F.size(covered).alias("words"))
    share = F.col("words") / F.col("size")
    holds = (share >= SHARE) & (F.col("stop") - F.col("start") <= STRETCH * F.col("size"))
    return found.select("row", "t", "base", F.col("start").cast("long").alias("start"), share.alias("share"), holds.alias("holds"))


def scan(docs: DataFrame, more=WORDINGS, k: int = K) -> DataFrame:
    """A row a document: doc_id, n_words, the base phrases' places (n_base, first_word, last_word), base_labels, labels and score.

    `more` are (label, wording) beside the base phrases; a wording has k words at least.
    """
    templates = [*BASE, *more]
    if any(len(word_list(text)) < k for _, text in templates):
        raise ValueError(f"a wording has {k} words at least")
    seen = looked_at(docs, templates, k)
    names = F.array(*(F.lit(name) for name, _ in templates))
    label = F.when(F.col("holds"), F.element_at(names, F.col("t") + 1))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = F.col("base") & F.col("holds")
    place = F.when(base, F.col("start"))
    found = spans(diagonals(seen, templates, k), k).groupBy("row").agg(
        F.count_if(base).alias("n_base"),
        F.min(place).alias("first_word"),
        F.max(place).alias("last_word"),
        joined(F.when(base, label)).alias("base_labels"),
        joined(label).alias("labels"),
        F.max("share").alias("score"),
    )
    rest = seen.where(F.size("hits") == 0).select("doc_id", "n_words")
    met = seen.where(F.size("hits") > 0).select("row", "doc_id", "n_words").join(found, "row", "left").drop("row")
    whole = met.unionByName(rest, allowMissingColumns=True)
    return whole.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle(k: int = K) -> str:
    templates, rows, sizes = [*BASE, *WORDINGS], [], []
    for t, (name, text) in enumerate(templates):
        words = word_list(text)
        rows += [f"('{' '.join(words[i : i + k])}', {t}, {i})" for i in range(len(words) - k + 1)]
        sizes.append(f"({t}, '{name}', {len(words)}, {'true' if t < len(BASE) else 'false'})")
    place = "CASE WHEN base AND holds THEN start END"
    return f"""
WITH grams(gram, t, nth) AS (VALUES {', '.join(rows)}),
templates(t, label, size, base) AS (VALUES {', '.join(sizes)}),
docs AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') ws FROM documents),
rolled AS (SELECT r, pos, ws[pos + 1] || ' ' || ws[pos + 2] || ' ' || ws[pos + 3] gram FROM (SELECT r, ws, unnest(range(len(ws) - {k - 1})) pos FROM docs)),
votes AS (SELECT r, t, pos - nth diagonal, count(*) votes, list(nth) places, min(nth) lo, max(nth) hi FROM rolled JOIN grams USING (gram) GROUP BY ALL),
strong AS (SELECT * FROM votes JOIN templates USING (t) WHERE CASE WHEN size < {LONG} THEN votes = size - {k - 1} ELSE votes >= {LEAST_VOTES} END),
parted AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, t ORDER BY diagonal) > CASE WHEN size < {LONG} THEN 0 ELSE {DRIFT} END, true) apart FROM strong),
numbered AS (SELECT *, count_if(apart) OVER (PARTITION BY r, t ORDER BY diagonal) span FROM parted),
places AS (SELECT r, t, span, count(DISTINCT p + d) words FROM (SELECT r, t, span, unnest(places) p FROM numbered), (SELECT unnest(range({k})) d) GROUP BY ALL),
merged AS (SELECT r, t, label, size, base, span, min(diagonal + lo) start, max(diagonal + hi + {k}) stop FROM numbered GROUP BY ALL),
spans AS (SELECT *, words / size share, words / size >= {SHARE} AND stop - start <= {STRETCH} * size holds FROM merged JOIN places USING (r, t, span)),
found AS (SELECT r, count_if(base AND holds) n_base, min({place}) first_word, max({place}) last_word,
    string_agg(DISTINCT CASE WHEN base AND holds THEN label END, ',' ORDER BY CASE WHEN base AND holds THEN label END) base_labels,
    string_agg(DISTINCT CASE WHEN holds THEN label END, ',' ORDER BY CASE WHEN holds THEN label END) labels, max(share) score FROM spans GROUP BY r)
SELECT doc_id, len(ws) n_words, CAST(coalesce(n_base, 0) AS BIGINT) n_base, CAST(first_word AS BIGINT) first_word, CAST(last_word AS BIGINT) last_word,
    coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0.0::DOUBLE) score FROM docs LEFT JOIN found USING (r)
"""


ORACLE_SQL = _oracle()
