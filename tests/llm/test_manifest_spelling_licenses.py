"""Operators 11 to 13: edge cases, plain versions, and the SQL on the given tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import licenses, manifest, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = {"h": 1, "k": "k", "n": None, "g": 2, "row": 3, "word": "x", "leaf": "y", "hits": 5, "t": 7, "run": "z", "id": 9, "digest": "d"}


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df):
    return df.select("*", *(F.lit(v).alias(k) for k, v in CLASHING.items()))


def bag(df, *columns):
    return Counter(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def against_sql(spark, small, module):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.sql(module.ORACLE_SQL)
    got = module.query(spark, small)
    assert sorted(got.columns) == sorted(want.columns)
    assert bag(got, *want.columns) == Counter(want.fetchall())


@pytest.mark.parametrize("module", [licenses, spelling, manifest], ids=lambda m: m.__name__.rsplit(".", 1)[-1])
def test_queries_equal_their_sql(spark, small, module):
    against_sql(spark, small, module)


# -- manifest -----------------------------------------------------------------------------------------------------
def H(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    cells = [row[0], row[3], row[2], row[4], text]
    return H("".join("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells))


def plain_levels(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def plain_path(levels, k, fanout):
    """(what stands left, what stands right) of a leaf and of the nodes above it."""
    out = []
    for level in levels[:-1]:
        lo = k - k % fanout
        out.append(("".join(level[lo:k]), "".join(level[k + 1 : lo + fanout])))
        k //= fanout
    return out


def plain_verify(rows, fanout=16):
    lower = str.maketrans(manifest.UPPER, manifest.LOWER)
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    order = lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[1]))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_levels([plain_leaf(r, r[1]) for r in sorted(by_source[s], key=order)], fanout) for s in sources}
    top = plain_levels([trees[s][-1][0] for s in sources], fanout)
    root, out = top[-1][0], []
    for i, s in enumerate(sources):
        for k, r in enumerate(sorted(by_source[s], key=order)):
            path = plain_path(trees[s], k, fanout) + plain_path(top, i, fanout)
            hit = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            value = plain_leaf(r, r[1].translate(lower) if hit else r[1])
            for a, b in path:
                value = H(a + value + b)
            out.append((r[0], trees[s][0][k], trees[s][-1][0], root, H("".join(a + b for a, b in path)), value, value == root))
    return Counter(out)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def some_rows(n, seed=3):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        source = draw.choice([None, "", "hot", "hot", "hot", "Ä", "z", f"one{i}"])
        text = draw.choice([None, "", "lower only", f"Text {i} ÄÖ", "Same text", "x" * draw.choice([1, 40_000])])
        rows.append((draw.choice([None, draw.randrange(n), -draw.randrange(9)]), text, draw.choice([None, "en"]), source, draw.choice([None, len(text or "")])))
    return rows + rows[: n // 5]


def test_manifest_equals_a_plain_version(spark):
    rows = some_rows(900)
    got = manifest.verify(with_clashes(table(spark, rows).repartition(7)))
    want = plain_verify(rows)
    assert got.columns == NAMES and bag(got) == want
    assert 0 < sum(n for r, n in want.items() if not r[-1]) < 200


@pytest.mark.parametrize("rows", [[], [(1, "One", "en", "s", 3)], [(1, "a", "en", None, 1)] * 17, [(i, "A", "en", "s", 1) for i in range(257)]], ids=["empty", "one", "copies", "three levels"])
def test_manifest_of_small_tables(spark, rows):
    got = manifest.verify(table(spark, rows))
    assert got.columns == NAMES and bag(got) == (plain_verify(rows) if rows else Counter())


@pytest.mark.parametrize("fanout", [2, 3])
def test_stacks_of_any_cut_merge_to_one_tree(spark, fanout):
    """A tree's nodes do not depend on how its leaves are dealt to partitions."""
    n = 61
    leaves = [H(str(i)) for i in range(n)]
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate(leaves)] + [("b", i, x) for i, x in enumerate(leaves[:1])], "g string, i int, leaf string")
    tree = manifest.grow(rows, ["i"], "merkle-test", fanout)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    levels = plain_levels(leaves, fanout)
    want = {(level, k): d for level, nodes in enumerate(levels) for k, d in enumerate(nodes) if level}
    got = [(r["level"], r["k"], r["digest"]) for r in tree.nodes.collect()]
    assert {(a, b): d for a, b, d in got} == want and len(got) == len(want)
    assert {r["g"]: r["digest"] for r in tree.roots.collect()} == {"a": levels[-1][0], "b": leaves[0]}


def test_a_partition_keeps_few_peaks():
    out, n = [], 16**4 + 77
    peaks = manifest.Mountains("g", n, out)
    for k in range(1000, 40_000):
        peaks.push(k, str(k))
    peaks.end()
    assert sum(not r[0] for r in out) <= 2 * 16 * 5
    assert sum(r[0] and r[2] == 1 for r in out) == len(range(1008 // 16, 40_000 // 16))


def test_manifest_fanout_is_checked(spark):
    with pytest.raises(ValueError):
        manifest.grow(spark.createDataFrame([], "g string, leaf string"), [], "merkle-test", 1)


# -- spelling -----------------------------------------------------------------------------------------------------
def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, shortest=7, least=2, factor=10):
    count = Counter()
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= shortest
    count = {w: n for w, n in count.items() if n >= least}
    form, near_n = {}, {}
    for w, n in count.items():
        near = [x for x in count if apart_by_one(w, x)]
        near_n[w] = len(near)
        best = min(near, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= factor * n else None
    out = []
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near_n[w], count[form[w]] if form[w] else None))
    return Counter(out)


def spelled_rows(seed=5):
    draw = random.Random(seed)
    words = ["continent", "aaaaaaaa", "séparément", "Straßenbahn", "ÀÉÎÕÜßÿ", "xyzxyzxyz"]
    rows = [(None, None, None, None, None), (1, "", None, None, None), (1, "short words here", None, None, None)]
    for i in range(300):
        picked = []
        for _ in range(12):
            w = words[min(int(draw.expovariate(0.7)), 5)]
            for _ in range(draw.choice([0, 0, 0, 0, 1, 1, 2])):
                p = draw.randrange(len(w))
                w = draw.choice([w[:p] + w[p + 1 :], w[:p] + draw.choice("aéÿz") + w[p:], w[:p] + draw.choice("aéÿz") + w[p + 1 :]])
            picked.append(w)
        rows.append((draw.choice([None, i, i % 40]), draw.choice([" ", "-", "1", "\n", "œ"]).join(picked), "en", "s", 1))
    rows.append((9, "Long" * 30_000 + " " + "Long" * 30_000, "en", "s", 1))
    return rows + rows[:50]


@pytest.mark.parametrize("most_words,most", [(100_000, 1 << 26), (40, 3000)], ids=["one shard", "many rounds"])
def test_spelling_equals_a_plain_version(spark, most_words, most):
    rows = spelled_rows()
    got = spelling.variants(with_clashes(table(spark, rows)), most_words=most_words, most=most)
    want = plain_variants(rows)
    assert bag(got) == want
    assert any(r[1] != r[2] and r[1] for r in want) and max(len(r[0]) for r in want) > 100_000


def test_spelling_of_nothing(spark):
    assert spelling.variants(table(spark, [])).count() == 0
    assert spelling.variants(table(spark, [(1, None, None, None, None), (2, "a b c", None, None, None)])).count() == 0


def test_trie_finds_each_neighbour_once():
    draw = random.Random(2)
    items = sorted({"".join(draw.choice("aabàÿ") for _ in range(draw.randint(1, 6))) for _ in range(700)})
    trie = spelling.Trie.of(items)
    word, near = trie.neighbours(spelling.Codes(items))
    assert Counter(zip(word.tolist(), near.tolist())) == Counter((i, j) for i, a in enumerate(items) for j, b in enumerate(items) if apart_by_one(a, b))


def test_shards_have_their_bound(spark):
    counted = spark.createDataFrame([(f"word{'abc'[i % 3] * (i // 3 + 1)}", 2) for i in range(90)], "word string, n long")
    rows = spelling.shards(counted.coalesce(1), most_words=7, most_letters=100).collect()
    words = [r["words"].split("\n") for r in rows]
    assert sum(map(len, words)) == 90
    assert all(len(w) <= 7 and (sum(map(len, w)) <= 100 or len(w) == 1) for w in words)


# -- licenses -----------------------------------------------------------------------------------------------------
def plain_places(words, phrase):
    phrase = phrase.split()
    return [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]


def plain_words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))


TEXTS = [
    None,
    "",
    "CC BY NC",
    "cc-by-nc cc by nc cc by-nc 4.0",
    "cc by-nd nc",
    "Released under the MIT License. Under the mit license\nunder THE mit_license under the mitlicense",
    "under the mit license",
    "Licensed under the Apache License, Version 2.0 and the apache license version 2",
    "under the under the mit license mit license",
    "The work is under the GNU General Public License, version 3.",
    " ".join(["under the mit license"] * 500),
    "ünder the mit license 中文 under the mit license\U0001f600 under the mit license",
]


def test_base_places_equal_a_plain_count(spark):
    draw = random.Random(4)
    long = " ".join(draw.choice(["cc", "by", "nc", "under", "the", "mit", "license", "apache", "version", "2"]) for _ in range(40_000))
    texts = [*TEXTS, *TEXTS[:4], long]
    rows = [(draw.choice([None, 3, i]), t, None, None, None) for i, t in enumerate(texts)]
    want = Counter()
    for r in rows:
        words = plain_words(r[1])
        places = {name: plain_places(words, phrase) for name, phrase in licenses.BASE}
        every = sorted(p for x in places.values() for p in x)
        want[r[0], len(words), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(k for k, v in places.items() if v))] += 1
    got = licenses.scan(with_clashes(table(spark, rows)))
    assert bag(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    assert max(r[2] for r in want) > 100


def test_wordings_are_found_with_edits_and_not_in_parts(spark):
    wording = {name: text for name, text in licenses.WORDINGS if len(text) > 100}
    words = wording["mit"].split()
    edited = " ".join([*words[:20], "or", "thing", *words[20:50], *words[52:80], "changed", *words[81:]])
    half = " ".join(words[: len(words) // 2])
    shuffled = " ".join(words[40:] + words[:40])
    rows = [(1, f"Head {wording['mit']} tail", None, None, None), (2, edited, None, None, None), (3, half, None, None, None), (4, shuffled, None, None, None)]
    rows += [(5, f"{wording['isc']} {wording['bsd']}", None, None, None), (6, " ".join(reversed(words)), None, None, None)]
    got = {r["doc_id"]: r for r in licenses.scan(table(spark, rows)).collect()}
    assert got[1]["labels"] == "mit" and got[1]["score"] == 1.0 and got[1]["n_base"] == 0
    assert got[2]["labels"] == "mit" and 0.8 <= got[2]["score"] < 1.0
    assert got[3]["labels"] == "" and 0.4 < got[3]["score"] < 0.6
    assert got[4]["labels"] == "" and got[6]["labels"] == "" and got[6]["score"] == 0.0
    assert got[5]["labels"] == "bsd,isc"


def test_licenses_of_nothing(spark):
    assert licenses.scan(table(spark, [])).count() == 0
    got = licenses.scan(table(spark, [(None, None, None, None, None), (2, " .,", None, None, None)])).collect()
    assert sorted((r["n_words"], r["labels"], r["score"]) for r in got) == [(0, "", 0.0)] * 2


def test_words_do_not_depend_on_where_texts_are_cut(monkeypatch):
    text = "".join(random.Random(1).choice(["word ", "WORD", "é", "1", "中 ", ".", " "]) for _ in range(3000))
    low = licenses._LOWERED[np.frombuffer(text.encode(), np.uint8)]
    begins = np.array([0, len(low)])
    whole = licenses.words_of(low, begins)
    monkeypatch.setattr(licenses, "SLICE", 50)
    cut = licenses._pieces(low, begins)
    assert all((a == b).all() for a, b in zip(whole, cut))
    assert [low[a:b].tobytes().decode() for a, b in zip(cut[1], cut[2])] == plain_words(text)


def test_templates_have_their_bound(spark, monkeypatch):
    monkeypatch.setattr(licenses, "MAX_WORDS", 3)
    with pytest.raises(ValueError):
        licenses.template_grams(spark, licenses.BASE)
    with pytest.raises(ValueError):
        licenses.scan(table(spark, []), [("x", "two words")])
