"""Operator 8 against its definition on plain lists, and the cases that its slots are for."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from tapeloom.llm import decontam as D
from tests.llm.test_llm import EDGES, QUESTION, docs, leaks, words

STOP = re.compile(r"[.!?:][\"')\]»”]*$")
NUMBER = re.compile(r"[+-]?[$€£]?\d+([.,:/]\d+)*%?([^\W\d_]*)")


def plain_kinds(text):
    """(kind, lower-cased word, capital) of each word."""
    units, after = set(D.UNITS.split()), set(D.UNITS_AFTER_NUMBER.split())
    out = []
    for line in (text or "").split("\n"):
        first = True
        for w in re.findall(r"[^\x20\x09-\x0D]+", line):
            core = re.sub(r"^\W+|\W+$", "", w)
            low = core.lower()
            m = NUMBER.fullmatch(low)
            capital = len(core) > 1 and core[0].isupper() and not core.isupper()
            if m and (not m[2] or m[2] in units | after):
                kind = "number"
            elif low in units or "/" in low and all(p in units | after for p in low.split("/")):
                kind = "unit"
            else:
                kind = "name" if capital and not first else "after" if low in after else "word"
            if core:
                out.append((kind, low, capital))
            first = bool(STOP.search(w))
    return out


def plain_tokens(kinds):
    """(kind, filling, first word, number of words) of each token."""
    k = [x for x, _, _ in kinds]
    for i, x in enumerate(k):
        if x == "after":
            k[i] = "unit" if i and kinds[i - 1][0] == "number" else "word"
    for i in [i for i in range(1, len(k) - 1) if kinds[i][1] == "per" and k[i - 1] == "unit" and k[i + 1] == "unit"]:
        k[i] = "unit"
    out = []
    for i, x in enumerate(k):
        if i and x != "word" and (x == k[i - 1] or (x == "unit" and k[i - 1] == "number")):
            kind, fill, at, n = out[-1]
            out[-1] = (kind, (*fill, kinds[i][1]), at, n + 1)
        else:
            out.append((x, (kinds[i][1],), i, 1))
    return out


def plain_leaks(texts, bench):
    """{(doc, item)} by comparing all windows of all documents and items."""
    found = set()
    for (d, text), (item, question) in itertools.product(texts, bench):
        if d is None or item is None:
            continue
        kinds, qk = plain_kinds(text), plain_kinds(question)
        doc, q = plain_tokens(kinds), plain_tokens(qk)
        if not q:
            continue
        size = D.window_of(len(q))
        typed = lambda w: [(t[0], t[1] if t[0] == "word" else None) for t in w]
        counts = lambda w: all(t[0] == "word" for t in w) or sum(t[0] == "word" for t in w) >= min(len(w), D.PLAIN) > (len(w) == 1)
        same = lambda a, b, typed_: typed(a) == typed(b) and counts(a) if typed_ else [t[1] for t in a] == [t[1] for t in b]
        cells = defaultdict(lambda: defaultdict(list))  # shift -> token of the item -> (kind, plain, filling, document's filling, words)
        variants = [(q, 0, len(q))]
        if qk[0][0] == "word" and qk[0][2]:
            inside = plain_tokens([("name", *qk[0][1:]), *qk[1:]])
            variants.append((inside, len(q) - len(inside), 1))
        for v, (tokens, at, most) in enumerate(variants):
            n = min(size, len(tokens))
            for p in range(min(most, len(tokens) - n + 1)):
                for r in range(len(doc) - n + 1):
                    for typed_ in (True, False)[: 1 if v else 2]:
                        if same(doc[r : r + n], tokens[p : p + n], typed_):
                            for j in range(n):
                                kind = tokens[p + j][0] if typed_ else "word"
                                cells[r - p - at][p + at + j].append((kind, kind == "word", tokens[p + j][1], doc[r + j][1], tokens[p + j][3]))
        covered, long_run = {}, False
        n_plain = sum(t[0] == "word" for t in q)
        for of in cells.values():
            got = {at: (max(c, key=lambda x: ["word", "number", "name", "unit"].index(x[0]))[0], any(x[1] for x in c), c[0][2], c[0][3], max(x[4] for x in c)) for at, c in of.items()}
            to, back = defaultdict(set), defaultdict(set)
            for kind, _, a, b, _ in got.values():
                to[kind, a].add(b)
                back[kind, b].add(a)
            slots = [c for c in got.values() if c[0] != "word"]
            odd = [c for c in slots if len(to[c[0], c[2]]) > 1 or (c[0] == "name" and len(back[c[0], c[3]]) > 1)]
            n_words = sum(c[1] for c in got.values())
            agree = sum(c[0] == "word" for c in got.values())
            steady = len(odd) * 10 <= len(slots) or (sum(c[0] == "name" for c in odd) * 10 <= len(slots) and agree * 10 >= n_plain * 9)
            if n_words < min(D.MIN_WORDS, n_words + len(slots)) or not steady:
                continue
            covered |= {at: max(c[4], covered.get(at, 0)) for at, c in got.items()}
            for _, run in itertools.groupby(enumerate(sorted(got)), lambda e: e[1] - e[0]):
                run = [at for _, at in run]
                long_run |= len(run) >= D.RUN and sum(got[at][1] for at in run) * 2 >= len(run)
        n = D.window_of(len(qk))
        a, b, copied, shifts = [w for _, w, _ in kinds], [w for _, w, _ in qk], set(), defaultdict(set)
        for r in range(len(a) - n + 1):
            for p in range(len(b) - n + 1):
                if a[r : r + n] == b[p : p + n]:
                    shifts[r - p] |= set(range(p, p + n))
        for c in shifts.values():
            if len(c) >= min(D.MIN_WORDS, len(c)):
                copied |= c
        if sum(covered.values()) >= D.COVER * len(qk) or long_run or len(copied) >= D.VERBATIM * len(qk):
            found.add((d, item))
    return found


def test_slots_of_several_words():
    c = D.WordCache(D._packed)
    shape = lambda s: [(int(k), int(n)) for k, n in zip(D.template(s.encode(), c).kind, D.template(s.encode(), c).size)]
    w, number, name, unit = D.WORD, D.NUMBER, D.NAME, D.UNIT
    assert shape("so Mary Ann ran 1 200 m") == [(w, 1), (name, 2), (w, 1), (number, 3)]
    assert shape("at 3 km per hour or 5mph then in km per h") == [(w, 1), (number, 4), (w, 1), (number, 1), (w, 1), (w, 1), (unit, 1), (w, 1), (w, 1)]
    assert shape("m in h") == [(w, 1)] * 3 and shape("") == [] and shape("... --") == []


def test_slots_stand_for_longer_and_shorter_fillings(spark):
    item = "Yesterday Bob walked 7 km from the old mill to the harbour at 4 mph and then gave Mary Ann half of his 30 apples for the long way home"
    new = "Yesterday Mary Ann walked 1 200 m from the old mill to the harbour at 3 km per hour and then gave Bob half of his 5 apples for the long way home"
    odd = new.replace("gave Bob", "gave Mary Ann")
    texts = [(1, f"{words(20)} so {new}"), (2, f"{words(20)} so {odd}"), (3, words(200))]
    assert leaks(spark, texts, [item]) == {(1, 0), (2, 0)}  # 2 has 13 tokens in a row word for word
    assert leaks(spark, [(1, item.replace("7 km", "8 m").upper()), (2, item.lower())], [item]) >= {(2, 0)}


def test_numbers_alone_make_no_hits(spark):
    """A text of numbers against items of numbers: windows without plain words are not joined."""
    bench = [" ".join(str(k * 31 + j) for j in range(12)) + " apples and pears are left in the basket" for k in range(20)]
    table = " ".join(str(1000 + k) for k in range(4000))
    b = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    grams = D.benchmark_windows(b).persist()
    assert D.alignments(docs(spark, [(1, table), (2, table.replace(" ", "\n"))]), grams).count() == 0
    got = leaks(spark, [(1, table), (2, f"{words(9)} {bench[3]}")], bench)
    assert {i for _, i in got if _ == 2} >= {3} and all(d == 2 for d, _ in got)


def test_many_copies_in_one_text(spark):
    text = "\n".join([QUESTION] * 500)
    assert leaks(spark, [(1, text), (2, text), (3, words(400))]) == {(1, 0), (2, 0)}


@pytest.mark.parametrize("shared", [1, 3, 32])
def test_templates_against_all_windows(spark, monkeypatch, shared):
    """Whatever counts as common, the same pairs are found: items share verbs, instructions and whole halves."""
    monkeypatch.setattr(D, "SHARED", shared)
    rng = random.Random(12)
    names, units, verbs = ["Ann", "Bob", "Mary Ann", "Li Wei", "Zoé"], ["km", "kg", "dollars", "km per hour"], ["buys", "sells", "finds", "takes", "throws"]

    def question(k):
        r = random.Random(k)
        verb = [r.choice(verbs) for _ in range(4)]
        noun = [words(1, seed=50 + r.randrange(30)) for _ in range(9)]
        return lambda a, b, x, y, u: f"{noun[0]} and {a} {verb[0]} {x} {u} of {noun[1]} then {b} {verb[1]} {noun[2]} {noun[3]} {verb[2]} {y} {u} while {a} {verb[3]} the {noun[4]} {noun[5]} near {noun[6]}"

    made = [question(k) for k in range(8)]
    bench = [q("Ann", "Bob", 3, 12, "kg") for q in made] + ["Maria sells 7 hats", "Paris is large", "", None, "12 15 18 21", words(25, seed=4)]
    told = words(9, seed=77)
    bench += [f"{told} {q.split(' of ')[0]}" for q in bench[:4]] + [f"{words(12, seed=k)} {told}" for k in range(4)] + [f"{words(30, seed=79)} {words(6, seed=k)}" for k in range(3)] + [told, f"{told} ?"]
    texts = [*EDGES[:6], *EDGES[8:]]
    for k in range(60):
        q = made[k % 8](*(rng.choice(names) for _ in range(2)), rng.randrange(90), rng.choice(["1 200", 5, "7.5"]), rng.choice(units))
        part = q.split()
        if k % 4 == 1:
            part[rng.randrange(len(part))] = "edited"
        if k % 4 == 2:
            part = part[: len(part) * rng.randrange(3, 9) // 10]
        q = " ".join(part)
        texts.append((100 + k, f"{words(6, seed=k)} {q.lower() if k % 7 == 0 else q}. {words(6, seed=k + 1)}"))
    texts += [(300, "so Olga sells 9 hats"), (301, "12 15 18 21"), (302, "paris is large"), (303, "PARIS\nis large too")]
    texts += [(400 + k, f"{words(5, seed=k)} {told} {words(12, seed=k % 4)} {told if k % 2 else ''}") for k in range(6)] + [(410, words(30, seed=79)), (411, f"{told} {words(4, seed=2)}"), (412, words(30, seed=79)[:60])]
    want = plain_leaks(texts, list(enumerate(bench)))
    assert leaks(spark, texts, bench) == want and 30 < len(want) and {d for d, _ in want} != {d for d, _ in texts}
    assert Counter(i for _, i in want)


def test_an_instruction_that_all_items_share_makes_no_product(spark):
    """Ten thousand items and ten thousand documents with one instruction: what is joined goes with the documents, not with items times documents."""
    told = "answer the following question and give your reasons briefly"
    bench = [f"{told} {words(14, seed=k)}" for k in range(10_000)]
    texts = [(k, f"{words(4, seed=k)} {told} {words(6, seed=50_000 + k)}") for k in range(10_000)] + [(20_000 + k, f"so {bench[k]} {words(3)}") for k in range(0, 10_000, 500)]
    b = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    d = docs(spark, texts)
    grams = D.stored(D.benchmark_windows(b), "test-grams")
    hits = D.alignments(d, grams)
    assert hits.count() <= D.SHARED * d.count()  # the product would be over 100 million
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(d, b).collect()} == {(20_000 + k, k) for k in range(0, 10_000, 500)}
