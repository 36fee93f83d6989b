"""Operator 7 against plain versions, and its chains on planted keys."""

import base64
import math
import random
import re
import string
import time
import uuid
from collections import Counter

import pytest

from tapeloom.llm import secrets
from tests.llm.test_llm import docs

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", re.I)


def plain_spans(text):
    """(start, kind, stop) of the known kinds, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def plain_runs(text):
    base = plain_spans(text)
    runs = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text)]
    return [r for r in runs if not any(a < r[1] and r[0] < b for a, _, b in base)]


def wild(draw, n):
    parts = ["password: ", "token=secret=", "API_KEY = '", "api-key:", "AKIA", "deadbeef", "0123456789abcdef", "A1" * 9, "word", " ", "\n", "é", "中\U0001f600", "-", "=", "passwd:passwd:", "x" * 17, "Zq9+/" * 4, ".", "f" * 15, "'"]
    return "".join(draw.choice(parts) for _ in range(n))


def test_spans_and_runs_equal_a_plain_scan(spark):
    draw = random.Random(4)
    texts = ["", "token", *(wild(draw, draw.randrange(1, 60)) for _ in range(250)), wild(draw, 3000), wild(draw, 9000)]
    got = secrets.pattern_spans(docs(spark, list(enumerate(texts)))).collect()
    found = 0
    for r in got:
        text = texts[r["doc_id"]]
        assert [(s["start"], s["kind"], s["stop"]) for s in r["base"]] == plain_spans(text)
        assert [(s["start"], s["stop"]) for s in r["runs"]] == plain_runs(text)
        found += len(r["base"]) + len(r["runs"])
    assert found > 3000


def test_many_finds_in_one_text_take_linear_time(spark):
    def seconds(n):
        text = " ".join(f"token = abcdefgh{k:06d} and {k:016x} or Qw9{'zX7' * 5}{k}" for k in range(n))
        df = secrets.pattern_spans(docs(spark, [(1, text)])).selectExpr("size(base) + size(runs) AS n")
        began = time.time()
        assert df.first()["n"] == 3 * n
        return time.time() - began

    seconds(10)
    assert seconds(16_000) < 15  # a few seconds; a fold that copies took a minute


def keys(draw, n):
    """Keys without a keyword or prefix that a pattern knows."""
    some = {
        "mixed": lambda: "".join(draw.choice(string.ascii_letters + string.digits) for _ in range(draw.randrange(20, 41))),
        "base64": lambda: base64.b64encode(draw.randbytes(draw.randrange(15, 33))).decode(),
        "uuid": lambda: str(uuid.UUID(int=draw.getrandbits(128))),
        "lower": lambda: "".join(draw.choice(string.ascii_lowercase + string.digits) for _ in range(draw.randrange(20, 41))),
        "upper": lambda: "".join(draw.choice(string.ascii_uppercase + string.digits) for _ in range(draw.randrange(20, 41))),
    }
    return [(kind, make()) for kind, make in some.items() for _ in range(n)]


IDENTIFIERS = [
    "internationalizationhelper", "getUserAccountSettings", "my_long_variable_name_here", "application/octet-stream", "content-security-policy", "AbstractSingletonProxyFactoryBean",
    "example/path-to-page", "commit-message-template", "donaudampfschifffahrtsgesellschaft", "session_timeout_seconds", "org_apache_spark_sql_DataFrame", "kubernetes-deployment-config",
    "user-profile-picture-large", "characteristically", "responsibilities-and-tasks", "unbelievably-long-hyphenated-word",
]


def test_chains_find_planted_keys_and_leave_identifiers(spark):
    """Keys planted in a thousand documents: recall by kind, and precision against identifiers and all other runs of the texts.

    When written: 60 of 60 mixed, base64, UUID-like and capital keys, 58 of 60 lower-case ones, and nothing else.
    """
    draw = random.Random(21)
    planted = keys(draw, 60)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows += [(100_000 + k, f"the value {v} was seen here") for k, (_, v) in enumerate(planted)]
    rows += [(200_000 + k, f"call {v} or see it") for k, v in enumerate(IDENTIFIERS)]
    got = {}
    for r in secrets.scan(docs(spark, rows)).collect():
        got[r["doc_id"]] = [(s["value"], s["kind"]) for s in r["spans"] if s["kind"] == 3]
    seen, hit = Counter(k for k, _ in planted), Counter()
    for k, (kind, v) in enumerate(planted):
        hit[kind] += any(x == v.rstrip() for x, _ in got[100_000 + k]) or len(plain_spans(f"the value {v} was")) > 0
    wrong = sum(len(v) for d, v in got.items() if d < 100_000 or d >= 200_000)
    assert all(hit[k] >= (0.9 if k == "lower" else 0.95) * seen[k] for k in seen), hit
    assert sum(hit.values()) / (sum(hit.values()) + wrong) >= 0.95, wrong


def test_the_ratio_equals_a_plain_sum(spark):
    """Of counts as given, with the uniform share, by hand."""
    sample = spark.createDataFrame([(True, "a1b2a1"), (True, "9a"), (False, "abab"), (False, "ba")], "random boolean, value string")
    table = secrets.ratios(sample)
    place = lambda c: secrets.ALPHABET.find(c) + 1
    size = len(secrets.ALPHABET) + 1
    pairs = {True: Counter(), False: Counter()}
    for random_, value in ((True, "a1b2a1"), (True, "9a"), (False, "abab"), (False, "ba")):
        for x, y in zip(" " + value, value):
            pairs[random_][x, y] += 1

    def p(random_, x, y):
        single = Counter()
        for (_, b), n in pairs[random_].items():
            single[b] += n
        share = (single[y] + secrets.SMOOTH) / (sum(single.values()) + secrets.SMOOTH * (size - 1))
        after = sum(n for (a, _), n in pairs[random_].items() if a == x)
        out = (pairs[random_][x, y] + secrets.PRIOR * share) / (after + secrets.PRIOR)
        return secrets.UNIFORM / (size - 1) + (1 - secrets.UNIFORM) * out if random_ else out

    for x, y in ((" ", "a"), ("a", "1"), ("a", "b"), ("1", "Z"), ("b", "a"), ("=", "/")):
        assert math.isclose(table[place(x), place(y)], math.log(p(True, x, y) / p(False, x, y)), abs_tol=1e-12)


@pytest.mark.parametrize("rows", [[(1, "x" * 40)], [(1, "0123456789abcdef")]], ids=["no random sample", "no identifiers"])
def test_without_a_class_nothing_is_added(spark, rows):
    (r,) = secrets.scan(docs(spark, rows)).collect()
    assert all(s["kind"] != 3 for s in r["spans"])
