"""Operator 7: secret scans. Patterns of known kinds, and character Markov models. DataFrame functions only.

Known kinds are found by patterns, leftmost and not overlapping a kind. Beside them, every run of RUN characters or more of
the base64 and identifier alphabets that touches no such find is a candidate. Two first-order Markov chains over
characters, one of random strings and one of ordinary identifiers, are compared by their log-likelihood ratio; candidates of
THRESHOLD nats or more, MEAN or more a character, are reported as kind `markov`.

The chains are trained on labelled samples from all documents: what the patterns find (the value, not the keyword) is
random; candidates without a digit are ordinary identifiers. What the patterns find is mostly hexadecimal, so UNIFORM of the random chain is even
over the alphabet. THRESHOLD and MEAN were chosen on planted keys and identifiers (tests/llm/test_secrets.py). Counts of character pairs are aggregated where they are made, so
the only table that leaves the executors is the ratio table: at most 66 x 66 numbers, whatever the input.

Offsets are code points, ends excluded. Defined results: a null text is an empty one and has no spans; a null doc_id is
kept; repeated rows give repeated rows; an empty table gives an empty result; with no labelled sample of
either class nothing is added to the patterns' finds; other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tapeloom.llm.common import stored

# The patterns' kinds in order. A find must have the last group of at least so many characters.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12
KINDS = ("assign", "access", "hex", "markov")

RUN = 16
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
THRESHOLD, MEAN, SMOOTH, PRIOR = 14.0, 0.7, 0.5, 10.0
UNIFORM = 0.3  # share of the random chain that is even over the alphabet, as its samples are mostly digits and hexadecimal
_SPAN = "struct<start:int,kind:int,stop:int,value:string>"
_NONE = f"cast(array() as array<{_SPAN}>)"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL that computes a value once and uses it by name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _by_blocks(array: str, block: str, body: str) -> str:
    """SQL for the values of `body` over the blocks of a named array that is not empty: as many blocks as rows in one, so folds and looks stay short."""
    width = f"cast(ceil(sqrt(size({array}))) as int)"
    return _let("width", width, f"transform(sequence(0, (size({array}) - 1) div width), k -> {_let(block, f'slice({array}, k * width + 1, width)', body)})")


def _finds(text: str, pattern: str, kind: int, group: int = 0, gate: str = "true") -> str:
    """SQL for the spans of a pattern: the pieces between the finds give their places.

    Places are summed within blocks of finds, then over the blocks, as every step of a fold copies what it has gathered.
    """
    p = _literal(pattern)
    more, value = (f", regexp_extract_all({text}, {p}, {group})", "z.`2`") if group else ("", "z.m")
    zipped = _let("m", f"regexp_extract_all({text}, {p}, 0)", f"filter(arrays_zip(split({text}, {p}, -1), m{more}), z -> z.m is not null)")
    start = "a.at + length(z.`0`)"
    within = (
        f"aggregate(block, named_struct('at', 0, 'found', {_NONE}), (a, z) -> named_struct('at', {start} + length(z.m), 'found', "
        f"concat(a.found, array(named_struct('start', {start}, 'kind', {kind}, 'stop', {start} + length(z.m), 'value', {value})))))"
    )
    begins = "aggregate(bs, named_struct('at', 0, 'all', cast(array() as array<int>)), (a, b) -> named_struct('at', a.at + b.at, 'all', concat(a.all, array(a.at))), a -> a.all)"
    moved = "transform(b.found, f -> named_struct('start', f.start + s, 'kind', f.kind, 'stop', f.stop + s, 'value', f.value))"
    placed = _let("bs", _by_blocks("zs", "block", within), f"flatten(zip_with(bs, {begins}, (b, s) -> {moved}))")
    walk = _let("zs", zipped, f"CASE WHEN size(zs) = 0 THEN {_NONE} ELSE {placed} END")
    return f"CASE WHEN {gate} THEN {walk} ELSE {_NONE} END"


def _apart(runs: str) -> str:
    """SQL for the runs that touch none of the spans in `base`: a block of runs looks only at the spans within its reach."""
    touch = lambda x, y: f"{x}.start < {y}.stop AND {y}.start < {x}.stop"
    reach = "filter(base, b -> b.start < element_at(block, -1).stop AND element_at(block, 1).start < b.stop)"
    kept = _let("near", reach, f"filter(block, c -> NOT exists(near, b -> {touch('b', 'c')}))")
    return _let("cs", runs, f"CASE WHEN size(cs) = 0 OR size(base) = 0 THEN cs ELSE flatten({_by_blocks('cs', 'block', kept)}) END")


def pattern_spans(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, base (spans of the known kinds, in order) and runs (candidates that touch none of them)."""
    keyword = " OR ".join(f"contains(lower(t), '{w}')" for w in ("pass", "secret", "token", "api"))
    base = (
        f"concat(filter({_finds('t', ASSIGN, 0, 2, keyword)}, s -> length(s.value) >= {ASSIGN_VALUE}), "
        f"{_finds('t', ACCESS, 1, 0, chr(39).join(('contains(t, ', 'AKIA', ')')))}, {_finds('t', HEX, 2, 0, 't rlike ' + _literal('[0-9a-f]{16}'))})"
    )
    pattern = CANDIDATE % run
    runs = _apart(_finds("t", pattern, 3, 0, "t rlike " + _literal(pattern)))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("base", F.expr(f"array_sort({base})"))
    return found.select("doc_id", "base", F.expr(runs).alias("runs"))


def samples(spans: DataFrame) -> DataFrame:
    """(random boolean, value): what the patterns find, and candidates without a digit."""
    random = spans.select(F.explode("base.value").alias("value")).select(F.lit(True).alias("random"), "value")
    plain = spans.select(F.explode("runs.value").alias("value")).where(~F.col("value").rlike("[0-9]")).select(F.lit(False).alias("random"), "value")
    return random.union(plain)


def ratios(sample: DataFrame, smooth: float = SMOOTH) -> dict[tuple[int, int], float]:
    """log P(next | char) of random strings less that of identifiers, by places in ALPHABET; place 0 stands before the first.

    A run's first character has the place 0 before it; characters outside ALPHABET are left out.
    """
    size = len(ALPHABET) + 1
    steps = sample.select("random", F.concat(F.lit(" "), "value").alias("v")).select("random", F.explode(F.expr("transform(sequence(1, length(v) - 1), i -> substring(v, i, 2))")).alias("pair"))
    counts = steps.groupBy("random", "pair").agg(F.count("*").alias("n")).where(F.col("pair").rlike("^[ A-Za-z0-9+/_=-][A-Za-z0-9+/_=-]$")).collect()  # 2 x 66 x 66 rows at most
    seen = {True: {}, False: {}}
    for r in counts:
        seen[r["random"]][ALPHABET.find(r["pair"][0]) + 1, ALPHABET.find(r["pair"][1]) + 1] = r["n"]
    if not seen[True] or not seen[False]:
        return {}
    # Pairs not seen are as likely as their second character is in the class.
    single = {k: [smooth] * size for k in seen}
    for k in seen:
        for (_, b), n in seen[k].items():
            single[k][b] += n
    share = {k: [x / sum(single[k][1:]) for x in single[k]] for k in seen}
    out = {}
    for a in range(size):
        total = {k: sum(seen[k].get((a, b), 0) for b in range(1, size)) for k in seen}
        for b in range(1, size):
            p = {k: (seen[k].get((a, b), 0) + PRIOR * share[k][b]) / (total[k] + PRIOR) for k in seen}
            p[True] = UNIFORM / (size - 1) + (1 - UNIFORM) * p[True]
            out[a, b] = math.log(p[True]) - math.log(p[False])
    return out


def _ratio_of(value: str, table: dict) -> Column:
    """SQL sum of the table's entries over a value's character pairs."""
    size = len(ALPHABET) + 1
    cells = ",".join(f"{table.get((a, b), 0.0):.6f}D" for a in range(size) for b in range(size))
    place = lambda at: f"instr('{ALPHABET}', substring({value}, {at}, 1))"
    first = f"element_at(ratio, {place(1)} + 1)"
    return f"aggregate(sequence(2, length({value})), {first}, (s, i) -> s + element_at(ratio, {place('i - 1')} * {size} + {place('i')} + 1))", f"array({cells})"


def scan(docs: DataFrame, run: int = RUN, threshold: float = THRESHOLD, mean: float = MEAN) -> DataFrame:
    """doc_id, base and all: spans (start, kind, stop, value), ordered by start, then kind."""
    spans = stored(pattern_spans(docs, run), "secret-spans")
    table = ratios(samples(spans))
    added = F.expr(_NONE)
    if table:
        score, cells = _ratio_of("c.value", table)
        judged = F.expr(f"filter(runs, c -> {score} >= greatest({threshold}D, {mean}D * length(c.value)))")
        spans, added = spans.withColumn("ratio", F.expr(cells)), judged
    return spans.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.stop)), ',')")


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
