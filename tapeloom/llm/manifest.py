"""Operator 13: Merkle manifest of a dataset by mountain-range stacks over indexed partitions.

Every row is a leaf, the SHA-256 of its fields. Leaves are dealt by ranges of (group, order) and written in order, so that each
partition knows how many leaves of a group stand before its own. A task then walks its leaves with a stack of peaks, one open run a level:
a run of FANOUT consecutive nodes that ends is hashed and carried to the level above, like a digit of a counter. A run
whose first nodes lie in an earlier partition cannot be closed there; its nodes are left as peaks. Peaks are few (two edges, FANOUT a level
and partition) and are merged level by level with a shuffle on (group, level, run): at most FANOUT rows meet in a run. The last run of a level may be
short and is hashed as it is, without padding.

Groups' roots are the leaves of one more tree, built by the same function, so many groups are dealt out as well. Paths are
handed down from the root by joins on (group, node), one a level; a leaf's proof is made where its run of FANOUT leaves meets its path, so
paths are moved once a run, not once a leaf. A hot group is cut by ranges as any other.

Defined results: null fields are `-`; null sources are the first group, null doc_ids come first in theirs; rows of one doc_id are
ordered by leaf, and equal rows are leaves of their own (their order changes nothing); rows with null doc_ids are not tampered
with; a proof without siblings is the hash of nothing; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tapeloom.llm.common import CRC32_TABLE_SQL, crc32_sql, stored

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_RECORD = "node boolean, g string, level int, k long, n long, digest string, kids array<string>"
_ARROW = pa.schema(
    [("node", pa.bool_()), ("g", pa.string()), ("level", pa.int32()), ("k", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("kids", pa.list_(pa.string()))]
)


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def nodes_at(n: int, level: int, fanout: int = FANOUT) -> int:
    """Nodes on a level of a tree of n leaves."""
    for _ in range(level):
        n = -(-n // fanout)
    return n


# -- leaves -------------------------------------------------------------------------------------------------------
def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text: Column, fields=FIELDS) -> Column:
    """SHA-256 of a row's fields, the text given apart."""
    return F.sha2(F.concat(*(_field(text if c == "text" else F.col(c)) for c in fields)).cast("binary"), 256)


def group_key(column: str) -> Column:
    """Orders as null first, then UTF-8 bytewise, and is never null."""
    return F.coalesce(F.concat(F.lit("1"), F.col(column).cast("string")), F.lit("0"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """(g, doc_id, leaf, altered): altered is the leaf of the row tampered with, null where that changes nothing."""
    docs = docs.select(*FIELDS)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0, F.lit(False))
    folded = F.translate("text", UPPER, LOWER)
    altered = F.when(hit & F.col("text").rlike("[A-Z]"), leaf_hash(folded))
    return docs.select(group_key("source").alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(F.col("text")).alias("leaf"), altered.alias("altered"))


# -- the tree -----------------------------------------------------------------------------------------------------
class Mountains:
    """Peaks of a range of consecutive leaves of one group; what it completes or leaves open goes to `out`, a list of records."""

    def __init__(self, group: str, n: int, out: list, fanout: int = FANOUT):
        self.group, self.n, self.out, self.fanout = group, n, out, fanout
        self.runs: list[list[str]] = []  # a level: digests of the run that is open there
        self.begun: list[int] = []  # place of its first node
        self.counts: list[int] = []  # nodes on the level

    def push(self, k: int, value: str, level: int = 0) -> None:
        while True:
            if level == len(self.runs):
                self.runs.append([])
                self.begun.append(k)
                self.counts.append(nodes_at(self.n, level, self.fanout))
            run = self.runs[level]
            if not run:
                self.begun[level] = k
            run.append(value)
            if self.counts[level] == 1 or (k % self.fanout != self.fanout - 1 and k != self.counts[level] - 1):
                return
            if self.begun[level] % self.fanout:  # it began in another partition
                self._leave(level)
                return
            value = digest("".join(run))
            self.out.append((True, self.group, level + 1, k // self.fanout, self.n, value, run))
            self.runs[level] = []
            level, k = level + 1, k // self.fanout

    def _leave(self, level: int) -> None:
        first = self.begun[level]
        self.out += [(False, self.group, level, first + i, self.n, d, None) for i, d in enumerate(self.runs[level])]
        self.runs[level] = []

    def end(self) -> None:
        for level in range(len(self.runs)):
            self._leave(level)


def _stack(fanout: int):
    def walk(batches):
        peaks, last, out = None, None, []
        for batch in batches:
            for g, k, n, leaf in zip(*(batch.column(c).to_pylist() for c in ("g", "k", "n", "leaf"))):
                if last != (g, k - 1):
                    if peaks:
                        peaks.end()
                    peaks = Mountains(g, n, out, fanout)
                peaks.push(k, leaf)
                last = g, k
            if len(out) > 10_000:
                yield _batch(out)
                out.clear()
        if peaks:
            peaks.end()
        if out:
            yield _batch(out)

    return walk


def _batch(records: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*records), _ARROW)], schema=_ARROW)


def _count_at(level: int, fanout: int) -> Column:
    size = fanout**level
    return F.expr(f"(n + {size - 1}L) div {size}L")


@dataclass
class Tree:
    """leaves: (g, k, n, leaf, and what came with them). nodes: (g, level, k, n, digest, kids). roots: (g, n, level, digest). depth: of the deepest group."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    depth: int
    fanout: int


def indexed(rows: DataFrame, order: list[str], tag: str) -> DataFrame:
    """rows (g, leaf, ...) with k, their place in their group's order (nulls first), and n, the group's rows."""
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), f"{tag}-rows")
    by = [F.col("g").asc(), *(F.col(c).asc_nulls_first() for c in order), F.col("leaf").asc(), F.col("__row").asc()]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__row", F.monotonically_increasing_id())
    placed = stored(placed, f"{tag}-ordered").withColumn("__part", F.shiftright("__row", 33))  # partition, and place in it
    spans = placed.groupBy("g", "__part").agg(F.min("__row").alias("__first"), F.count("*").alias("__here"))
    earlier = Window.partitionBy("g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    spans = spans.select("g", "__part", "__first", F.coalesce(F.sum("__here").over(earlier), F.lit(0)).alias("__before"), F.sum("__here").over(Window.partitionBy("g")).alias("n"))
    k = F.col("__before") + F.col("__row") - F.col("__first")
    return placed.join(spans, ["g", "__part"]).withColumn("k", k).drop("__part", "__row", "__first", "__before")


def grow(rows: DataFrame, order: list[str], tag: str = "merkle", fanout: int = FANOUT) -> Tree:
    """The trees of all groups of rows (g, leaf, ...), leaves in the order of the columns named."""
    if fanout < 2:
        raise ValueError("fanout >= 2")
    leaves = stored(indexed(rows, order, tag), f"{tag}-leaves")
    walked = leaves.select("g", "k", "n", "leaf").sortWithinPartitions("g", "k").mapInArrow(_stack(fanout), _RECORD)
    records = stored(walked, f"{tag}-stack")
    most = leaves.agg(F.max("n")).first()[0] or 1  # a number
    depth = 0
    while nodes_at(most, depth, fanout) > 1:
        depth += 1
    peaks = records.where("NOT node").select("g", "level", "k", "n", "digest")
    made, edges, roots = [records.where("node").select("g", "level", "k", "n", "digest", "kids")], None, []
    for level in range(depth + 1):
        here = peaks.where(F.col("level") == level)
        here = here.unionByName(edges.select(*here.columns)) if edges is not None else here
        lone = _count_at(level, fanout) == 1
        roots.append(here.where(lone).select("g", "n", "level", "digest"))
        if level == depth:
            break
        run = F.array_sort(F.collect_list(F.struct("k", "digest")))  # fanout rows at most
        met = here.where(~lone).groupBy("g", "n", F.expr(f"k div {fanout}").alias("k")).agg(F.transform(run, lambda x: x["digest"]).alias("kids"))
        merged = met.select("g", F.lit(level + 1).alias("level"), "k", "n", F.sha2(F.array_join("kids", "").cast("binary"), 256).alias("digest"), "kids")
        edges = stored(merged, f"{tag}-edges")
        made.append(edges)
    union = lambda parts: parts[0] if len(parts) == 1 else union([*parts[:-2], parts[-2].unionByName(parts[-1])])
    return Tree(leaves, union(made), stored(union(roots), f"{tag}-roots"), depth, fanout)


def hand_down(tree: Tree, above: DataFrame, tag: str = "merkle") -> DataFrame:
    """(g, k, n, kids, lefts, rights, and the other columns of above) of every lowest run: what stands left and right of its node, level by level up.

    above: (g, lefts, rights, ...) of every group's root. A group of one leaf has a run of that leaf whose `n` is 1, and which is not hashed.
    """
    carried = [c for c in above.columns if c not in ("g", "lefts", "rights")]
    tops = tree.roots.join(above, "g").withColumnRenamed("digest", "__root")
    lone = tops.where("n = 1").select("g", F.lit(0).cast("long").alias("k"), "n", F.array("__root").alias("kids"), "lefts", "rights", *carried)
    paths = None
    for level in range(tree.depth, 0, -1):
        nodes = tree.nodes.where(F.col("level") == level).select("g", "k", "n", "kids")
        place = tops.where(F.col("level") == level).select("g", F.lit(0).cast("long").alias("k"), "lefts", "rights", *carried)
        if paths is not None:
            place = place.unionByName(_children(paths, carried, tree.fanout))
        paths = stored(nodes.join(place, ["g", "k"]), f"{tag}-paths")
    return lone if paths is None else lone.unionByName(paths.select(*lone.columns))


def _children(paths: DataFrame, carried: list[str], fanout: int) -> DataFrame:
    """Places of a level's nodes from the runs of the level above."""
    each = paths.select("g", F.col("k").alias("__k"), "kids", "lefts", "rights", *carried, F.explode(F.sequence(F.lit(0), F.size("kids") - 1)).alias("j"))
    left = F.array_join(F.slice("kids", F.lit(1), F.col("j")), "")
    right = F.array_join(F.slice("kids", F.col("j") + 2, F.lit(fanout)), "")
    return each.select(
        "g", (F.col("__k") * fanout + F.col("j")).alias("k"), F.concat(F.array(left), "lefts").alias("lefts"), F.concat(F.array(right), "rights").alias("rights"), *carried
    )


# -- manifest and proofs ------------------------------------------------------------------------------------------
@dataclass
class Manifest:
    """The groups' trees, the tree over their roots, and its root (None for no rows)."""

    groups: Tree
    top: Tree
    root: str | None


def manifest(leaves: DataFrame, order: list[str], fanout: int = FANOUT) -> Manifest:
    groups = grow(leaves, order, "merkle", fanout)
    top = grow(groups.roots.select(F.lit("").alias("g"), F.col("g").alias("group"), F.col("digest").alias("leaf")), ["group"], "merkle-top", fanout)
    found = top.roots.first()  # a row at most
    return Manifest(groups, top, found and found["digest"])


_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_PROOF_NAMES = [c.split()[0] for c in _PROOF.split(", ")]


def _prove(root: str | None):
    def fold(value: str, lefts: list, rights: list) -> str:
        for a, b in zip(lefts, rights):
            value = digest(a + value + b)
        return value

    def walk(batches):
        for batch in batches:
            rows = []
            for record in batch.to_pylist():
                kids, lefts, rights, lone = record["kids"], record["lefts"], record["rights"], record["n"] == 1
                upper = "".join(a + b for a, b in zip(lefts, rights))
                whole = {}  # a run's digest -> the root that it leads to
                for j, m in enumerate(record["members"]):
                    own = m["altered"] or kids[j]
                    left, right = "".join(kids[:j]), "".join(kids[j + 1 :])
                    value = own if lone else digest(left + own + right)
                    if value not in whole:
                        whole[value] = fold(value, lefts, rights)
                    proof = digest((upper if lone else left + right + upper))
                    rows.append((m["doc_id"], kids[j], record["subroot"], root, proof, whole[value], whole[value] == root))
            columns = zip(*rows) if rows else [[] for _ in _PROOF_NAMES]
            kinds = [pa.int64()] + [pa.string()] * 5 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], _PROOF_NAMES)

    return walk


def proofs(made: Manifest, fanout: int = FANOUT) -> DataFrame:
    """A row a leaf: its proof's hash, and the root that the leaf as given (altered, where it is) leads to."""
    none = F.array().cast("array<string>")
    tops = hand_down(made.top, made.top.roots.select("g", none.alias("lefts"), none.alias("rights")), "merkle-top")
    names = made.top.leaves.select(F.col("k").alias("__at"), F.col("group").alias("g"), F.col("leaf").alias("subroot"))
    if made.top.depth:
        placed = _children(tops, [], fanout).withColumnRenamed("g", "__top").withColumnRenamed("k", "__at")
    else:
        placed = tops.select(F.lit(0).cast("long").alias("__at"), "lefts", "rights")
    above = stored(placed.join(names, "__at").select("g", "lefts", "rights", "subroot"), "merkle-above")
    runs = hand_down(made.groups, above)
    leaf = F.struct("k", "doc_id", "altered")
    members = made.groups.leaves.groupBy("g", F.expr(f"k div {fanout}").alias("k")).agg(F.array_sort(F.collect_list(leaf)).alias("members"))
    return runs.join(members, ["g", "k"]).select("n", "kids", "lefts", "rights", "subroot", "members").mapInArrow(_prove(made.root), _PROOF)


def verify(docs: DataFrame) -> DataFrame:
    """Proofs of all rows of documents, those that TAMPER picks recomputed from their text in lower case."""
    return proofs(manifest(document_leaves(docs), ["doc_id"]))


def query(spark, sf_dir: str) -> DataFrame:
    return verify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _tree_sql(name: str, leaves: str, levels: int) -> str:
    """CTEs of a tree over leaves (g, k, n, d): name_0 .. name_levels (g, k, n, d), n the level's nodes, and name_run_i (g, p, ds)."""
    out = [f"{name}_0 AS ({leaves})"]
    for i in range(levels):
        out.append(f"{name}_run_{i} AS (SELECT g, k // {FANOUT} p, n, list(d ORDER BY k) ds FROM {name}_{i} WHERE n > 1 GROUP BY g, n, k // {FANOUT})")
        out.append(f"{name}_{i + 1} AS (SELECT g, p k, (n + {FANOUT - 1}) // {FANOUT} n, sha256(array_to_string(ds, '')) d FROM {name}_run_{i})")
    roots = " UNION ALL ".join(f"SELECT g, d FROM {name}_{i} WHERE n = 1" for i in range(levels + 1))
    return ",\n".join([*out, f"{name}_roots AS ({roots})"])


def _up_sql(runs: list[tuple[str, str, str]], start: str) -> tuple[str, str, str]:
    """Joins, siblings and fold over the levels (table, group, place at the level)."""
    joins, siblings, fold = [], [], start
    for i, (table, group, place) in enumerate(runs):
        joins.append(f"LEFT JOIN {table} r{i} ON r{i}.g = {group} AND r{i}.p = ({place}) // {FANOUT}")
        j = f"CAST(({place}) % {FANOUT} AS BIGINT)"
        left, right = f"array_to_string(r{i}.ds[1:{j}], '')", f"array_to_string(r{i}.ds[{j} + 2:], '')"
        siblings.append(f"coalesce({left} || {right}, '')")
        fold = f"CASE WHEN r{i}.g IS NULL THEN {fold} ELSE sha256({left} || ({fold}) || {right}) END"
    return "\n".join(joins), " || ".join(siblings), fold


def _oracle(levels: int = 4, top_levels: int = 3) -> str:
    field = lambda x: f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x}, '-')"
    hashed = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    runs = [(f"sub_run_{i}", "l.g", f"l.k // {FANOUT**i}") for i in range(levels)]
    runs += [(f"top_run_{i}", "''", f"t.k // {FANOUT**i}") for i in range(top_levels)]
    joins, siblings, _ = _up_sql(runs, "''")
    steps, value = [], "x"
    for i, (_, _, place) in enumerate(runs):  # a level at a time, each from the one below
        j = f"CAST(({place.replace('l.k', 'k').replace('t.k', 'tk')}) % {FANOUT} AS BIGINT)"
        left, right = f"array_to_string(ds{i}[1:{j}], '')", f"array_to_string(ds{i}[{j} + 2:], '')"
        steps.append(f"f{i} AS (SELECT * EXCLUDE (x), CASE WHEN ds{i} IS NULL THEN {value} ELSE sha256({left} || x || {right}) END x FROM {f'f{i - 1}' if i else 'met'})")
    lists = ", ".join(f"r{i}.ds ds{i}" for i in range(len(runs)))
    return f"""
WITH {CRC32_TABLE_SQL},
hashed AS (SELECT doc_id, coalesce('1' || source, '0') g, {hashed('text')} leaf,
    CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)', 'crc_t')} % {TAMPER} = 0 THEN {hashed(low)} END altered FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 k, count(*) OVER (PARTITION BY g) n FROM hashed),
{_tree_sql('sub', 'SELECT g, k, n, leaf d FROM placed', levels)},
tops AS (SELECT g, d, row_number() OVER (ORDER BY g) - 1 k, count(*) OVER () n FROM sub_roots),
{_tree_sql('top', "SELECT '' g, k, n, d FROM tops", top_levels)},
met AS (SELECT l.doc_id, l.k, t.k tk, l.leaf, t.d subroot, (SELECT d FROM top_roots) root, sha256({siblings}) proof_sha256, coalesce(l.altered, l.leaf) x, {lists}
    FROM placed l JOIN tops t USING (g)
{joins}),
{(',' + chr(10)).join(steps)}
SELECT doc_id, leaf, subroot, root, proof_sha256, x folded_root, x = root verified FROM f{len(runs) - 1}
"""


ORACLE_SQL = _oracle()
