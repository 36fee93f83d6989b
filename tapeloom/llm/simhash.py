"""Operator 4: SimHash near-duplicates, linked through Golay-code fuzzy hashing.

Fingerprints of 64 bits link at 4 or fewer differing bits. They are cut into four segments of 16 bits, each
set into a word of 23 bits and decoded to the codewords near it (golay.near): segments that differ in at most
two bits share a codeword. By the pigeonhole principle a pair at distance 4 or less agrees in one of
  a) two segments being equal (6 keys of 32 bits),
  b) just one segment being equal: no other then differs in more than two bits, so that segment and a codeword
     of the next one agree (4 x 1 or 6 keys of 28 bits),
  c) no segment being equal: each then differs in exactly one bit, so a codeword each of the first two agrees, and
     so do the differences between the four segments' parities (1 to 36 keys of 27 bits).
Keys are joined and every candidate pair is verified by its differing bits, so no link is lost or made up.

Equal fingerprints are one node, so copies are never expanded into pairs. Keys of kind a)
first link each fingerprint to the smallest one of its bucket; components of those links then keep the pairs
inside a dense group from being made at all: the full join only makes links between different components.
Hot buckets are dealt out by the skew join. No join is a broadcast, as both sides of each grow with the documents.

Defined results: a null or empty text has fingerprint zero and links like any other; repeated rows give repeated
rows; rows with a null doc_id carry their fingerprint's component and lend it no name (component_id is null where
no member has an id); an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tapeloom.llm import golay
from tapeloom.llm.common import shuffled, stored, text_bytes
from tapeloom.llm.components import components

WORDS = 4
DISTANCE = 4


def fingerprint(body: bytes) -> int:
    """Bits set in over half of the XXH64 values of the text's word shingles; ASCII letters in lower case."""
    words = body.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    last = len(words) - WORDS
    digest = xxhash.xxh64_digest
    if last < 0:
        hashes = [digest(line, 42)]
    else:
        hashes = [digest(line[s : e - 1], 42) for s, e in zip(starts, ends[WORDS - 1 :])]
    bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1)
    count = np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id long, fp long) of every row."""

    def extract(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("body").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")).mapInArrow(extract, "doc_id long, fp long")


def bucket_keys(fp: np.ndarray, kinds: str = "abc") -> list[np.ndarray]:
    """Columns of keys (int64, golay.PAD where absent) for fingerprints (uint64)."""
    seg = [(fp >> np.uint64(48 - 16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    out, kind = [], 0
    for i, j in combinations(range(4), 2):
        if "a" in kinds:
            out.append(kind << 40 | seg[i] << 16 | seg[j])
        kind += 1
    if kinds == "a":
        return out
    near = [golay.near(s << (golay.LENGTH - 16)) for s in seg]
    for i in range(4):
        for code in near[(i + 1) % 4].T if "b" in kinds else ():
            out.append(np.where(code == golay.PAD, golay.PAD, kind << 40 | seg[i] << 12 | code))
        kind += 1
    parity = [np.bitwise_count(s).astype(np.int64) & 1 for s in seg]
    turn = (parity[0] ^ parity[1]) << 2 | (parity[1] ^ parity[2]) << 1 | (parity[2] ^ parity[3])
    for one in near[0].T if "c" in kinds else ():
        for two in near[1].T:
            out.append(np.where((one == golay.PAD) | (two == golay.PAD), golay.PAD, kind << 40 | turn << 24 | one << 12 | two))
    return out


def keyed(nodes: DataFrame, kinds: str) -> DataFrame:
    """(key, fp) and any further long columns of nodes, a row for each key."""
    extra = [c for c in nodes.columns if c != "fp"]

    def expand(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                keys = np.stack(bucket_keys(part.column("fp").to_numpy().view(np.uint64), kinds), 1)
                row, col = np.nonzero(keys != golay.PAD)
                take = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(keys[row, col]), *take.columns], ["key", *take.schema.names])

    return nodes.select("fp", *extra).mapInArrow(expand, ", ".join(f"{c} long" for c in ("key", "fp", *extra)))


def _differing(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def link_fingerprints(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, component) for distinct fingerprints (fp): the least one reachable by links."""
    hubs = keyed(prints, "a")
    least = hubs.groupBy("key").agg(F.min("fp").alias("hub"))
    stars = hubs.join(shuffled(least), "key").where((F.col("hub") != F.col("fp")) & (_differing("fp", "hub") <= distance))
    first = components(stars.select(F.col("fp").alias("a"), F.col("hub").alias("b")))
    named = stored(prints.join(shuffled(first.withColumnRenamed("node", "fp")), "fp", "left").select("fp", F.coalesce("component", "fp").alias("comp")), "simhash-stars")
    keys = keyed(named, "abc")
    x, y = (keys.select("key", F.col("fp").alias(f"fp_{s}"), F.col("comp").alias(f"comp_{s}")) for s in "xy")
    links = x.join(shuffled(y), (x["key"] == y["key"]) & (F.col("comp_x") < F.col("comp_y")) & (_differing("fp_x", "fp_y") <= distance))
    second = components(links.select(F.col("comp_x").alias("a"), F.col("comp_y").alias("b")))
    return named.join(shuffled(second.withColumnRenamed("node", "comp")), "comp", "left").select("fp", F.coalesce("component", "comp").alias("component"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"keys are complete for distances of 0 to {DISTANCE}")
    rows = stored(fingerprints(docs), "simhash-prints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = prints.join(shuffled(link_fingerprints(prints.select("fp"), distance)), "fp")
    names = found.groupBy("component").agg(F.min("least").alias("component_id"))
    per_fp = found.join(shuffled(names), "component").select("fp", "component_id")
    return rows.join(shuffled(per_fp), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
