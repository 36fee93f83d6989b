"""Operator 1: approximate nearest neighbours by a permutation index.

PIVOTS vectors, those whose ids hash lowest, are the reference points. Every vector is represented by its PREFIX nearest pivots in order;
the rows are dealt into blocks of BLOCK rows on average, and a block posts its rows in an inverted file: for each pivot, the rows that have it among
their nearest, with its place. A query walks the files of its own nearest pivots and adds up the footrule distance: the
differences of places, a pivot that a row lacks counting as place PREFIX. The best share RERANK of a block's rows (at least LEAST) is
reranked by exact cosine in double precision. Rows that tie at the last place of the share are all reranked.

Queries are a stated set, in chunks of CHUNK; each chunk meets each block once, and every meeting keeps the k best of a query, so a
task holds a block and a chunk whatever the table's size; a row is sent once a chunk of the queries, not once a query. What is broadcast is the pivots.

Defined results: vectors that are null, empty, zero, of another length than most (of the smaller length in a tie) or hold null or non-finite
components take no part; rows with a null vec_id neither; rows that repeat an id are candidates of their own, but no row with the query's id is its neighbour,
and of a query's rows the one with the least vector, components compared in order, answers for its id;
of equal scores the smaller id comes first; a query with fewer candidates than k gets all; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tapeloom.llm.common import stored

PIVOTS, PREFIX = 256, 64
BLOCK, CHUNK = 16_384, 4_096
RERANK, LEAST = 0.16, 256
K = 5


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    usual = whole.groupBy(F.size("v").alias("usual")).count().orderBy(F.desc("count"), "usual").limit(1).select("usual")
    return whole.join(F.broadcast(usual), F.size("v") == F.col("usual")).drop("usual")  # one row


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def prefixes(rows: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each unit vector, nearest first; the lower number first in a tie."""
    prefix = min(prefix, len(pivots))
    near = -(rows @ pivots.T)
    some = np.argpartition(near, prefix - 1, axis=1)[:, :prefix]
    some.sort(axis=1)
    order = np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1).astype(np.int16)


class PivotFiles:
    """The inverted files of one block of rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, perms: np.ndarray, n_pivots: int):
        self.ids, self.rows, self.prefix = ids, rows, perms.shape[1]
        flat = perms.ravel()
        order = np.argsort(flat, kind="stable")
        self.start = np.searchsorted(flat[order], np.arange(n_pivots + 1))
        self.row, self.place = (order // self.prefix).astype(np.int32), (order % self.prefix).astype(np.int32)

    def footrule(self, perm: np.ndarray) -> np.ndarray:
        """Footrule distance of a query's prefix to every row, but for a constant."""
        gain = np.zeros(len(self.ids), np.int32)
        for at, pivot in enumerate(perm):
            a, b = self.start[pivot], self.start[pivot + 1]
            # Against a row without the pivot the query pays prefix - at, and a row with a pivot of its own prefix - place.
            gain[self.row[a:b]] += (self.prefix - at) + (self.prefix - self.place[a:b]) - np.abs(self.place[a:b] - at)
        return -gain

    def search(self, query_id: int, query: np.ndarray, perm: np.ndarray, k: int, share: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k best of the reranked rows."""
        distance = self.footrule(perm)
        distance[self.ids == query_id] = np.iinfo(np.int32).max
        wanted = min(len(distance), max(least, int(share * len(distance)), k))
        last = np.partition(distance, wanted - 1)[wanted - 1]
        take = np.flatnonzero((distance <= last) & (self.ids != query_id))
        score = cosine(self.rows[take], query)
        best = np.lexsort((self.ids[take], -score))[:k]
        return self.ids[take][best], score[best]


def cosine(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def neighbours(vectors: DataFrame, queries, k: int = K, n_pivots: int = PIVOTS, prefix: int = PREFIX, share: float = RERANK, least: int = LEAST, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score; `queries` is a condition on vec_id."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "pivot-rows")
    n, asked = rows.agg(F.count("*"), F.count(F.when(queries, 1))).first()
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).toPandas()  # n_pivots rows
    schema = "query_id long, rank int, vec_id long, score double"
    if not n or not asked:
        return spark.createDataFrame([], schema)
    pivots = unit(np.stack(chosen["v"].to_numpy()).astype(float))
    shared = spark.sparkContext.broadcast(pivots)
    n_blocks, n_chunks = -(-n // block), -(-asked // chunk)

    def represent(batches):
        for b in batches:
            if b.num_rows:
                perm = prefixes(unit(_matrix(b.column("v"))), shared.value, prefix)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(perm), pa.list_(pa.int16()))], [*b.schema.names, "perm"])

    indexed = stored(rows.mapInArrow(represent, "vec_id long, v array<double>, perm array<short>"), "pivot-index")
    deal = lambda parts, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(parts))
    posted = indexed.withColumn("block", deal(n_blocks, 1)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    # One row an id asks. Every chunk of the queries meets every block of the rows.
    asked_by = indexed.where(queries).groupBy("vec_id").agg(F.min(F.struct("v", "perm")).alias("q")).select("vec_id", "q.v", "q.perm")
    asking = asked_by.withColumn("chunk", deal(n_chunks, 2).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            as_matrix = lambda t, c: _matrix(t.column(c).combine_chunks())
            files = PivotFiles(left.column("vec_id").to_numpy(), as_matrix(left, "v"), as_matrix(left, "perm"), len(shared.value))
            for query_id, query, perm in zip(right.column("vec_id").to_pylist(), as_matrix(right, "v"), as_matrix(right, "perm")):
                ids, score = files.search(query_id, query, perm, k, share, least)
                for o, x in zip(out, (np.full(len(ids), query_id), ids, score)):
                    o.append(x)
        cat = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        return pa.table([cat(out[0], pa.int64()), cat(out[1], pa.int64()), cat(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    key = ["block", "chunk"]
    met = posted.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
