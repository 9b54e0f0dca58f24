"""What the two vector searches share: clean vectors, blocks of queries, running and merged top-k.

Queries are written to the shared folder in blocks of about BLOCK rows (BLOCK * dimension * 8 bytes). The driver reads
one block at a time and sends it with the scan of all candidates, whose rows are never shuffled, whatever their
distribution; with several blocks, a block's result is written before the next is read. Each task returns its own
top k of a query, and a window over those rows, few for any query, merges them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise

BLOCK = 16_384
FOUND = "query_id bigint, vec_id bigint, score double"


def clean(df: DataFrame, zero: bool = True) -> DataFrame:
    """(vec_id, v) as doubles, without null ids, null vectors, null or non-finite components, or, unless ``zero``, zero vectors.

    Vectors of other lengths than the most frequent one (the longest of these) can't be compared and take no part.
    """
    v = F.col("embedding").cast("array<double>")
    rows = df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0)
    if not zero:
        fine = fine & F.exists("v", lambda x: x != 0)
    rows = rows.filter(fine)
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.filter(F.size("v") == (size[0]["n"] if size else -1))


def query_blocks(queries: DataFrame, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of each block, by id, one at a time; a repeated id keeps its smallest vector."""
    once = materialise(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = -(-once.count() // block)
    if blocks > 1:  # written by block, so that reading one skips the others' files
        place = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
        once = materialise(once.withColumn("_b", place).repartitionByRange(blocks, "_b"), "blocks")
    for b in range(blocks):
        rows = (once.filter(F.col("_b") == b) if blocks > 1 else once).select("vec_id", "v").orderBy("vec_id").collect()  # about ``block`` rows
        if rows:
            yield np.array([r["vec_id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class TopK:
    """The k best of each query so far: higher scores, then smaller ids."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.q, self.id, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.least = np.full(n, -np.inf)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(q):
            return
        q, ids, score = np.concatenate([self.q, q]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        o = np.lexsort((ids, -score, q))
        q, ids, score = q[o], ids[o], score[o]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.id, self.score = q[keep], ids[keep], score[keep]
        last = rank == self.k - 1
        self.least[q[last]] = score[last]


def search(candidates: DataFrame, blocks: Iterable[tuple[np.ndarray, np.ndarray]], run: Callable[[np.ndarray, np.ndarray], Callable]) -> DataFrame:
    """What the blocks' scans find; only the last block's is not written yet."""
    out, waiting = None, None
    for ids, queries in blocks:
        if waiting is not None:
            part = materialise(waiting, "found")
            out = part if out is None else out.unionByName(part)
        waiting = candidates.mapInArrow(run(ids, queries), FOUND)
    if waiting is None:
        return candidates.sparkSession.createDataFrame([], FOUND)
    return waiting if out is None else out.unionByName(waiting)


def batch(top: TopK, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids[top.q]), pa.array(top.id), pa.array(top.score)], names=["query_id", "vec_id", "score"])


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the tasks' own top k."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
