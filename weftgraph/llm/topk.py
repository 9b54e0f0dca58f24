"""Exact top-k search with multi-resolution segment statistics.

Vectors are cut in 1, 4, then 16 segments. A segment's mean and deviation bound what two segments can
contribute: sum(a*b) <= L * (mean_a * mean_b + dev_a * dev_b), which is the lower bound
L * ((mean_a - mean_b)^2 + (dev_a - dev_b)^2) of their squared distance, written for inner products. Coarse to
fine, pairs whose bound is under the query's k-th score so far go; survivors get the exact product.

Defined results: null vectors and those with null or non-finite components take no part, nor do vectors of
another length than the most frequent; a query meets all rows but those of its own vec_id; rows that repeat a
vec_id count one by one as candidates and once as a query; ties go to the smaller vec_id; extra columns are
not read; no vectors give no rows. Scores are sums of integers in doubles, exact up to 2^53; vectors so long that a
sum could pass it (the product of the two longest) raise an error rather than give a rounded score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors

LEVELS = (1, 4, 16)
SCALE = 256


def segments(m: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations, times the root of the segments' lengths, so that products sum to bounds."""
    cut = np.linspace(0, m.shape[1], min(n, m.shape[1]) + 1).astype(int)
    lens = np.diff(cut)
    mean = np.add.reduceat(m, cut[:-1], axis=1) / lens
    dev = np.sqrt(np.maximum(np.add.reduceat(m * m, cut[:-1], axis=1) / lens - mean * mean, 0))
    return mean * np.sqrt(lens), dev * np.sqrt(lens)


def bounds(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Upper bounds of all inner products at ``n`` segments."""
    (ma, da), (mb, db) = segments(a, n), segments(b, n)
    return np.hstack([ma, da]) @ np.hstack([mb, db]).T


def scan(query_ids: np.ndarray, queries: np.ndarray, k: int, levels: tuple[int, ...] = LEVELS):
    d = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = vectors.TopK(len(query_ids), k)
        stats = [np.hstack(segments(queries, n)).T for n in levels]
        longest = np.sqrt((queries * queries).sum(1).max(initial=0))
        size = 64
        for b in batches:
            ids, m = b.column("vec_id").to_numpy(), vectors.matrix(b.column("v"), d)
            if len(ids) and longest * np.sqrt((m * m).sum(1).max()) >= 2.0**53:
                raise OverflowError("scores of these vectors pass 2^53: scale them down")
            at = 0
            while at < len(ids):
                own, rows = ids[at : at + size], m[at : at + size]
                at, size = at + size, min(2 * size, 2048)  # small at first, as nothing is pruned yet
                r, q = np.arange(len(own)), np.arange(len(query_ids))
                alive = np.ones((len(r), len(q)), bool)
                for n, s in zip(levels, stats, strict=True):
                    upper = np.hstack(segments(rows[r], n)) @ s[:, q]
                    alive &= upper + 1e-7 * np.abs(upper) + 1e-6 >= top.least[q]
                    keep_r, keep_q = alive.any(1), alive.any(0)
                    r, q, alive = r[keep_r], q[keep_q], alive[np.ix_(keep_r, keep_q)]
                    if not len(r):
                        break
                if not len(r):
                    continue
                i, j = np.nonzero(alive)
                if len(i) > 0.05 * len(r) * len(q):
                    scores = (rows[r] @ queries[q].T)[i, j]  # integers: exact in any order
                else:
                    scores = np.einsum("ij,ij->i", rows[r[i]], queries[q[j]])
                good = (scores >= top.least[q[j]]) & (own[r[i]] != query_ids[q[j]])
                top.add(q[j[good]], own[r[i[good]]], scores[good])
        yield vectors.batch(top, query_ids)

    return run


def search(df: DataFrame, is_query: Column, k: int, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(query_id, rank, vec_id, score long): of integer vectors floor(SCALE * x), by inner product."""
    rows = vectors.clean(df).select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")).alias("v"))
    found = vectors.search(rows, vectors.query_blocks(rows.filter(is_query)), lambda ids, queries: scan(ids, queries, k, levels))
    out = vectors.merged(found, k)
    return out.withColumn("score", F.col("score").cast("bigint"))
