"""Approximate nearest neighbours by inner product, through learned partitions.

On a bounded sample: the graph of each row's neighbours by inner product, its balanced partitioning (recursive bisection by
the second eigenvector, halves at the median, then swaps that lower the cut), and two small softmax classifiers. One places
every row in a partition; it sees the row with one more component, sqrt(M^2 - norm^2), so that rows of different
norms have different places (M: the sample's largest norm). The other routes a query, by its direction, to the
partitions where its neighbours are most probable, as many as reach TARGET recall on the sample and, for ASKED queries, of
their true neighbours among all rows; the rows there are reranked by exact products. Queries that find fewer than k
rows are searched again in all partitions.

Rows are placed where they are read and meet the queries routed to their partition there: a partition with a third of
all rows is no hot group.

Defined results: null and zero vectors, and those with null or non-finite components, take no part, nor do
vectors of another length than the most frequent; repeated vec_ids count one by one as candidates and once as
a query, which skips all rows of its own vec_id; ties go to the smaller vec_id; no vectors give no rows. A table
too small for two partitions of LEAST rows is searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import materialise

#: Rows to fit on, about, for up to a million rows; beyond, 8 times the root of their number, up to MOST. Every row is indexed.
SAMPLE, MOST = 8192, 32_768
#: Sampled rows of a partition, at least: partitions grow with the rows until the sample bounds them.
LEAST = 64
NEIGHBOURS = 10
#: Recall that the number of probes must reach.
TARGET = 0.94
#: Queries whose true neighbours among all rows set the number of probes.
ASKED = 256


@dataclass(frozen=True)
class Index:
    place: np.ndarray  # (d + 2) x partitions
    ask: np.ndarray  # (d + 1) x partitions
    reach: float  # the sample's largest norm
    probes: int

    def partition(self, m: np.ndarray) -> np.ndarray:
        return (lifted(m, self.reach) @ self.place[:-1] + self.place[-1]).argmax(1)

    def logits(self, queries: np.ndarray) -> np.ndarray:
        return unit(queries) @ self.ask[:-1] + self.ask[-1]

    def route(self, queries: np.ndarray) -> np.ndarray:
        """Queries x partitions, true where a query goes."""
        x = self.logits(queries)
        out = np.zeros(x.shape, bool)
        np.put_along_axis(out, np.argsort(-x, 1, kind="stable")[:, : self.probes], True, 1)
        return out


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def lifted(m: np.ndarray, reach: float) -> np.ndarray:
    """Rows with the component that brings them to norm ``reach``, in units of it."""
    rest = np.sqrt(np.maximum(reach * reach - (m * m).sum(1), 0))
    return np.hstack([m, rest[:, None]]) / reach


def neighbours(m: np.ndarray, k: int) -> np.ndarray:
    """Of each row, the k others of the largest inner product, the largest first."""
    out = np.empty((len(m), k), np.int64)
    for a in range(0, len(m), 1024):
        s = m[a : a + 1024] @ m.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        best = np.argpartition(-s, k - 1, 1)[:, :k]
        out[a : a + 1024] = np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), 1, kind="stable"), 1)
    return out


def bisect(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Halves of ``nodes`` (true: the second) that cut few of the edges (a, b), numbered within nodes."""
    n = len(nodes)
    deg = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1.0
    x = rng.standard_normal(n)
    root = np.sqrt(deg)
    for _ in range(60):  # power iteration on the normalised adjacency, without its first eigenvector
        x -= root * (root @ x) / (root @ root)
        y = x / root
        x = (np.bincount(a, y[b], n) + np.bincount(b, y[a], n) + y) / root + x
        x /= np.linalg.norm(x)
    side = np.zeros(n, bool)
    side[np.argsort(x / root, kind="stable")[n // 2 :]] = True
    for _ in range(8):  # equal swaps of those that gain
        other = np.bincount(a, side[a] != side[b], n) + np.bincount(b, side[a] != side[b], n)
        gain = 2 * other - (deg - 1)
        left, right = np.flatnonzero(~side & (gain > 0)), np.flatnonzero(side & (gain > 0))
        k = min(len(left), len(right)) // 2
        if not k:
            break
        side[left[np.argsort(-gain[left], kind="stable")[:k]]] = True
        side[right[np.argsort(-gain[right], kind="stable")[:k]]] = False
    return side


def partition_graph(near: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Labels 0 to parts - 1 (a power of two), of sizes that differ by one for each halving at most."""
    n, k = near.shape
    label = np.zeros(n, np.int64)
    a, b = np.repeat(np.arange(n), k), near.ravel()
    rng = np.random.default_rng(seed)
    while label.max() + 1 < parts:
        new = label * 2
        for p in range(label.max() + 1):
            nodes = np.flatnonzero(label == p)
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            inside = (label[a] == p) & (label[b] == p)
            new[nodes] += bisect(nodes, place[a[inside]], place[b[inside]], rng)
        label = new
    return label


def softmax(x: np.ndarray, goal: np.ndarray, steps: int = 250) -> np.ndarray:
    """Weights, the bias last, that fit rows of probabilities, by Adam."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, mo, ve = (np.zeros((x.shape[1], goal.shape[1])) for _ in range(3))
    for t in range(1, steps + 1):
        z = x @ w
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        g = x.T @ (p - goal) / len(x) + 1e-6 * w
        mo, ve = 0.9 * mo + 0.1 * g, 0.999 * ve + 0.001 * g * g
        w -= 0.3 * (mo / (1 - 0.9**t)) / (np.sqrt(ve / (1 - 0.999**t)) + 1e-9)
    return w


def shares(labels: np.ndarray, parts: int) -> np.ndarray:
    """Rows of labels as rows of probabilities."""
    out = np.zeros((len(labels), parts))
    np.add.at(out, (np.repeat(np.arange(len(labels)), labels.shape[1]), labels.ravel()), 1.0)
    return out / out.sum(1, keepdims=True)


def fit(m: np.ndarray, k: int, parts: int | None = None, target: float = TARGET, seed: int = 0) -> Index:
    """The index of a sample's rows."""
    m = np.unique(m, axis=0)  # copies say nothing about the graph
    n, d = m.shape
    reach = float(np.linalg.norm(m, axis=1).max())
    if parts is None:
        parts = 1 << max(0, int(np.log2(max(1, n // LEAST))))
    if parts == 1 or n < 4 * parts:
        return Index(np.zeros((d + 2, 1)), np.zeros((d + 1, 1)), reach, 1)
    near = neighbours(m, min(max(NEIGHBOURS, k), n - 1))
    label = partition_graph(near[:, :NEIGHBOURS], parts, seed)
    # own partition counts as two neighbours
    place = softmax(lifted(m, reach), shares(np.hstack([label[:, None], label[:, None], label[near[:, :NEIGHBOURS]]]), parts))
    index = Index(place, np.zeros((d + 1, parts)), reach, 1)
    at = index.partition(m)[near[:, : min(k, n - 1)]]
    index = replace(index, ask=softmax(unit(m), shares(at, parts)))
    # probes: the rank, among a query's partitions, of those of its true neighbours; a sample is sparser than all rows
    rank = np.argsort(np.argsort(-index.logits(m), 1, kind="stable"), 1)
    found = np.take_along_axis(rank, at, 1)
    return replace(index, probes=next(p for p in range(1, parts + 1) if (found < p).mean() >= target))


def calibrated(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, index: Index, k: int) -> Index:
    """``index`` with as many probes, its own at least, as find TARGET of the true neighbours of ASKED queries among all rows."""
    parts = index.ask.shape[1]
    if index.probes == parts:
        return index
    asked = np.random.default_rng(0).permutation(len(ids))[:ASKED]
    ranks = np.argsort(np.argsort(-index.logits(queries[asked]), 1, kind="stable"), 1)
    found = vectors.merged(rows.mapInArrow(scan(ids[asked], queries[asked], replace(index, probes=parts), k, ranks), vectors.FOUND), k)
    at = np.array([r["vec_id"] for r in found.select("vec_id").collect()])  # ASKED * k rows at most
    return replace(index, probes=next(p for p in range(index.probes, parts + 1) if p == parts or (at < p).mean() >= TARGET)) if len(at) else index


def scan(query_ids: np.ndarray, queries: np.ndarray, index: Index, k: int, ranks: np.ndarray | None = None):
    """With ``ranks`` (queries x partitions), the rank of a found row's partition stands in place of its vec_id."""
    d = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = vectors.TopK(len(query_ids), k)
        routed = index.route(queries)
        lists = [np.flatnonzero(routed[:, p]) for p in range(routed.shape[1])]
        size = 128
        for b in batches:
            ids, m = b.column("vec_id").to_numpy(), vectors.matrix(b.column("v"), d)
            at = 0
            while at < len(ids):
                own, rows = ids[at : at + size], m[at : at + size]
                at, size = at + size, min(2 * size, 4096)
                part = index.partition(rows)
                qs, cs = [], []
                for p in np.unique(part):
                    q = lists[p]
                    if not len(q):
                        continue
                    c = np.flatnonzero(part == p)
                    i, j = np.nonzero(rows[c] @ queries[q].T >= top.least[q] - 1e-9)
                    qs.append(q[j])
                    cs.append(c[i])
                if not qs:
                    continue
                q, c = np.concatenate(qs), np.concatenate(cs)
                scores = np.concatenate([(rows[c[x : x + 50_000]] * queries[q[x : x + 50_000]]).sum(1) for x in range(0, len(q), 50_000)] or [np.empty(0)])
                good = (own[c] != query_ids[q]) & (scores >= top.least[q])
                q, c = q[good], c[good]
                top.add(q, own[c] if ranks is None else ranks[q, part[c]], scores[good])
        yield vectors.batch(top, query_ids)

    return run


def sample(rows: DataFrame, total: int) -> np.ndarray:
    """A bounded number of vectors, by a hash of their id, in its order."""
    n = min(MOST, max(SAMPLE, int(8 * total**0.5)))
    pick = F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(1 << 20)) < F.lit(int(min(1.0, n / max(total, 1)) * (1 << 20)))
    return np.array([r["v"] for r in rows.filter(pick).orderBy("vec_id", "v").collect()], np.float64)  # about n rows


def search(df: DataFrame, is_query: Column, k: int, parts: int | None = None, said: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found, by inner product of the original vectors. ``said`` gets the index."""
    rows = vectors.clean(df, zero=False)
    total = rows.count()
    got = sample(rows, total)
    queries = rows.filter(is_query)
    if not len(got):
        return vectors.merged(rows.sparkSession.createDataFrame([], vectors.FOUND), k)
    index = fit(got, k, parts)
    blocks = vectors.query_blocks(queries)
    first = next(blocks, None)
    if first is None:
        return vectors.merged(rows.sparkSession.createDataFrame([], vectors.FOUND), k)
    index = calibrated(rows, *first, index, k)
    if said is not None:
        said["index"] = index
    every = index.ask.shape[1]
    found = vectors.merged(vectors.search(rows, chain([first], blocks), lambda i, q: scan(i, q, index, k)), k)
    if index.probes == every:
        return found
    found = materialise(found, "found")
    full = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = materialise(queries.join(full, "vec_id", "left_anti"), "short")
    again = vectors.merged(vectors.search(rows, vectors.query_blocks(short), lambda i, q: scan(i, q, replace(index, probes=every), k)), k)
    return found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(again)
