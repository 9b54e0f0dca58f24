"""Toxicity by a counterfactual-regularised linear classifier.

Features are a text's distinct words and word beginnings (4 to 6 letters); those that LEAST sampled texts have and whose
chi-square with the label passes CHI are fitted, however many. Logistic loss has an L1 term, and a
counterfactual term: sentences of the labelled sample that name a group are copied with the group swapped for
each other of its kind, and squared changes of the score are penalised, so that naming a group by itself does not
count. Fitting sees at most about SAMPLE labelled documents (a keyed hash of doc_id picks them), which are read and
written once; scoring runs over every whole text.

Defined results: null and empty texts get the score of a text without features; null doc_id rows are scored
(held_out null) and never fitted; repeated rows give repeated rows; without usable labels of both kinds every
score is 0; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, small_batches

#: Labelled documents to fit on, about: the bound of what reaches the driver.
SAMPLE = 12_000
#: Sampled texts that have a feature, at least, and its chi-square with the label (0.05 of chance features pass).
LEAST, CHI = 3, 3.84
THRESHOLD = 0.7
LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"(?<=[.!?\n])\s+")
#: Swapped within a row; any of a row stands for any other.
GROUPS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "locals", "citizens"), ("mexicans", "americans", "chinese", "germans", "indians", "africans", "russians"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
CACHE = 50_000


def features(token: str) -> tuple[str, ...]:
    """Of one lower-case token between white space."""
    out = []
    for w in LETTERS.findall(token):
        out.append(w)
        out += [f"{w[:k]}*" for k in (4, 5, 6) if len(w) > k]
    return tuple(out)


def _hash(f: str) -> int:
    return zlib.crc32(f.encode())


def _hashes(text: str | None, cache: dict[str, tuple[int, ...]]) -> set[int]:
    out: set[int] = set()
    if len(cache) > CACHE:
        cache.clear()
    for t in set((text or "").lower().split()):
        ids = cache.get(t)
        if ids is None:
            ids = cache[t] = tuple(map(_hash, features(t)))
        out.update(ids)
    return out


def swaps(sentence: str, groups: tuple[tuple[str, ...], ...] = GROUPS) -> list[str]:
    """The sentence with each group it names swapped for each other one of that kind, in turn."""
    words = sentence.lower().split()
    kinds = {w: g for g in groups for w in g}
    named = {i: (bare, kinds[bare]) for i, w in enumerate(words) if (m := LETTERS.search(w)) and (bare := m[0]) in kinds}
    turns = max((len(g) for _, g in named.values()), default=1)

    def turned(step: int) -> str:
        out = list(words)
        for i, (bare, g) in named.items():
            other = 1 + (step - 1) % (len(g) - 1)  # never back to itself
            out[i] = out[i].replace(bare, g[(g.index(bare) + other) % len(g)], 1)
        return " ".join(out)

    return [turned(step) for step in range(1, turns)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, n, toxic) summed in the task."""
    cache: dict[str, tuple[int, ...]] = {}
    for b in batches:
        n: dict[int, int] = {}
        t: dict[int, int] = {}
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            for f in _hashes(text, cache):
                n[f] = n.get(f, 0) + 1
                if toxic:
                    t[f] = t.get(f, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.int64()), pa.array(n.values(), pa.int64()), pa.array([t.get(f, 0) for f in n], pa.int64())], names=["feature", "n", "toxic"])


def _rows(chosen: np.ndarray, groups: tuple[tuple[str, ...], ...]):
    """(toxic, ids, swapped): ids of chosen features, and those that each swap adds (id + 1) or removes (-id - 1), 0 between swaps."""
    chosen = np.sort(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}

        def ids(text: str | None) -> np.ndarray:
            h = np.sort(np.fromiter(_hashes(text, cache), np.int64))
            return np.searchsorted(chosen, h[np.isin(h, chosen, assume_unique=True)]) if len(h) else h

        for b in batches:
            out, changed = [], []
            for text in b.column("text").to_pylist():
                out.append(ids(text).astype("<i4").tobytes())
                diff: list[int] = []
                for s in SENTENCE.split(text or ""):
                    for other in swaps(s, groups):
                        one, two = set(ids(s).tolist()), set(ids(other).tolist())
                        diff += [i + 1 for i in two - one] + [-i - 1 for i in one - two] + [0]
                changed.append(np.array(diff, "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), pa.array(out, pa.binary()), pa.array(changed, pa.binary())], names=["toxic", "ids", "swapped"])

    return run


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[int, float]


def fit_rows(rows: list[tuple[int, np.ndarray, list[np.ndarray]]], width: int, fair: float = 1.0, l1: float = 1e-3, steps: int = 300) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient on logistic loss + l1 |w| + fair / 2 * mean squared change of score by a swap."""
    y = np.array([r[0] for r in rows], float)
    col = np.concatenate([r[1] for r in rows] or [np.empty(0, int)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    diffs = [d for r in rows for d in r[2] if len(d)]
    dcol = np.abs(np.concatenate(diffs)) - 1 if diffs else np.empty(0, np.int64)
    dval = np.sign(np.concatenate(diffs)).astype(float) if diffs else np.empty(0)
    drow = np.repeat(np.arange(len(diffs)), [len(d) for d in diffs]) if diffs else np.empty(0, np.int64)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    w, bias, v, vb, t = np.zeros(width), 0.0, np.zeros(width), 0.0, 1.0
    x = np.random.default_rng(0).standard_normal(width)
    for _ in range(12):  # largest eigenvalue of the smooth part, by power iteration
        z = np.bincount(row, x[col], len(rows))
        g = np.bincount(col, (0.25 * weight * z)[row], width)
        if diffs:
            g += fair / len(diffs) * np.bincount(dcol, dval * np.bincount(drow, dval * x[dcol], len(diffs))[drow], width)
        top = np.linalg.norm(g)
        x = g / max(top, 1e-12)
    step = 1 / (2.2 * top + 0.5)
    for _ in range(steps):
        z = np.bincount(row, v[col], len(rows)) + vb
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(col, e[row], width)
        if diffs:
            g += fair / len(diffs) * np.bincount(dcol, dval * np.bincount(drow, dval * v[dcol], len(diffs))[drow], width)
        new, nb = v - step * g, vb - step * e.sum()
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - bias)
        w, bias, t = new, nb, t2
    return bias, w


def is_training(doc_id):  # noqa: ANN001, ANN201
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fair: float = 1.0, groups: tuple[tuple[str, ...], ...] = GROUPS) -> Model | None:
    """Fits on labelled rows outside the held-out fold; None without labels of both kinds."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & is_training(F.col("doc_id"))).select("doc_id", "toxic")
    total = known.count()
    share = min(1.0, sample / max(total, 1))
    pick = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    rows = docs.filter(pick).select("doc_id", "text").join(known.filter(pick), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    rows = materialise(rows, "sample")
    n, pos = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not pos or pos == n:
        return None
    f, a = F.col("n").cast("double"), F.col("toxic").cast("double")
    chi = (a - f * pos / n) ** 2 / (f * pos / n) + (a - f * pos / n) ** 2 / (f * (n - pos) / n)
    counts = rows.mapInArrow(lean(_counted), "feature bigint, n bigint, toxic bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    top = counts.filter(F.col("n") >= LEAST).filter(chi >= CHI).select("feature").collect()  # of the bounded sample
    chosen = np.sort(np.array([r[0] for r in top], np.int64))
    got = rows.mapInArrow(lean(_rows(chosen, groups)), "toxic int, ids binary, swapped binary").collect()  # about ``sample`` rows of feature ids
    data = []
    for r in got:
        d = np.frombuffer(r["swapped"], "<i4").astype(np.int64)
        data.append((r["toxic"], np.frombuffer(r["ids"], "<i4"), [q for p in np.split(d, np.flatnonzero(d == 0) + 1) if len(q := p[p != 0])]))
    data.sort(key=lambda r: (r[0], r[1].tobytes()))  # the order of arrival must not change the sums
    bias, w = fit_rows(data, len(chosen), fair)
    return Model(float(bias), {int(chosen[i]): float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-6)})


def _scored(model: Model | None, keep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        weights = model.weights if model else {}
        for b in batches:
            scores = []
            for text in b.column("text").to_pylist():
                if model is None:
                    scores.append(0.0)
                    continue
                if len(cache) > CACHE:
                    cache.clear()
                hit: set[int] = set()
                for t in set((text or "").lower().split()):
                    ids = cache.get(t)
                    if ids is None:
                        ids = cache[t] = tuple(h for h in map(_hash, features(t)) if h in weights)
                    if ids:
                        hit.update(ids)
                z = model.bias + math.fsum(weights[h] for h in hit)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            rest = b.columns if keep else [b.column("doc_id")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(scores, pa.float64())], names=[*(b.schema.names if keep else ["doc_id"]), keep or "score"])

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of every whole text."""
    return docs.select(F.col("doc_id"), "text").mapInArrow(lean(_scored(model, "")), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def reject(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under ``threshold``, with all their columns."""
    from pyspark.sql.types import DoubleType, StructType

    name = "_score"
    while name in docs.columns:
        name += "_"
    schema = StructType([*docs.schema.fields]).add(name, DoubleType())
    return docs.mapInArrow(lean(_scored(model, name)), schema).filter(F.col(name) < threshold).drop(name)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (~is_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
