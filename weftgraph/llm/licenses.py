"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment.

Templates' word trigrams are winnowed (the least hash in each window of WINDOW stands for it) into an index of
bounded size: it depends on the templates alone. Every trigram of a whole text is looked up there, so a run of
WINDOW + 2 words that text and template share is always found. Hits on nearby diagonals make a candidate place,
and a banded local alignment of the template there gives matched words, coverage and span.

Defined results: null and empty texts give no rows; each place of a template gives a row, repeated ones too, but of
places that overlap by more than half the best one;
null or repeated doc_ids are handed through; other columns are not read; no templates or documents give no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches
from .license_texts import TEMPLATES

WORD = re.compile(r"[^\W_]+")
GRAM, WINDOW, BAND = 3, 2, 8
CACHE = 60_000
FOUND = "doc_id bigint, license string, coverage double, matched int, template_words int, start_char bigint, end_char bigint"

def words(text: str) -> list[str]:
    """In lower case, each by itself: a letter whose lower case has another length moves no place."""
    return [w.lower() for w in WORD.findall(text)]


def winnow(codes: list[int], base: int) -> list[tuple[int, int]]:
    """(trigram, position) of the fingerprints."""
    grams = [(codes[i] * base + codes[i + 1]) * base + codes[i + 2] for i in range(len(codes) - GRAM + 1)]
    hashed = [zlib.crc32(str(g).encode()) for g in grams]
    picked = {min(range(i, min(i + WINDOW, len(grams))), key=lambda p: (hashed[p], -p)) for i in range(max(1, len(grams) - WINDOW + 1))} if grams else set()
    return [(grams[p], p) for p in sorted(picked)]


class Index:
    """Trigram -> places in templates."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = sorted(templates)
        split = [words(templates[n]) for n in self.names]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for t in split for w in t}))}
        self.base = len(self.vocabulary) + 1
        self.texts = [[self.vocabulary[w] for w in t] for t in split]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, codes in enumerate(self.texts):
            for gram, p in winnow(codes, self.base):
                self.places[gram].append((t, p))
        self.grams = np.array(sorted(self.places), np.int64)

    def hits(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, place in it, place in the text)"""
        if len(codes) < GRAM or not len(self.grams):
            return []
        at = np.flatnonzero((codes[:-2] > 0) & (codes[1:-1] > 0) & (codes[2:] > 0))
        if not len(at):
            return []
        g = (codes[at] * self.base + codes[at + 1]) * self.base + codes[at + 2]
        i = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
        return [(t, p, int(x)) for x, gram in zip(at[self.grams[i] == g], g[self.grams[i] == g], strict=True) for t, p in self.places[int(gram)]]


def align(template: list[int], text: np.ndarray, offset: int, band: int = BAND) -> tuple[int, int, int]:
    """Best local alignment of the template near text[offset:]: matched words, first and last + 1 place in the text."""
    best = (0, 0, 0, 0)
    before: dict[int, tuple[int, int, int, int]] = {}  # place in text -> score, matched, first, last
    for i, w in enumerate(template):
        now: dict[int, tuple[int, int, int, int]] = {}
        for j in range(max(0, offset + i - band), min(len(text), offset + i + band + 1)):
            s, m, a, z = before.get(j - 1, (0, 0, j, j))
            same = text[j] == w
            options = [(s + 2, m + 1, a if m else j, j + 1)] if same else [(s - 1, m, a, z)]
            if j in before:
                s, m, a, z = before[j]
                options.append((s - 1, m, a, z))
            if j - 1 in now:
                s, m, a, z = now[j - 1]
                options.append((s - 1, m, a, z))
            top = max(options, key=lambda o: (o[0], o[1]))
            if top[0] > 0:
                now[j] = top
                if (top[0], top[1]) > (best[0], best[1]):
                    best = top
        before = now
    return best[1:]


def scan_codes(index: Index, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(template, matched, first, last + 1) of the places that reach least_coverage()."""
    starts: dict[int, list[int]] = defaultdict(list)
    for t, p, x in index.hits(codes):
        starts[t].append(x - p)
    out = []
    for t, all_starts in sorted(starts.items()):
        last = None
        band = min(BAND, len(index.texts[t]) // 2)  # less than the distance of two places of a short template
        for s in sorted(set(all_starts)):
            if last is not None and s - last <= band:
                continue  # within the band of the place before
            last = s
            matched, a, z = align(index.texts[t], codes, s, band)
            if matched >= least_coverage(len(index.texts[t])) * len(index.texts[t]):
                out.append((t, matched, a, z))
    return sorted(alone(set(out), [len(t) for t in index.texts]), key=lambda x: (x[2], x[0]))


def alone(places: set[tuple[int, int, int, int]], sizes: list[int]) -> list[tuple[int, int, int, int]]:
    """Of places that share more than half of the shorter one's words, the one with most matched words times coverage: a notice, not
    the line in it, and of two versions the nearer one."""
    kept: list[tuple[int, int, int, int]] = []
    starts: list[int] = []
    reach = max((z - a for _, _, a, z in places), default=0)
    for p in sorted(places, key=lambda x: (-x[1] * x[1] / sizes[x[0]], x[2], x[0])):
        _, _, a, z = p
        near = kept[bisect_left(starts, a - reach) : bisect_left(starts, z)]
        if all(2 * (min(z, e) - max(a, b)) <= min(z - a, e - b) for _, _, b, e in near):
            at = bisect_left(starts, a)
            starts.insert(at, a)
            kept.insert(at, p)
    return kept


def least_coverage(n: int) -> float:
    """Short templates must be there almost whole."""
    return 0.8 if n < 20 else 0.6


def _scan(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        vocabulary = index.vocabulary
        spans: list[list[int]] = []  # of tokens that hold several words

        class Codes(dict):
            def __missing__(self, token: str) -> int:
                w = [vocabulary.get(x, 0) for x in words(token)]
                code = w[0] if len(w) == 1 else 0
                if len(w) != 1:
                    spans.append(w)
                    code = -len(spans)
                self[token] = code
                return code

        cache = Codes()
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                tokens = text.split() if text else []
                if not tokens:
                    continue
                if len(cache) > CACHE:
                    cache.clear()
                    spans.clear()
                codes = np.fromiter(map(cache.__getitem__, tokens), np.int64, len(tokens))
                if (codes < 0).any():
                    lists = [spans[-c - 1] if c < 0 else [c] for c in codes.tolist()]
                    codes = np.fromiter((c for x in lists for c in x), np.int64)
                found = scan_codes(index, codes)
                if found:
                    places = [m.span() for m in WORD.finditer(text)]
                    for t, matched, a, z in found:
                        size = len(index.texts[t])
                        rows.append((doc, index.names[t], matched / size, matched, size, places[a][0], places[z - 1][1]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "license", "coverage", "matched", "template_words", "start_char", "end_char"])

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each place of a template: coverage, matched words and span in characters."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lean(_scan(TEMPLATES if templates is None else templates)), FOUND)
