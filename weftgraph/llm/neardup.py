"""Near-duplicate documents by HyperMinHash, banded, estimated, then confirmed on full shingle sets.

One pass makes of each whole text its set of word shingles (64-bit hashes), a 128-bit signature of the set, a
HyperMinHash sketch (a register a bucket: leading zeros and mantissa of the bucket's least hash) and keys:

* sets of LONG shingles or more: one key for each band of ROWS cells of four buckets; a pair at the threshold of
  0.8 shares one with probability 1 - (1 - 0.8^6)^42 > 0.999997;
* smaller sets, whose registers are mostly empty: the hash space is cut in ranges, more of them than a linked
  pair's sets can differ in elements, and a key is a range's whole content. Size classes with a ratio of 1.25,
  two for each set, give a pair the same ranges; sets under 8 elements have keys of themselves less one element.

Equal sets become one node by their signatures. A key's group has a hub, its smallest node, and a node is
tried against the one hub with which it shares the most keys, not against all: the sketches' collision-corrected
Jaccard estimate drops pairs far below the threshold, the rest is confirmed on full sets, and links make
components. Groups that then still hold several components have the pairs between these estimated, in blocks, and
those near the threshold confirmed: no link between different sets that share a key is lost, and no task gets an
unbounded group.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; rows with a null
doc_id are linked with nothing (component null, kept); rows that repeat a doc_id are one node, each of them
gives a row; other columns are not read (``drop`` keeps them); no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, small_batches

ROWS, BANDS = 6, 42
REGISTERS = 4 * ROWS * BANDS
LONG = 160
#: Members of a group that are compared with one another in one task, and shingles of the documents confirmed in one.
CELL, CONFIRM = 512, 60_000
CACHE = 60_000
U = np.uint64
M1, M2, GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
SKETCH = "doc_id bigint, n bigint, s1 bigint, s2 bigint, keys array<bigint>, regs binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = x + GOLD
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


class Shingler:
    """Texts to sorted distinct 64-bit hashes of their shingles of ``k`` words."""

    def __init__(self, k: int) -> None:
        import xxhash

        digest = xxhash.xxh3_64_intdigest

        class Words(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = h = digest(word)
                return h

        self.k, self.words = k, Words()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, \x09-\x0D and space alone split
        if not words:
            return np.empty(0, U)
        if len(self.words) > CACHE:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, words), U, len(words))
        k = min(self.k, len(h))
        out = mix(h[: len(h) - k + 1] + U(k))
        for i in range(1, k):
            out = mix(out ^ h[i : len(h) - k + 1 + i])
        return np.unique(out)


def bucket(h: np.ndarray, n: int) -> np.ndarray:
    """floor(h * n / 2^64)"""
    high, low = (h >> U(32)) * U(n), (h & U(0xFFFFFFFF)) * U(n)
    return ((high + (low >> U(32))) >> U(32)).astype(np.int64)


def registers(h: np.ndarray) -> np.ndarray:
    """16-bit registers of sorted hashes; 0: empty."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(h):
        return out
    b = bucket(h, REGISTERS)
    first = np.flatnonzero(np.diff(b, prepend=-1))
    rest = h[first] * U(REGISTERS)  # modulo 2^64: the place within the bucket, least first
    zeros = 64 - np.frexp(np.maximum(rest, U(1)).astype(np.float64))[1]
    zeros = np.clip(zeros, 0, 62)
    mantissa = (rest << (zeros + 1).astype(U)) >> U(54)
    out[b[first]] = (zeros + 1).astype(np.uint16) << 10 | mantissa.astype(np.uint16)
    return out


def pack(r: np.ndarray) -> bytes:
    """Four bits of each: leading zeros (to 2) and 2 bits of mantissa; 0: empty."""
    c = np.where(r == 0, 0, 1 + np.minimum((r >> 10).astype(np.int64) - 1, 2) * 4 + ((r >> 8) & 3)).astype(np.uint8)
    return (c[0::2] << 4 | c[1::2]).tobytes()


def unpack(sketches: list[bytes]) -> np.ndarray:
    """A row of registers each, in an order of its own."""
    packed = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, REGISTERS // 2)
    return np.hstack([packed >> 4, packed & 15])


#: Chance that different elements make equal 4-bit registers: (1/4 + 1/16 + 1/16) for the zeros, times 1/4.
COLLISION = 0.09375


def estimate(equal: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Jaccard from equal and filled registers, without the collisions to expect."""
    share = equal / np.maximum(filled, 1)
    return (share - COLLISION) / (1 - COLLISION)


def least_estimate(filled: np.ndarray, threshold: float) -> np.ndarray:
    """Five deviations under the threshold: what a linked pair hardly falls short of."""
    return threshold - 5 * np.sqrt(threshold * (1 - threshold) / np.maximum(filled, 1)) - 2 / np.maximum(filled, 1)


def may_reach(same: np.ndarray, filled: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """By the estimate, and by a bound that holds for sure: each register that differs takes an element that only one set has."""
    apart = (1 - threshold) / (1 + threshold) * sizes + 1e-9
    return (filled - same <= apart) & (estimate(same, filled) >= least_estimate(filled, threshold))


def size_class(n: int) -> int:
    k = 0
    while 1.25 ** (k + 1) <= n:
        k += 1
    return k


def _ranges(k: int) -> int:
    return max(8, int(np.ceil(1.25 * (int(0.25 * 1.25 ** (k + 1)) + 1))) + 2)


def keys(h: np.ndarray, regs: np.ndarray) -> np.ndarray:
    n = len(h)
    if not n:
        return np.empty(0, U)
    m = mix(h ^ U(0x5BD1E995))
    out = []
    if n <= 8:
        total = m.sum(dtype=U)
        if n <= 7:
            out.append(mix(np.array([total])))
        if 5 <= n <= 8:
            out.append(mix(total - m))
    k = size_class(n)
    for c in (k, k - 1):
        if c < 9 or 1.25**c >= LONG:
            continue
        b = bucket(h, _ranges(c))
        first = np.flatnonzero(np.diff(b, prepend=-1))
        out.append(mix(np.add.reduceat(m, first) ^ mix(b[first].astype(U) + U(1000 * (c + 1)))))
    if 1.25**k >= LONG:
        cells = regs.reshape(-1, 4)
        at = (cells > 0).argmax(1)  # the least hash of four buckets is in the first that is filled
        bands = np.where(cells.any(1), cells[np.arange(len(cells)), at].astype(U) + (at.astype(U) << U(16)), U(0)).reshape(BANDS, ROWS)
        x = np.full(BANDS, U(7)) + np.arange(BANDS, dtype=U)
        for i in range(ROWS):
            x = mix(x ^ bands[:, i])
        out.append(x[bands.any(1)])
    return np.concatenate(out) if out else np.empty(0, U)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(k)
        for b in batches:
            n, s1, s2, ks, rs = [], [], [], [], []
            for text in b.column("text").to_pylist():
                h = shingles(text)
                regs = registers(h)
                n.append(len(h))
                s1.append(int(mix(h).sum(dtype=U).astype(np.int64)))
                s2.append(int(mix(h ^ M1).sum(dtype=U).astype(np.int64)))
                ks.append(keys(h, regs).astype(np.int64))
                rs.append(pack(regs))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ks])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ks, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), lists, pa.array(rs, pa.binary())], names=["doc_id", "n", "s1", "s2", "keys", "regs"])

    return run


def sketch(docs: DataFrame, k: int) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lean(_sketch(k)), SKETCH)


def _estimated(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = unpack(b.column("rx").to_pylist()), unpack(b.column("ry").to_pylist())
            filled = ((x > 0) | (y > 0)).sum(1)
            sizes = b.column("na").to_numpy() + b.column("nb").to_numpy()
            keep = may_reach(((x == y) & (x > 0)).sum(1), filled, sizes, threshold)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return run


def near_enough(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Those of (a, b) whose sizes and sketches allow the threshold."""
    one = sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("rx"))
    two = sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("ry"))
    # merge joins at every size: a broadcast that only small inputs allow would hide what large ones move
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").filter((F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9))
    return both.select("a", "b", "na", "nb", "rx", "ry").mapInArrow(lean(_estimated(threshold)), "a bigint, b bigint")


def _confirm(k: int, percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shingles = Shingler(k)
        hub = key[0].as_py()
        own, rest = [], []
        for doc, text in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True):
            (own if doc == hub else rest).append((doc, text))
        sets = [shingles(t) for _, t in own]
        found = set()
        for doc, text in rest:
            h = shingles(text)
            for s in sets:
                same = len(np.intersect1d(s, h, assume_unique=True))
                if 100 * same >= percent * (len(s) + len(h) - same) > 0:
                    found.add(doc)
        out = sorted(found)
        return pa.table({"a": pa.array([hub] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    return run


def confirm(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. A pair's a is sent once to each cell of its partners."""
    sized = pairs.join(sketches.select(F.col("doc_id").alias("b"), "n"), "b").groupBy("a", "b").agg(F.max("n").alias("n"))
    sized = materialise(sized, "sized")
    cells = sized.groupBy("a").agg(F.ceil(F.sum("n") / CONFIRM).cast("int").alias("cells"), F.count("*").alias("_n"))
    spread = cells.select("a", "cells").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    hubs = spread.select(F.col("a").alias("doc_id"), "a", "cell")
    # how many cells a hub has comes by a second join, not by a window over its partners
    mine = sized.join(cells.select("a", "cells"), "a").select(F.col("b").alias("doc_id"), "a", F.pmod(F.xxhash64("b"), F.col("cells")).cast("int").alias("cell"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sent = hubs.unionByName(mine).join(texts.hint("merge"), "doc_id").select("a", "cell", "doc_id", "text")
    return sent.groupBy("a", "cell").applyInArrow(_confirm(k, percent), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b), for ids that have links."""
    ends = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ends")
    label = materialise(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "label")
    while True:
        by = label.select(F.col("id").alias("b"), F.col("component").alias("m"))
        seen = ends.join(by, "b").groupBy("a").agg(F.min("m").alias("m")).select(F.col("a").alias("id"), "m")
        near = label.join(seen, "id").select("id", F.col("component").alias("was"), F.least("component", "m").alias("now"))
        jump = label.select(F.col("id").alias("now"), F.col("component").alias("far"))
        new = near.join(jump, "now").select("id", "was", F.least("now", "far").alias("component"))
        new = materialise(new, "label")
        changed = new.filter("was <> component").limit(1).count()
        label = new.select("id", "component")
        if not changed:
            return label


def _block(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        chunk = table.column("chunk").to_numpy()
        ids, comp, n = (table.column(c).to_numpy() for c in ("doc_id", "component", "n"))
        regs, prior = unpack(table.column("regs").to_pylist()), [frozenset(p) for p in table.column("prior").to_pylist()]
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        out = []
        for x in left:
            y = right[right > x] if i == j else right
            y = y[(comp[y] != comp[x]) & (np.minimum(n[y], n[x]) >= threshold * np.maximum(n[y], n[x]) - 1e-9)]
            if len(y):
                filled = ((regs[y] > 0) | (regs[x] > 0)).sum(1)
                y = y[may_reach(((regs[y] == regs[x]) & (regs[x] > 0)).sum(1), filled, n[y] + n[x], threshold)]
                # a pair that shares an earlier open key is told there
                out += [(min(ids[x], ids[z]), max(ids[x], ids[z])) for z in y if prior[x].isdisjoint(prior[z])]
        out = sorted(set(out))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def rest_pairs(grouped: DataFrame, comp: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different components in one key's group that may be linked."""
    named = grouped.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    named = materialise(named, "named")
    mark = F.xxhash64("doc_id").cast("decimal(38,0)")
    parts = named.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum(mark).alias("m"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    groups = parts.groupBy("key").agg(F.sum("n").alias("size"), F.count("*").alias("parts"), F.sum("m").alias("m"), F.min("a").alias("a"), F.max("b").alias("b"), F.max(F.struct("n", "component")).alias("main"))
    # groups of the same members are one: by their size and sum of marks
    open_ = groups.filter("parts > 1").groupBy("size", "m").agg(F.min(F.struct("key", "a", "b", "main")).alias("g")).select("size", "g.*")
    chunks = lambda n: F.ceil(n / CELL).cast("int")
    open_ = materialise(open_.select("key", "size", "a", "b", F.col("main.component").alias("main"), chunks(F.col("main.n")).alias("own"), chunks(F.col("size") - F.col("main.n")).alias("rest")), "open")
    pairs = near_enough(open_.filter("size = 2").select("a", "b").distinct(), sketches, threshold)
    large = open_.filter("size > 2").select("key", "main", "own", "rest")
    # a member's open keys, at most as many as it has keys, and with each those before it
    inside = named.join(large, "key").groupBy("doc_id", "component").agg(F.array_sort(F.collect_set(F.struct("key", "main", "own", "rest"))).alias("ks"))
    members = inside.join(sketches.select("doc_id", "n", "regs").hint("merge"), "doc_id")
    members = members.select("doc_id", "component", "n", "regs", F.transform("ks", lambda k: k["key"]).alias("all"), F.posexplode("ks").alias("pos", "k"))
    members = members.select("doc_id", "component", "n", "regs", "k.*", F.slice("all", F.lit(1), F.col("pos")).alias("prior"))
    # chunks of the largest component come after the others' and never meet one another: they hold no pair to try
    is_main = F.col("component") == F.col("main")
    spot = F.xxhash64("doc_id", F.lit(3))
    members = members.withColumn("chunk", F.when(is_main, F.col("rest") + F.pmod(spot, F.col("own"))).otherwise(F.pmod(spot, F.col("rest"))).cast("int"))
    last = F.when(is_main, F.col("rest")).otherwise(F.col("rest") + F.col("own")) - 1
    cells = members.select("key", "doc_id", "component", "n", "regs", "prior", "chunk", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    cells = cells.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")).drop("other")
    return cells.groupBy("key", "i", "j").applyInArrow(_block(threshold), "a bigint, b bigint").unionByName(pairs).distinct()


def classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document; ``percent`` of the union must be shared."""
    threshold = percent / 100
    sk = materialise(sketch(docs, k), "sketch")
    full = sk.filter("n > 0 and doc_id is not null")
    same = full.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).filter("c > 1")
    same = materialise(same.select("s1", "s2", "n", "rep"), "same")
    text = ["doc_id", "s1", "s2", "n"]
    copies = full.select(*text).join(same, ["s1", "s2", "n"]).filter("doc_id <> rep").select(*text, "rep")
    copies = materialise(copies.distinct(), "copies")
    # a repeated doc_id is a copy by one text and may be a node by another
    nodes = full.join(copies.select(*text), text, "left_anti")
    rows = nodes.select("doc_id", F.explode("keys").alias("key"))
    hubs = rows.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("most")).filter("hub <> most")
    hubs = materialise(hubs.select("key", "hub"), "hubs")
    grouped = materialise(rows.join(hubs, "key").select("key", "doc_id", "hub"), "grouped")
    shared = grouped.filter("doc_id <> hub").groupBy("doc_id", "hub").count()
    tried = shared.groupBy("doc_id").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("a")).select("a", F.col("doc_id").alias("b"))
    tried = materialise(tried, "tried")
    both = copies.join(nodes.select("doc_id"), "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = materialise(confirm(near_enough(tried, full, threshold), docs, full, k, percent).unionByName(both).distinct(), "links")
    comp = components(links)
    more = rest_pairs(grouped.select("key", "doc_id").distinct(), comp, full, threshold)
    more = materialise(more.join(tried, ["a", "b"], "left_anti"), "more")
    if more.limit(1).count():
        late = materialise(confirm(more, docs, full, k, percent), "links")
        if late.limit(1).count():
            comp = components(links.unionByName(late))
    named = copies.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    named = named.unionByName(comp.select(F.col("id").alias("doc_id"), "component")).groupBy("doc_id").agg(F.min("component").alias("component"))
    out = sk.select("doc_id", "n").join(named, "doc_id", "left")
    cid = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), cid.alias("component_id"), F.coalesce(F.col("doc_id") == cid, F.lit(True)).alias("kept"))


def drop(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without those whose group has a smaller doc_id."""
    gone = materialise(classes(docs, k, percent).filter("not kept").select(F.col("doc_id").alias("_gone")), "gone")
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["_gone"], "left_anti")
