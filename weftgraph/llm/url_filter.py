"""Exact URL lists by cascades of Bloom filters, with DataFrame functions alone.

Level 0 encodes the listed keys. Level 1 encodes those unlisted keys of the corpus that pass level 0, level 2
the listed keys that pass level 1, and so on until nothing is left. As the levels are built over every key
that the corpus holds, walking them gives exact membership for it, with no join, neither in the walk nor in the
build: what passes level 0 is told from the list by grouping both together.

A url's keys are its host's suffixes (of as many labels as some rule has) before its path's prefixes (of as
many characters as some rule has), so rules fit a host, its subdomains and paths that start with theirs.

A level's bits are one row of a written table, met as a scalar subquery: they pass the driver's JVM once and are shared
by a plan's expressions. A level has at most MAX_BITS; a longer list is cut by a hash of the key into parts with a
cascade each, and parts are walked in turn over the written pages, so memory stays bounded for lists of any length.

Defined results: a null url or one without ``://`` has an empty host and path, and no rule fits it; page_id
may be null or repeated, each row gives a row; no pages give no rows.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Bits of a level (4 MB), those of a word, and levels of a cascade: each holds about a quarter of the one two before.
MAX_BITS, WORD, MAX_LEVELS = 1 << 25, 64, 64


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path, both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def candidate_keys(host: Column, path: Column, rules: list[str]) -> list[Column]:
    """The longest first: the key of each shape (labels, path's length) that some rule has; null where the url is shorter."""
    shapes = {(h.count(".") + 1, len(p)) for h, p in map(split_rule, rules)}
    labels = F.split(host, r"\.")
    keys = []
    for depth, length in sorted(shapes, reverse=True):
        suffix = F.when(F.size(labels) >= depth, F.substring_index(host, ".", -depth))
        prefix = F.when(F.length(path) >= length, F.substring(path, 1, length))
        keys.append(F.when(host != "", F.concat(suffix, prefix)))
    return keys


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: DataFrame  # one row, one array

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed * 31 + i)), F.lit(self.bits)) for i in range(self.hashes)]

    def has(self, key: Column) -> Column:
        words = self.words.scalar()
        test = F.lit(True)
        for p in self.positions(key):
            test = test & (F.getbit(F.get(words, F.floor(p / WORD).cast("int")), (p % WORD).cast("int")) == 1)
        return test


def _bits(n: int, rate: float) -> int:
    return max(64, WORD * math.ceil(n * -math.log(rate) / math.log(2) ** 2 / WORD))


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    bits = _bits(n, rate)
    hashes = max(1, round(bits / max(n, 1) * math.log(2))) if n and bits > 64 else max(1, round(-math.log2(rate)))
    shape = Level(bits, hashes, seed, keys)
    at = keys.select(F.explode(F.array(*shape.positions(F.col("key")))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % WORD).cast("int"))
    set_ = at.select(F.floor(F.col("p") / WORD).cast("bigint").alias("w"), bit.alias("b"))
    words = set_.unionByName(keys.sparkSession.range(bits // WORD).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b")))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b"))
    row = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))  # bits / WORD entries
    return Level(bits, hashes, seed, materialise(row, "bits"))


def build(universe: DataFrame, listed: list[str] | DataFrame) -> list[list[Level]]:
    """Cascades, one for each part of the list, exact for every ``key`` of ``universe``; its keys may repeat and be null.

    ``listed``: keys, as a list or as a frame with a column ``key``.
    """
    spark = universe.sparkSession
    inside = listed if isinstance(listed, DataFrame) else spark.createDataFrame([(k,) for k in listed], "key string")
    inside = materialise(inside.select("key").filter("key is not null").distinct(), "listed")
    n = inside.count()
    if not n:
        return []
    total = universe.select(F.approx_count_distinct("key", 0.02)).first()[0]
    rate = min(0.5, max(1e-9, n * math.sqrt(0.5) / max(total, 1)))
    parts = -(-_bits(n, rate) // MAX_BITS)
    if parts == 1:
        return [_cascade(universe, inside, n, rate)]
    own = [inside.filter(part_of(F.col("key"), parts) == i) for i in range(parts)]
    return [_cascade(universe.filter(part_of(F.col("key"), parts) == i), x, x.count(), rate) for i, x in enumerate(own)]


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))


def _cascade(universe: DataFrame, inside: DataFrame, n: int, rate: float) -> list[Level]:
    levels = [_level(inside, n, rate, 1)]
    # those that pass are about as few as the listed keys
    passed = universe.filter(F.col("key").isNotNull() & levels[0].has(F.col("key"))).select("key", F.lit(False).alias("mine"))
    told = passed.unionByName(inside.select("key", F.lit(True).alias("mine"))).groupBy("key").agg(F.bool_or("mine").alias("mine"))
    told = materialise(told, "passed")
    sides = [told.filter("not mine").select("key"), inside]
    while len(levels) < MAX_LEVELS:
        now = sides[(len(levels) - 1) % 2]
        for k in range((len(levels) + 1) % 2, len(levels), 2):  # of the other side's levels, all let it through
            now = now.filter(levels[k].has(F.col("key")))
        n = now.count()
        if not n:
            return levels
        levels.append(_level(now, n, 0.25, len(levels) + 1))
    raise RuntimeError("the cascade does not end: equal keys on both sides")


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Walks the levels: a key is listed if the first level that lacks it is an odd one, or it passes all of an odd number."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(~levels[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def marked(df: DataFrame, keys: list[str], cascades: list[list[Level]], flags: list[str]) -> DataFrame:
    """``df`` with a flag for each key column: whether it is listed. Several cascades go one after another, each over a written table."""
    parts = len(cascades)
    for f in flags:
        df = df.withColumn(f, F.lit(False))
    for i, levels in enumerate(cascades):
        mine = lambda k: F.col(k).isNotNull() & (part_of(F.col(k), parts) == i if parts > 1 else F.lit(True))  # noqa: B023, E731
        new = {f: F.when(mine(k), is_listed(F.col(k), levels)).otherwise(F.col(f)) for k, f in zip(keys, flags, strict=True)}
        df = df.withColumns(new)
        if parts > 1:
            df = materialise(df, "marked")
    return df


def judge(pages: DataFrame, block: list[str], allow: list[str], listed_hosts: list[str] | DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict): the longest rule that fits, else block for listed hosts and their subdomains, else allow.

    ``listed_hosts``: a list, or a frame with a column ``host`` (then of one to four labels).
    """
    host, path = parts(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    if isinstance(listed_hosts, DataFrame):
        shapes = ["a/", "a.a/", "a.a.a/", "a.a.a.a/"]
        spam_list: list[str] | DataFrame = listed_hosts.select(F.concat(F.lower("host"), F.lit("/")).alias("key"))
    else:
        spam_list = shapes = [f"{h}/" for h in listed_hosts]
    by_rule = candidate_keys(F.col("host"), F.col("path"), [*block, *allow])
    by_host = candidate_keys(F.col("host"), F.lit("/"), shapes)
    rule_keys, host_keys = [f"_r{i}" for i in range(len(by_rule))], [f"_h{i}" for i in range(len(by_host))]
    every = base.withColumns(dict(zip([*rule_keys, *host_keys], [*by_rule, *by_host], strict=True)))
    universe = lambda names: every.select(F.explode(F.array(*names)).alias("key")) if names else every.select(F.lit(None).cast("string").alias("key"))
    of = lambda names, tag: [f"{n}{tag}" for n in names]
    out = every
    for names, listed, tag in ((rule_keys, block, "b"), (rule_keys, allow, "a"), (host_keys, spam_list, "s")):
        out = marked(out, names, build(universe(names), listed) if names else [], of(names, tag))
    # keys come with the longest host first; the longest rule is the longest key
    fits = [F.struct(F.length(k).alias("n"), F.col(k).alias("rule"), F.col(f"{k}b").alias("block")) for k in rule_keys]
    held = [F.when(F.col(f"{k}a") | F.col(f"{k}b"), f) for k, f in zip(rule_keys, fits, strict=True)]
    none = F.lit(None).cast("struct<n:int,rule:string,block:boolean>")
    best = F.greatest(none, *held) if len(held) else none
    spam = F.lit(False)
    for k in host_keys:
        spam = spam | F.col(f"{k}s")
    verdict = F.when(best["rule"].isNotNull(), F.when(best["block"], "block").otherwise("allow")).when(spam, "block").otherwise("allow")
    return out.select("page_id", "host", "path", best["rule"].alias("rule"), verdict.alias("verdict"))
