"""A term dictionary: alias to canonical term, as a small frame keyed by the lower-case alias.

A dictionary is kept by people; its size is checked against MAX_TERMS before it goes into patterns or broadcasts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.schemas import Graph

MAX_TERMS = 20_000


def bulk_import(known: DataFrame, rows: DataFrame) -> DataFrame:
    """(alias, canonical, change) after the import of rows (alias, canonical, ord): the last row of an alias holds."""
    key = F.lower(F.trim("alias"))
    fit = rows.filter("trim(coalesce(alias, '')) <> '' and trim(coalesce(canonical, '')) <> ''")
    last = fit.withColumn("key", key).groupBy("key").agg(F.max_by(F.struct("alias", "canonical"), "ord").alias("n"))
    have = known.select(F.lower("alias").alias("key"), F.struct("alias", "canonical").alias("o"))
    change = F.when(F.col("n").isNull() | F.col("o.canonical").eqNullSafe(F.col("n.canonical")), "kept").when(F.col("o").isNull(), "inserted").otherwise("updated")
    both = have.join(last, "key", "full_outer").withColumn("change", change)
    pick = F.coalesce("n", "o")
    return both.select(pick["alias"].alias("alias"), pick["canonical"].alias("canonical"), "change")


def terms(dictionary: DataFrame) -> list[tuple[str, str]]:
    """Longest alias first."""
    rows = dictionary.select("alias", "canonical").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"over {MAX_TERMS} terms: split the dictionary")
    return sorted(((r["alias"], r["canonical"]) for r in rows), key=lambda r: (-len(r[0]), r[0]))


def _bounded(alias: str) -> str:
    """The alias as whole words."""
    return rf"(?<![\p{{L}}\p{{N}}_]){re.sub(r'([^A-Za-z0-9가-힣 ])', r'\\\1', alias)}(?![\p{{L}}\p{{N}}_])"


def normalize_query(query: Column, entries: list[tuple[str, str]], mode: str = "expand") -> Column:
    """expand: the query, then the canonical terms of aliases that it holds and that it doesn't have yet; replace: in place."""
    if mode == "replace":
        out = query
        for alias, canonical in entries:
            out = F.regexp_replace(out, f"(?i){_bounded(alias)}", canonical.replace("\\", "\\\\").replace("$", "\\$"))
        return out
    found = [F.when(query.rlike(f"(?i){_bounded(a)}") & ~F.contains(F.lower(query), F.lit(c.lower())), c) for a, c in entries]
    extra = F.array_distinct(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")
    return F.when(F.size(extra) > 0, F.concat_ws(" ", query, F.array_join(extra, " "))).otherwise(query)


def normalize_text(text: Column, entries: list[tuple[str, str]]) -> Column:
    """Every place of an alias becomes alias(canonical), unless it is that already; longest alias first."""
    plain = lambda t: t.replace("\\", "\\\\").replace("$", "\\$")
    out = text
    for alias, canonical in sorted(entries, key=lambda e: (-len(e[0]), e[0])):
        done = re.sub(r"([^A-Za-z0-9가-힣 ])", r"\\\1", canonical)
        out = F.regexp_replace(out, f"(?i){_bounded(alias)}(?!\\({done}\\))", plain(f"{alias}({canonical})"))
    return out


def apply_to_build(g: Graph, dictionary: DataFrame) -> Graph:
    """Renames aliases in every column that holds a name."""
    entries = dict((a.lower(), c) for a, c in terms(dictionary))
    if not entries:
        return g
    table = F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
    rename = lambda c: F.coalesce(F.try_element_at(table, F.lower(F.col(c))), F.col(c)).alias(c)
    names = {
        "classes": ("name", "parent"), "object_props": ("domain", "range"), "data_props": ("domain",), "hierarchy": ("parent", "child"),
        "instances": ("name", "class_name"), "relations": ("subject", "object"), "data_values": ("entity",),
    }
    return g.map(lambda kind, df: df.select(*[rename(c) if c in names.get(kind, ()) else F.col(c) for c in df.columns]))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
