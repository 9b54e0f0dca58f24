"""Record layouts. Frames have no order, so every graph table carries ``ord`` and "first" means the least of it."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import settle

LAYOUT = {
    "classes": "name string, description string, parent string, source string, source_chunks array<string>, ord bigint",
    "object_props": "name string, domain string, range string, description string, ord bigint",
    "data_props": "name string, domain string, range string, display_name string, ord bigint",
    "hierarchy": "parent string, child string, ord bigint",
    "instances": "name string, class_name string, identity string, source_chunks array<string>, ord bigint",
    "relations": "subject string, predicate string, object string, predicate_type string, label string, weight double, source_chunks array<string>, ord bigint",
    "data_values": "entity string, property string, value string, value_type string, source_chunks array<string>, ord bigint",
    "chunks": "id string, doc string, text string, chunk_index int, entities array<string>, embedding array<float>, meta map<string,string>",
    "enriched": "chunk_id string",
    "translations": "name string, translation string",
    "uris": "name string, kind string, uri string",
}
TRIPLE = "s string, p string, o string, o_is_literal boolean, datatype string, lang string"
NODE = "id string, label string, kind string"


@dataclass(frozen=True)
class Graph:
    """A stage takes a Graph and gives a Graph."""

    classes: DataFrame
    object_props: DataFrame
    data_props: DataFrame
    hierarchy: DataFrame
    instances: DataFrame
    relations: DataFrame
    data_values: DataFrame
    chunks: DataFrame
    enriched: DataFrame
    translations: DataFrame
    uris: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.instances.sparkSession

    def with_(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)

    def map(self, f) -> Graph:  # noqa: ANN001
        """``f`` of each (name, table)."""
        return Graph(**{x.name: f(x.name, getattr(self, x.name)) for x in fields(self)})


def settled(g: Graph) -> Graph:
    """``g`` with its statements written and read again, so that the next stage plans from tables; the rest is small or read as it is."""
    names = ("classes", "hierarchy", "object_props", "data_props", "instances", "relations", "data_values")
    with ThreadPoolExecutor(len(names)) as pool:  # independent jobs
        return g.with_(**dict(zip(names, pool.map(lambda k: settle(getattr(g, k), k), names), strict=True)))


def empty(spark: SparkSession) -> Graph:
    return Graph(**{k: spark.createDataFrame([], v) for k, v in LAYOUT.items()})


def conform(df: DataFrame, kind: str) -> DataFrame:
    """Columns of the layout, in its order and types; those that are missing are null."""
    out = []
    for part in _split(LAYOUT[kind]):
        name, _, typ = part.partition(" ")
        out.append((F.col(name) if name in df.columns else F.lit(None)).cast(typ).alias(name))
    return df.select(*out)


def _split(layout: str) -> list[str]:
    parts, depth, cur = [], 0, ""
    for ch in layout:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*parts, cur.strip()]


def graph(spark: SparkSession, **tables: DataFrame) -> Graph:
    """A Graph of the given tables; the rest is empty."""
    return empty(spark).with_(**{k: conform(v, k) for k, v in tables.items()})


def place(*columns: str) -> Column:
    """An ``ord`` by content, for rows that come in no order: small enough for what stages add to it."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40))


def evidence(g: Graph) -> DataFrame:
    """(name, chunk_id): what chunks state a name, by itself, its relations or its values."""
    own = lambda df, col: df.select(F.col(col).alias("name"), F.explode("source_chunks").alias("chunk_id"))
    object_relations = g.relations.filter("coalesce(predicate_type, '') <> 'DatatypeProperty'")
    parts = [own(g.instances, "name"), own(g.classes, "name"), own(object_relations, "subject"), own(object_relations, "object"), own(g.data_values, "entity")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("name <> '' and chunk_id <> ''").distinct()
