"""Star-schema build: tables to classes, rows to instances, foreign keys to relations, other columns to values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.functions import values as V
from weftgraph.schemas import Graph, graph

REFERENCE_ROWS = 200
#: Marks the layout of identity payloads; set it to meet another system's identities.
IDENTITY = "weft-row-v1"


@dataclass
class Table:
    """A table to load. ``order``: columns that number its rows; ``label``: "" builds the schema alone."""

    name: str
    rows: DataFrame
    order: list[str]
    key: str | None = None
    label: str = ""
    fks: list[dict] = field(default_factory=list)  # from_column, to_table, to_column
    source_id: str | None = None  # of declared rows: each is its own source, with an identity
    chunk: str | None = None  # a column that names the chunk each row is from, which then is its source


def class_name(table: str) -> str:
    return "".join(p[:1].upper() + p[1:].lower() for p in table.split("_") if p)


def identity_key(source_id: Column, key_column: str, value: Column) -> Column:
    payload = F.concat_ws(",", *[F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2) for x in (F.lit(IDENTITY), source_id, F.lit(key_column), value)])
    return F.concat(F.lit("dbrow_"), F.sha2(F.concat(F.lit("["), payload, F.lit("]")), 256))


def related_source_id(source_id: str, table: str, other: str) -> str | None:
    return f"{source_id[: -len(table) - 1]}:{other}" if source_id.endswith(f":{table}") else None


def row_source(source_id: str, key: Column | None, index: Column) -> Column:
    return F.concat(F.lit(f"{source_id}:"), key) if key is not None else F.concat(F.lit(f"{source_id}:row"), index.cast("string"))


def is_fact(name: str, rows: int, fks: list[tuple[str, str]]) -> bool:
    """Large, and either a source of foreign keys alone or of two at least; fks: (from_table, to_table) of all tables."""
    own = [t for f, t in fks if f == name]
    return rows > REFERENCE_ROWS and (len(own) >= 2 or (bool(own) and name not in {t for _, t in fks}))


def text_rows(t: Table) -> DataFrame:
    """Every column as text, nulls kept, with ``_i``, the row's place as a number that grows with the order.

    A single integer key is the place itself; otherwise rows are numbered through a range partitioning and counts by
    partition, so that no task sees all rows.
    """
    schema = {f.name: f.dataType for f in t.rows.schema.fields}
    if len(t.order) == 1 and schema[t.order[0]].typeName() in ("integer", "long"):
        base = t.rows.withColumn("_i", F.col(t.order[0]).cast("bigint"))
    else:
        base = t.rows.orderBy(*t.order).withColumn("_i", F.monotonically_increasing_id())
    return base.select("_i", *[F.when(F.col(c).isNotNull(), V.value_text(F.col(c), k)).alias(c) for c, k in schema.items()])


def instance_labels(rows: DataFrame, label: str, key: str | None, table: str) -> DataFrame:
    """rows with ``_label``: label, else key, else table_place; those that meet in a URI get #key, then #n."""
    some = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    base = F.coalesce(*[some(c) for c in (label, key) if c], F.concat(F.lit(f"{table}_"), F.col("_i").cast("string")))
    named = rows.withColumn("_base", base).withColumn("_uri", T.safe_uri(F.col("_base")))
    twice = named.groupBy("_uri").count().filter("count > 1").select("_uri", F.lit(True).alias("_twice"))
    ident = F.coalesce(some(key), F.col("_i").cast("string")) if key else F.col("_i").cast("string")
    full = F.when(F.col("_twice"), F.concat("_base", F.lit("#"), ident)).otherwise(F.col("_base"))
    out = named.join(twice, "_uri", "left").withColumn("_label", full)
    # repeated keys are the exception: only these rows are numbered
    again = out.groupBy("_label").agg(F.count("*").alias("_m"), F.min("_i").alias("_first")).filter("_m > 1")
    out = out.join(again.drop("_m"), "_label", "left")
    return out.withColumn("_label", F.when(F.col("_first").isNotNull() & (F.col("_i") != F.col("_first")), F.concat("_label", F.lit("#"), F.col("_i").cast("string"))).otherwise(F.col("_label"))).drop("_uri", "_twice", "_base", "_first")


def build(spark: SparkSession, tables: list[Table], skip_facts: bool = True, sizes: dict[str, int] | None = None) -> Graph:
    """The graph of tables. Declared rows (source_id) are never facts; a null there makes no relation, an empty text does."""
    all_fks = [(t.name, fk["to_table"]) for t in tables for fk in t.fks]
    order = lambda *c: F.xxhash64(*c)
    classes, object_props, data_props = [], [], []
    labelled: dict[str, DataFrame] = {}
    by_name = {t.name: t for t in tables}
    place = 0
    for n, t in enumerate(tables):
        count = (sizes or {}).get(t.name)
        count = t.rows.count() if count is None else count
        classes.append((class_name(t.name), f"{t.name} table ({count} rows)", None, "table", [], n))
        for fk in t.fks:
            object_props.append((f"{class_name(t.name)}_{fk['from_column']}", class_name(t.name), class_name(fk["to_table"]), "", place))
            place += 1
        foreign = {fk["from_column"] for fk in t.fks}
        for f in t.rows.schema.fields:
            if f.name not in foreign and f.name != t.chunk:
                data_props.append((f.name, class_name(t.name), V.xsd_type_of(f.dataType), f.name, place))
                place += 1
        fact = skip_facts and t.source_id is None and is_fact(t.name, count, all_fks)
        if t.label and not fact:
            labelled[t.name] = instance_labels(text_rows(t), t.label, t.key, t.name)
    instances, relations, values = [], [], []
    for n, (name, rows) in enumerate(labelled.items()):
        t = by_name[name]
        cls = class_name(name)
        chunk = F.array(F.col(t.chunk) if t.chunk else row_source(t.source_id or name, F.col(t.key) if t.key else None, F.col("_i")))
        ident = F.when(F.trim(F.coalesce(F.col(t.key), F.lit(""))) != "", identity_key(F.lit(t.source_id), t.key, F.col(t.key))).otherwise("") if t.source_id and t.key else F.lit("")
        base = F.lit(n << 40).cast("bigint") + F.col("_i")
        instances.append(rows.select(F.col("_label").alias("name"), F.lit(cls).alias("class_name"), ident.alias("identity"), chunk.alias("source_chunks"), base.alias("ord")))
        kinds = {f.name: V.xsd_type_of(f.dataType) for f in t.rows.schema.fields}
        foreign = {fk["from_column"] for fk in t.fks}
        own = [c for c in kinds if c not in foreign and c not in (t.key, t.label, t.chunk)]
        if own:
            cells = F.array(*[F.struct(F.lit(c).alias("property"), F.trim(F.coalesce(F.col(c), F.lit(""))).alias("value"), F.lit(kinds[c]).alias("value_type")) for c in own])
            long = rows.select("_label", chunk.alias("source_chunks"), base.alias("_o"), F.posexplode(cells).alias("_p", "x")).filter("x.value <> ''")
            values.append(long.select(F.col("_label").alias("entity"), "x.property", "x.value", "x.value_type", "source_chunks", (F.col("_o") * 64 + F.col("_p")).alias("ord")))
        for k, fk in enumerate(t.fks):
            col, to = fk["from_column"], fk["to_table"]
            raw = F.col(col)
            have = raw.isNotNull() if t.source_id else F.trim(F.coalesce(raw, F.lit(""))) != ""
            edges = rows.filter(have).select("_label", "_i", raw.alias("_raw"), F.trim(raw).alias("_fk"), chunk.alias("source_chunks"))
            if to in labelled and by_name[to].key:
                key = F.trim(F.col(by_name[to].key))
                target = labelled[to].filter(key != "").groupBy(key.alias("_fk")).agg(F.max_by("_label", "_i").alias("_target"))
                edges = edges.join(target, "_fk", "left")
            else:
                edges = edges.withColumn("_target", F.lit(None).cast("string"))
            missing = F.concat(F.lit(f"{to}_"), F.col("_fk"))
            relations.append(edges.select(F.col("_label").alias("subject"), F.lit(f"{cls}_{col}").alias("predicate"), F.coalesce("_target", missing).alias("object"), F.lit("ObjectProperty").alias("predicate_type"), F.lit(None).cast("string").alias("label"), F.lit(1.0).alias("weight"), "source_chunks", ((F.lit(n << 40).cast("bigint") + F.col("_i")) * 16 + k).alias("ord")))
            other = related_source_id(t.source_id, name, to) if t.source_id else None
            if other:  # the row that is not there yet, to be replaced when it comes
                gone = edges.filter("_target is null").groupBy("_fk").agg(F.min_by("_raw", "_i").alias("_raw"))
                instances.append(gone.select(missing.alias("name"), F.lit("").alias("class_name"), identity_key(F.lit(other), fk["to_column"], F.col("_raw")).alias("identity"), F.array().cast("array<string>").alias("source_chunks"), (F.lit((n << 40) + (1 << 39)).cast("bigint") + F.pmod(order("_fk"), F.lit(1 << 38))).alias("ord")))
    union = lambda parts: __import__("functools").reduce(DataFrame.unionByName, parts)
    from weftgraph.schemas import LAYOUT

    out = {"classes": spark.createDataFrame(classes, LAYOUT["classes"]), "object_props": spark.createDataFrame(object_props, LAYOUT["object_props"]), "data_props": spark.createDataFrame(data_props, LAYOUT["data_props"])}
    out |= {k: union(v) for k, v in (("instances", instances), ("relations", relations), ("data_values", values)) if v}
    return graph(spark, **out)
