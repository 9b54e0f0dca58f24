"""The exchange bundle: resources, chunks, evidence, entities and facts with content-hash ids, as frames and as files."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from threading import Event, Lock

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql import types as T

from weftgraph.operators.hierarchy import in_circles
from weftgraph.schemas import Graph, graph, place, settled
from weftgraph.session import settle

VERSION = "1.0"
COMPONENTS = ("hierarchy", "content", "embeddings", "graph")
RECORDS = {
    "resources": "id string, revision string, name string, kind string, parent_id string, media_type string, content_digest string, extensions string",
    "chunks": "id string, resource_id string, revision string, extraction_id string, text string, ordinal int, title string, locator string, extensions string",
    "profiles": "id string, model string, model_revision string, dimension int, preprocessing string, metric string, extensions string",
    "embeddings": "chunk_id string, profile_id string, values array<double>",
    "evidence": "id string, chunk_id string, locator string, extensions string",
    "entities": "id string, label string, kind string, evidence_ids array<string>, extensions string",
    "facts": "id string, subject_id string, predicate string, object_id string, literal string, datatype string, evidence_ids array<string>, assertion string, extensions string",
}


class ContractError(ValueError):
    pass


class OperationCancelled(RuntimeError):
    pass


class BudgetExceeded(RuntimeError):
    pass


class OperationContext:
    """A deadline (of time.monotonic()), a budget of model calls, and a way to cancel. check() runs between stages, on the driver; a
    model's calls are counted by consume(), where the client that is made in tasks calls it, for the task."""

    def __init__(self, deadline: float | None = None, max_calls: int = 1000) -> None:
        if not isinstance(max_calls, int) or isinstance(max_calls, bool) or max_calls < 1:
            raise ValueError("max_calls must be a positive whole number")
        self.cancelled, self.deadline, self.left = Event(), deadline, max_calls
        self._lock = Lock()

    def check(self) -> None:
        if self.cancelled.is_set():
            raise OperationCancelled("cancelled")
        if self.deadline is not None and time.monotonic() >= self.deadline:
            raise TimeoutError("past the deadline")

    def consume(self) -> None:
        self.check()
        with self._lock:
            if not self.left:
                raise BudgetExceeded("no calls are left")
            self.left -= 1


def normalize_unicode(value: object) -> object:
    """Surrogate pairs joined, lone ones replaced."""
    if isinstance(value, str):
        return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(value, dict):
        out = {normalize_unicode(k): normalize_unicode(v) for k, v in value.items()}
        if len(out) < len(value):
            raise ContractError("two keys are one after repair")
        return out
    return [normalize_unicode(v) for v in value] if isinstance(value, (list, tuple)) else value


def canonical_json(value: object) -> str:
    try:
        return json.dumps(normalize_unicode(value), sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":"))
    except (TypeError, ValueError) as e:
        raise ContractError(f"not portable as JSON: {e}") from e


def digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def stable_id(kind: str, *parts: Column) -> Column:
    """kind:sha256 of the parts as a canonical JSON array of strings."""
    body = F.concat_ws(",", *[_json_string(p) for p in parts])
    return F.concat(F.lit(f"{kind}:"), F.sha2(F.concat(F.lit("["), body, F.lit("]")), 256))


def _json_string(c: Column) -> Column:
    text = F.to_json(F.array(c))
    return F.substr(text, F.lit(2), F.length(text) - 2)


@dataclass(frozen=True)
class Bundle:
    corpus_id: str
    snapshot_id: str
    tables: dict[str, DataFrame]
    components: tuple[str, ...] = ("hierarchy", "content")
    extensions: dict = field(default_factory=dict)
    version: str = VERSION

    def __getattr__(self, name: str) -> DataFrame:
        if name in RECORDS:
            return self.tables[name]
        raise AttributeError(name)

    def with_(self, **tables: DataFrame) -> Bundle:
        return replace(self, tables=self.tables | tables)


def bundle(spark: SparkSession, corpus_id: str, snapshot_id: str, components: tuple[str, ...] = ("hierarchy", "content"), **tables: DataFrame) -> Bundle:
    return Bundle(corpus_id, snapshot_id, {k: tables[k] if k in tables else spark.createDataFrame([], v) for k, v in RECORDS.items()}, components)


def validate_vector(v: Column, dimension: Column, metric: Column) -> Column:
    fine = (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return fine & ((metric != "cosine") | F.exists(v, lambda x: x != 0))


def py_locator_error(locator: str | None, text: str | None) -> str | None:
    """What is wrong with a locator (JSON), None if nothing."""
    if not locator or locator == "{}":
        return None
    try:
        x = json.loads(locator)
    except ValueError:
        return "locator: not JSON"
    kind = x.get("kind") if isinstance(x, dict) else None
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= 0
    if kind == "text_span":
        a, z = x.get("start"), x.get("end")
        return None if whole(a) and whole(z) and a <= z and (text is None or z <= len(text)) else "locator: span"
    if kind == "page":
        return None if whole(x.get("page")) and x["page"] >= 1 else "locator: page"
    if kind == "json_pointer":
        p = x.get("pointer")
        return None if isinstance(p, str) and (p == "" or p[0] == "/") else "locator: pointer"
    if kind == "table_cell":
        return None if whole(x.get("row")) and whole(x.get("column")) else "locator: cell"
    if kind == "media_time":
        a, z = x.get("start_ms"), x.get("end_ms")
        return None if whole(a) and whole(z) and a <= z else "locator: time"
    return "locator: kind"


@F.pandas_udf(StringType())
def locator_error(locator: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([py_locator_error(a, b) for a, b in zip(locator, text, strict=True)], dtype=object)


def violations(b: Bundle) -> DataFrame:
    """(record, id, what): uniqueness, references, revisions, circles, vectors, locators, facts; empty for a sound bundle."""
    out = []

    def add(df: DataFrame, record: str, what: str, ident: str = "id") -> None:
        out.append(df.select(F.lit(record).alias("record"), F.col(ident).cast("string").alias("id"), F.lit(what).alias("what")))

    for name in ("resources", "chunks", "profiles", "entities", "evidence", "facts"):
        add(b.tables[name].groupBy("id").count().filter("count > 1"), name, "repeated id")
        add(b.tables[name].filter("trim(coalesce(id, '')) = ''"), name, "empty id")

    def refers(name: str, col: str, to: str, ident: str = "id") -> None:
        t = b.tables[name].filter(F.col(col).isNotNull())
        add(t.join(b.tables[to].select(F.col("id").alias(col)), col, "left_anti"), name, f"{col} is unknown", ident)

    refers("resources", "parent_id", "resources")
    refers("chunks", "resource_id", "resources")
    refers("evidence", "chunk_id", "chunks")
    refers("facts", "subject_id", "entities")
    refers("facts", "object_id", "entities")
    refers("embeddings", "chunk_id", "chunks", "chunk_id")
    refers("embeddings", "profile_id", "profiles", "chunk_id")
    for name in ("entities", "facts"):
        ids = b.tables[name].select("id", F.explode("evidence_ids").alias("e"))
        add(ids.join(b.evidence.select(F.col("id").alias("e")), "e", "left_anti"), name, "evidence is unknown")
    rev = b.chunks.join(b.resources.select(F.col("id").alias("resource_id"), F.col("revision").alias("_r")), "resource_id").filter("revision <> _r")
    add(rev, "chunks", "of another revision")
    add(b.resources.filter("kind not in ('directory', 'file', 'document', 'record')"), "resources", "kind")
    add(b.entities.filter("kind not in ('class', 'instance')"), "entities", "kind")
    add(b.facts.filter("assertion not in ('extracted', 'inferred', 'manual')"), "facts", "assertion")
    add(b.facts.filter("(object_id is null) = (literal is null)"), "facts", "neither or both of entity and literal")
    prof = b.embeddings.join(b.profiles.select(F.col("id").alias("profile_id"), "dimension", "metric"), "profile_id")
    add(prof.filter(~validate_vector(F.col("values"), F.col("dimension"), F.col("metric"))), "embeddings", "vector", "chunk_id")
    bad = b.chunks.withColumn("_w", locator_error(F.col("locator"), F.col("text"))).filter("_w is not null")
    add(bad, "chunks", "locator")
    up = b.resources.filter("parent_id is not null").select(F.col("parent_id").alias("parent"), F.col("id").alias("child"), F.lit(0).cast("bigint").alias("ord"))
    # what is left when ends of chains go, again and again, runs in a circle or between two
    add(in_circles(settle(up, "parents")).select(F.col("child").alias("id")).distinct(), "resources", "is its own ancestor")
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def validate(b: Bundle) -> Bundle:
    if set(b.components) - set(COMPONENTS) or len(set(b.components)) < len(b.components) or b.version != VERSION:
        raise ContractError("components or version")
    found = violations(b).limit(5).collect()
    if found:
        raise ContractError("; ".join(f"{r['record']} {r['id']}: {r['what']}" for r in found))
    return b


def export_knowledge(g: Graph, source: Bundle, snapshot_id: str) -> Bundle:
    """The graph over a source snapshot. Facts without chunks of their own borrow their subject's evidence, else their object's.

    Borrowing is in the order typings, hierarchy, relations, values: what a stage has told widens what later ones may borrow.
    """
    g = settled(g)
    corpus = F.lit(source.corpus_id)
    evidence = source.chunks.select(stable_id("evidence", corpus, F.col("id")).alias("id"), F.col("id").alias("chunk_id"), F.lit("{}").alias("locator"), F.lit("{}").alias("extensions"))
    ref = evidence.select("chunk_id", F.col("id").alias("e"))
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("name"))
    own = lambda df, kind, c: df.filter(F.coalesce(F.col(c), F.lit("")) != "").select(key(kind, c).alias("k"), F.explode_outer("source_chunks").alias("chunk_id"))
    objects = g.relations.filter("coalesce(predicate_type, '') <> 'DatatypeProperty'")
    parts = [own(g.classes, "class", "name"), own(g.instances, "instance", "name"), own(g.instances, "class", "class_name"), own(g.relations, "instance", "subject"), own(objects, "instance", "object"), own(g.data_values, "instance", "entity")]
    parts += [g.hierarchy.select(key("class", c).alias("k"), F.lit(None).cast("string").alias("chunk_id")) for c in ("parent", "child")]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    unknown = every.filter("chunk_id is not null and chunk_id <> ''").join(ref.select("chunk_id"), "chunk_id", "left_anti").limit(1).count()
    if unknown:
        raise ContractError("the graph names chunks that the source lacks")
    support = settle(every.join(ref, "chunk_id", "left").groupBy("k").agg(F.collect_set("e").alias("ev")), "support")
    none = F.array().cast("array<string>")

    def stage(rows: DataFrame, support: DataFrame, inferred: bool) -> tuple[DataFrame, DataFrame]:
        """Facts of rows (subject, predicate, object, literal, datatype, source_chunks), and supports with theirs."""
        ids = rows.withColumn("_id", F.xxhash64("subject", "predicate", "object", "literal", "datatype", "source_chunks"))
        cited = ids.select("_id", F.explode("source_chunks").alias("chunk_id")).join(ref, "chunk_id").groupBy("_id").agg(F.collect_set("e").alias("mine"))
        s = support.select(F.col("k").alias("subject"), F.col("ev").alias("se"))
        o = support.select(F.col("k").alias("object"), F.col("ev").alias("oe"))
        got = ids.join(cited, "_id", "left").join(s, "subject", "left").join(o, "object", "left")
        has = F.size(F.coalesce("mine", none)) > 0
        borrowed = F.when(F.size(F.coalesce("se", none)) > 0, F.col("se")).otherwise(F.coalesce("oe", none))
        got = got.withColumn("ev", F.when(has, F.col("mine")).otherwise(borrowed)).withColumn("assertion", F.when(has & F.lit(not inferred), "extracted").otherwise("inferred")).filter(F.size("ev") > 0)
        got = settle(got, "told")
        wider = got.select(F.col("subject").alias("k"), "ev").unionByName(got.filter("object is not null").select(F.col("object").alias("k"), "ev"))
        new = support.unionByName(wider).groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("ev"))).alias("ev"))
        return got, settle(new, "support")

    blank = F.lit(None).cast("string")
    node = "struct<kind:string,name:string>"
    typed = g.instances.filter("coalesce(name, '') <> '' and coalesce(class_name, '') <> ''").select(key("instance", "name").alias("subject"), F.lit("instanceOf").alias("predicate"), key("class", "class_name").alias("object"), blank.alias("literal"), blank.alias("datatype"), "source_chunks")
    up = g.hierarchy.select(key("class", "child").alias("subject"), F.lit("subClassOf").alias("predicate"), key("class", "parent").alias("object"), blank.alias("literal"), blank.alias("datatype"), none.alias("source_chunks"))
    is_value = F.col("predicate_type") == "DatatypeProperty"
    rel = g.relations.select(key("instance", "subject").alias("subject"), "predicate", F.when(is_value, F.lit(None)).otherwise(key("instance", "object")).cast(node).alias("object"), F.when(is_value, F.col("object")).alias("literal"), F.when(is_value, "xsd:string").alias("datatype"), "source_chunks")
    val = g.data_values.select(key("instance", "entity").alias("subject"), F.col("property").alias("predicate"), F.lit(None).cast(node).alias("object"), F.col("value").alias("literal"), F.col("value_type").alias("datatype"), "source_chunks")
    facts = []
    for rows, inferred in ((typed, False), (up, True), (rel, False), (val, False)):
        got, support = stage(rows, support, inferred)
        facts.append(got.select("subject", "predicate", "object", "literal", "datatype", "ev", "assertion"))
    told = facts[0]
    for f in facts[1:]:
        told = told.unionByName(f)
    ent = lambda c: stable_id("entity", corpus, F.col(f"{c}.kind"), F.col(f"{c}.name"))
    sid, oid = ent("subject"), F.when(F.col("object").isNotNull(), ent("object"))
    pair = F.concat(F.lit("["), F.coalesce(_json_string(F.col("datatype")), F.lit("null")), F.lit(","), F.coalesce(_json_string(F.col("literal")), F.lit("null")), F.lit("]"))
    told = told.withColumn("subject_id", sid).withColumn("object_id", oid)
    told = told.withColumn("id", stable_id("fact", corpus, F.col("subject_id"), F.col("predicate"), F.coalesce("object_id", pair)))
    facts_out = told.groupBy("id").agg(
        F.first("subject_id").alias("subject_id"), F.first("predicate").alias("predicate"), F.first("object_id").alias("object_id"), F.first("literal").alias("literal"), F.first("datatype").alias("datatype"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ev")))).alias("evidence_ids"), F.min("assertion").alias("assertion"),
    ).withColumn("extensions", F.lit("{}"))
    entities = support.select(stable_id("entity", corpus, F.col("k.kind"), F.col("k.name")).alias("id"), F.col("k.name").alias("label"), F.col("k.kind").alias("kind"), F.array_sort("ev").alias("evidence_ids"), F.lit("{}").alias("extensions"))
    out = source.with_(evidence=evidence, entities=entities, facts=facts_out)
    return replace(out, snapshot_id=snapshot_id, components=tuple(sorted({*source.components, "graph"})))


def table_bound_names(b: Bundle) -> DataFrame:
    """(label) of entities whose every evidence is of a table's resource."""
    is_table = F.lower("name").rlike("\\.(csv|tsv|xlsx|xlsm|xls)$")
    owner = b.evidence.join(b.chunks.select(F.col("id").alias("chunk_id"), "resource_id"), "chunk_id").join(b.resources.select(F.col("id").alias("resource_id"), is_table.alias("t")), "resource_id").select(F.col("id").alias("e"), "t")
    return b.entities.select("label", "id", F.explode("evidence_ids").alias("e")).join(owner, "e").groupBy("id", "label").agg(F.min("t").alias("t")).filter("t").select("label").distinct()


def import_knowledge(b: Bundle) -> Graph:
    """The graph of a bundle; what was inferred comes back without chunks."""
    chunk = b.evidence.select(F.col("id").alias("e"), "chunk_id")
    of = lambda df: df.select("id", F.explode("evidence_ids").alias("e")).join(chunk, "e").groupBy("id").agg(F.array_sort(F.collect_set("chunk_id")).alias("source_chunks"))
    at = place("id").alias("ord")
    none = F.array().cast("array<string>")
    ent = b.entities.join(of(b.entities), "id", "left").withColumn("source_chunks", F.coalesce("source_chunks", none))
    name = lambda c, to: b.entities.select(F.col("id").alias(c), F.col("label").alias(to))
    bound = table_bound_names(b).withColumn("_t", F.lit(True)).withColumnRenamed("label", "name")
    classes = ent.filter("kind = 'class'").select(F.col("label").alias("name"), "source_chunks", at).join(bound, "name", "left").withColumn("source", F.when(F.col("_t"), "table").otherwise("")).drop("_t")
    facts = b.facts.join(of(b.facts), "id", "left").withColumn("source_chunks", F.when(F.col("assertion") == "inferred", none).otherwise(F.coalesce("source_chunks", none)))
    facts = facts.join(name("subject_id", "s"), "subject_id").join(name("object_id", "o"), "object_id", "left")
    typed = facts.filter("predicate = 'instanceOf' and o is not null").groupBy("subject_id").agg(F.min_by("o", "id").alias("class_name"))
    inst = ent.filter("kind = 'instance'").join(typed.withColumnRenamed("subject_id", "id"), "id", "left").select(F.col("label").alias("name"), F.coalesce("class_name", F.lit("")).alias("class_name"), F.lit("").alias("identity"), "source_chunks", at)
    up = facts.filter("predicate = 'subClassOf' and o is not null").select(F.col("o").alias("parent"), F.col("s").alias("child"), at)
    rest = facts.filter("predicate not in ('instanceOf', 'subClassOf')")
    rel = rest.filter("o is not null").select(F.col("s").alias("subject"), "predicate", F.col("o").alias("object"), F.lit("ObjectProperty").alias("predicate_type"), F.lit(1.0).alias("weight"), "source_chunks", at)
    val = rest.filter("object_id is null").select(F.col("s").alias("entity"), F.col("predicate").alias("property"), F.col("literal").alias("value"), F.coalesce("datatype", F.lit("xsd:string")).alias("value_type"), "source_chunks", at)
    props = val.select(F.col("property").alias("name")).distinct().withColumn("ord", place("name")).withColumn("range", F.lit("xsd:string"))
    ops = rel.select(F.col("predicate").alias("name")).distinct().withColumn("ord", place("name"))
    chunks = b.chunks.select("id", F.col("resource_id").alias("doc"), "text", F.col("ordinal").alias("chunk_index"))
    return graph(b.chunks.sparkSession, classes=classes, instances=inst, hierarchy=up, relations=rel, data_values=val, data_props=props, object_props=ops, chunks=chunks)


def documents_of(source: Bundle) -> DataFrame:
    """(doc, chunk_id, chunk_text, chunk_index): resources under their ids, so that files of one name stay apart, with the ending that tells tables."""
    ending = F.regexp_extract("name", "(\\.[^./]+)$", 1)
    named = source.resources.select(F.col("id").alias("resource_id"), F.when(ending != "", F.concat(stable_id("source", F.col("id")), F.lit("/"), "name")).otherwise(F.concat("id", F.lit(".txt"))).alias("doc"))
    return source.chunks.join(named, "resource_id").select("doc", F.col("id").alias("chunk_id"), F.col("text").alias("chunk_text"), F.col("ordinal").alias("chunk_index"))


def build_knowledge(source: Bundle, snapshot_id: str, build: Callable[[DataFrame], Graph], context: OperationContext | None = None) -> Bundle:
    """The whole graph of a source snapshot, built anew: what was replaced or deleted has no trace. ``build``: chunks to a graph, such
    as GraphBuilder.build; it is not changed, and nothing is published."""
    context = context or OperationContext()
    context.check()
    validate(source)
    g = build(documents_of(source))
    context.check()
    out = export_knowledge(g, source, snapshot_id)
    context.check()
    return out


def fragment(source: Bundle) -> Bundle:
    """A source of exactly one file, without embeddings."""
    files = source.resources.filter("kind <> 'directory'").limit(2).collect()
    if len(files) != 1:
        raise ContractError("a fragment is of one resource")
    foreign = source.chunks.filter((F.col("resource_id") != files[0]["id"]) | (F.col("revision") != files[0]["revision"])).limit(1).count()
    if foreign:
        raise ContractError("chunks of another resource or revision")
    spark = source.chunks.sparkSession
    out = source.with_(profiles=spark.createDataFrame([], RECORDS["profiles"]), embeddings=spark.createDataFrame([], RECORDS["embeddings"]))
    return replace(out, components=tuple(c for c in source.components if c != "embeddings"), extensions=source.extensions | {"fragment": {"resource_id": files[0]["id"], "revision": files[0]["revision"]}})


def assemble(source: Bundle, fragments: list[Bundle], snapshot_id: str) -> Bundle:
    """One bundle of fragments: evidence ids united by id; stale, repeated or conflicting fragments are refused."""
    keys = [(f.extensions.get("fragment", {}).get("resource_id"), f.extensions.get("fragment", {}).get("revision")) for f in fragments]
    if any(f.corpus_id != source.corpus_id for f in fragments) or None in [k for k, _ in keys] or len(set(keys)) < len(keys):
        raise ContractError("fragments of another corpus, without a resource, or repeated")
    current = source.resources.filter(F.col("id").isin([k for k, _ in keys])).select("id", "revision").collect()
    if {(r["id"], r["revision"]) for r in current} != set(keys):
        raise ContractError("a fragment is of no current revision")

    def union(name: str) -> DataFrame:
        out = fragments[0].tables[name]
        for f in fragments[1:]:
            out = out.unionByName(f.tables[name])
        return out

    def merged(name: str, with_ids: bool) -> DataFrame:
        cols = [c.split()[0] for c in RECORDS[name].split(", ")]
        same = [c for c in cols if c not in ("id", "evidence_ids")]
        rows = union(name)
        if rows.groupBy("id").agg(F.countDistinct(F.struct(*[F.coalesce(F.col(c), F.lit("\0")) for c in same])).alias("n")).filter("n > 1").limit(1).count():
            raise ContractError(f"conflicting {name}")
        aggs = [F.first(c).alias(c) for c in same]
        if with_ids:
            aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"))
        return rows.groupBy("id").agg(*aggs).select(*cols)

    evidence = merged("evidence", False)
    if evidence.join(source.chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti").limit(1).count():
        raise ContractError("evidence that the source lacks")
    out = source.with_(evidence=evidence, entities=merged("entities", True), facts=merged("facts", True))
    return replace(out, snapshot_id=snapshot_id, components=tuple(sorted({*source.components, "graph"})))


def dump(b: Bundle, path: str) -> None:
    """JSON files by record, and a manifest; Spark's commit protocol makes each whole."""
    for name, df in b.tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    meta = {"corpus_id": b.corpus_id, "snapshot_id": b.snapshot_id, "components": list(b.components), "extensions": b.extensions, "contract_version": b.version}
    spark = b.chunks.sparkSession
    spark.createDataFrame([(canonical_json(meta), digest(meta))], "manifest string, digest string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> Bundle:
    m = spark.read.schema("manifest string, digest string").json(f"{path}/manifest").first()
    meta = json.loads(m["manifest"])
    if digest(meta) != m["digest"]:
        raise ContractError("the manifest was changed")
    tables = {k: spark.read.schema(T.StructType.fromDDL(v)).json(f"{path}/{k}") for k, v in RECORDS.items()}
    return Bundle(meta["corpus_id"], meta["snapshot_id"], tables, tuple(meta["components"]), meta["extensions"], meta["contract_version"])
