"""The graph as tables of one collection: nodes, edges, their sources and chunks, enriched chunks, schema.

Tables are Parquet folders partitioned by collection; a write replaces a collection's partition, or merges with
it by full outer joins. On a table format with MERGE the same plans can be given to that.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from weftgraph.functions import text as X
from weftgraph.session import settle
from weftgraph.operators.normalize import LEGACY_RELATED
from weftgraph.schemas import Graph, evidence, graph, place

DOMAIN, INSTANCE, ROW = "urn:weft:domain#", "urn:weft:instance#", "urn:weft:instance#dbrow_"
TABLES = {
    "nodes": "uri string, kind string, label string, attrs map<string,array<string>>, ord bigint",
    "edges": "subject_uri string, predicate string, object_uri string, predicate_uri string, edge_kind string, edge_weight double, label string, ord bigint",
    "edge_sources": "subject_uri string, predicate string, object_uri string, source_type string, source_id string",
    "node_chunks": "uri string, chunk_id string",
    "enriched_chunks": "chunk_id string",
    "schema": "element_name string, element_type string, description string, domain_class string, range_value string, parent_class string, source string",
}


def local(name):  # noqa: ANN001, ANN201
    """A short URI part: long names keep 40 characters and a hash."""
    u = X.safe_uri(name)
    return F.when(F.length(u) > 40, F.concat(F.substring(u, 1, 40), F.lit("_"), F.substring(F.sha2(name, 256), 1, 8))).otherwise(u)


def endpoints(g: Graph) -> DataFrame:
    """(name, uri, kind) of every node: instances, then classes, then ends that nobody declared."""
    some = lambda df, c: df.filter(F.coalesce(F.col(c), F.lit("")) != "")
    known = g.uris.groupBy("kind", "name").agg(F.min("uri").alias("_u"))
    inst = some(g.instances, "name").groupBy("name").agg(F.max(F.nullif(F.col("identity"), F.lit(""))).alias("identity"), F.min("ord").alias("ord"), F.lit("instance").alias("kind"))
    cls = some(g.classes, "name").groupBy("name").agg(F.lit(None).cast("string").alias("identity"), F.min("ord").alias("ord"), F.lit("concept").alias("kind"))
    rel = g.relations.filter("coalesce(predicate_type, '') <> 'DatatypeProperty'")
    ends = some(rel.select(F.explode(F.array("subject", "object")).alias("name"), "ord").unionByName(g.data_values.select(F.col("entity").alias("name"), "ord")), "name")
    loose = ends.join(inst.select("name").unionByName(cls.select("name")).distinct(), "name", "left_anti").groupBy("name").agg(F.lit(None).cast("string").alias("identity"), ((1 << 61) + F.pmod(F.min("ord"), F.lit(1 << 60))).cast("bigint").alias("ord"), F.lit("instance").alias("kind"))
    every = inst.unionByName(cls).unionByName(loose).join(known, ["kind", "name"], "left")
    base = F.when(F.col("identity").isNotNull(), F.concat(F.lit(INSTANCE), "identity")).otherwise(F.coalesce("_u", F.concat(F.when(F.col("kind") == "concept", DOMAIN).otherwise(INSTANCE), local(F.col("name")))))
    return every.select("name", base.alias("uri"), "kind", "ord")


def graph_rows(g: Graph) -> dict[str, DataFrame]:
    """nodes (labels: without attrs), edges and node_chunks; the first record of a uri, and of a triple, holds."""
    every = settle(endpoints(g), "endpoints")  # all of them look names up there
    inst = every.filter("kind = 'instance'").select("name", "uri")
    cls = every.filter("kind = 'concept'").select("name", "uri")
    # a name that is both is the instance, as an end of relations
    both = inst.unionByName(cls.join(inst.select("name"), "name", "left_anti"))
    to = lambda df, names, c, u: df.join(names.toDF(c, u), c)
    one = F.lit(1.0)
    none = F.lit(None).cast("string")
    prop_uri = F.concat(F.lit(DOMAIN), F.when(F.coalesce("domain", F.lit("")) != "", F.concat("domain", F.lit("_"), "name")).otherwise(F.col("name")))
    dp = g.data_props.filter("coalesce(name, '') <> ''").withColumn("_p", prop_uri)
    columns = ("subject_uri", "predicate", "object_uri", "predicate_uri", "edge_kind", "edge_weight", "label", "ord")

    def edge(df: DataFrame, s: str, p, o: str, kind: str, weight=one, label=none) -> DataFrame:  # noqa: ANN001
        p = p if not isinstance(p, str) else F.lit(p)
        return df.select(F.col(s), p, F.col(o), F.concat(F.lit(DOMAIN), p), F.lit(kind), weight, label, F.col("ord")).toDF(*columns)

    edges = edge(to(dp, cls, "domain", "_d"), "_d", F.col("name"), "_p", "datatypeProperty_schema")
    op = to(to(g.object_props.filter("coalesce(name, '') <> ''"), cls, "domain", "_d"), cls, "range", "_r")
    edges = edges.unionByName(edge(op, "_d", F.col("name"), "_r", "objectProperty_schema"))
    up = to(to(g.hierarchy.filter("parent <> child"), cls, "parent", "_p"), cls, "child", "_c")
    edges = edges.unionByName(edge(up, "_c", "subClassOf", "_p", "subClassOf"))
    typed = to(to(g.instances, inst, "name", "_i"), cls, "class_name", "_c")
    edges = edges.unionByName(edge(typed, "_i", "instanceOf", "_c", "instanceOf"))
    rel = to(to(g.relations.filter("coalesce(predicate_type, '') <> 'DatatypeProperty' and coalesce(predicate, '') <> ''"), both, "subject", "_s"), both, "object", "_o")
    edges = edges.unionByName(edge(rel, "_s", F.col("predicate"), "_o", "objectProperty", F.coalesce(F.nullif(F.col("weight"), F.lit(0.0)), one), F.nullif(F.col("label"), F.lit(""))))
    w = W.partitionBy("subject_uri", "predicate", "object_uri").orderBy("ord")
    edges = edges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    vals = to(g.data_values.filter("coalesce(entity, '') <> '' and coalesce(property, '') <> '' and value is not null"), both, "entity", "uri")
    per = vals.groupBy("uri", "property", "value").agg(F.min("ord").alias("ord")).groupBy("uri", "property").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda s: s["value"]).alias("v"))
    attrs = per.groupBy("uri").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("property", "v")))).alias("attrs"))
    nodes = every.select("uri", "kind", F.col("name").alias("label"), "ord").unionByName(dp.select(F.col("_p").alias("uri"), F.lit("property").alias("kind"), F.col("name").alias("label"), ((1 << 60) + F.pmod(F.col("ord"), F.lit(1 << 59))).cast("bigint").alias("ord")))
    rank = F.when(F.col("kind") == "concept", 0).when(F.col("kind") == "property", 1).otherwise(2)
    first = nodes.withColumn("_n", F.row_number().over(W.partitionBy("uri").orderBy(rank, "ord"))).filter("_n = 1").drop("_n")
    nodes = first.join(attrs, "uri", "left").select("uri", "kind", "label", "attrs", "ord")
    chunk = evidence(g).join(both, "name").select("uri", "chunk_id").unionByName(evidence_of_classes(g).join(cls, "name").select("uri", "chunk_id")).distinct()
    return {"nodes": nodes, "labels": first.select("uri", "kind", "label", "ord"), "edges": edges, "node_chunks": chunk}


def evidence_of_classes(g: Graph) -> DataFrame:
    return g.classes.select("name", F.explode("source_chunks").alias("chunk_id")).filter("chunk_id <> ''")


def edge_source_rows(g: Graph) -> DataFrame:
    every = endpoints(g)
    inst = every.filter("kind = 'instance'").select("name", "uri")
    both = inst.unionByName(every.filter("kind = 'concept'").select("name", "uri").join(inst.select("name"), "name", "left_anti"))
    rel = g.relations.filter("coalesce(predicate_type, '') <> 'DatatypeProperty' and coalesce(predicate, '') <> ''")
    rel = rel.join(both.toDF("subject", "subject_uri"), "subject").join(both.toDF("object", "object_uri"), "object")
    return rel.select("subject_uri", "predicate", "object_uri", F.lit("chunk").alias("source_type"), F.explode("source_chunks").alias("source_id")).filter("source_id <> ''").distinct()


def schema_rows(g: Graph) -> DataFrame:
    up = g.hierarchy.groupBy(F.col("child").alias("name")).agg(F.max_by("parent", "ord").alias("_p"))
    none = F.lit(None).cast("string")
    first = lambda df: df.filter("coalesce(name, '') <> ''").withColumn("_n", F.row_number().over(W.partitionBy("name").orderBy("ord"))).filter("_n = 1")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    cls = first(g.classes).join(up, "name", "left").select(F.col("name"), F.lit("Class"), F.coalesce("description", F.lit("")), none, none, F.coalesce(blank("parent"), "_p"), F.when(F.col("source") == "table", "csv"))
    ops = first(g.object_props).select("name", F.lit("ObjectProperty"), F.coalesce("description", F.lit("")), blank("domain"), blank("range"), none, none)
    dps = first(g.data_props).select("name", F.lit("DatatypeProperty"), F.lit(""), blank("domain"), F.coalesce(blank("range"), F.lit("xsd:string")), none, none)
    cols = [c.split()[0] for c in TABLES["schema"].split(", ")]
    return cls.toDF(*cols).unionByName(ops.toDF(*cols)).unionByName(dps.toDF(*cols))


class GraphStore:
    """Reads and writes one collection under ``root``. A version folder is written whole, then named by a pointer file."""

    def __init__(self, spark: SparkSession, root: str, collection: str) -> None:
        self.spark, self.base = spark, f"{root.rstrip('/')}/{collection}"

    def _fs(self):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[str]:
        """Names of whole versions, oldest first: those with a marker."""
        fs, path = self._fs()
        if not fs.exists(path(self.base)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.base))]
        return sorted(n[:-5] for n in names if n.endswith(".done"))

    def table(self, name: str) -> DataFrame:
        have = self._versions()
        if not have:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(T.StructType.fromDDL(TABLES[name])).parquet(f"{self.base}/{have[-1]}/{name}")

    def ensure_schema(self) -> None:
        if not self._versions():
            self.save({})

    def save(self, tables: dict[str, DataFrame]) -> None:
        """A new version: the given tables, the rest as they are. The two versions before stay for readers."""
        old = self._versions()
        n = int(old[-1].split("-")[0]) + 1 if old else 0
        name = f"{n:09d}-{uuid.uuid4().hex[:8]}"
        for t, layout in TABLES.items():
            df = tables.get(t)
            df = self.table(t) if df is None else df
            df.select(*[f.name for f in T.StructType.fromDDL(layout).fields]).write.parquet(f"{self.base}/{name}/{t}")
        fs, path = self._fs()
        fs.create(path(f"{self.base}/{name}.done")).close()
        for v in old[:-1]:
            fs.delete(path(f"{self.base}/{v}"), True)
            fs.delete(path(f"{self.base}/{v}.done"), False)

    def clear(self) -> None:
        self.save({t: self.spark.createDataFrame([], layout) for t, layout in TABLES.items()})

    def label_uris(self) -> DataFrame:
        """(kind, name, uri): the first uri of a label."""
        n = self.table("nodes").filter("kind in ('concept', 'instance') and coalesce(label, '') <> ''")
        return n.groupBy("kind", F.col("label").alias("name")).agg(F.min_by("uri", "ord").alias("uri"))

    def write(self, g: Graph, replace: bool = True) -> None:
        """Replace: the collection is the graph. Else: attributes unite (rows with an identity replace theirs), weights are
        the new ones, labels the first ones, sources and chunks are added, and named relations supersede stored relatedTo."""
        if not replace:
            g = g.with_(uris=self.label_uris().select("name", "kind", "uri").unionByName(g.uris).groupBy("name", "kind").agg(F.min("uri").alias("uri")))
        new = {k: v for k, v in graph_rows(g).items() if k in TABLES}
        sources, schema = edge_source_rows(g), schema_rows(g)
        if replace:
            self.save(new | {"edge_sources": sources, "schema": schema, "enriched_chunks": g.enriched.distinct()})
            return
        shift = lambda df: df.withColumn("ord", F.col("ord") / 2 + (1 << 61)).withColumn("ord", F.col("ord").cast("bigint"))
        old_n, new_n = self.table("nodes"), shift(new["nodes"])
        pair = old_n.select("uri", F.struct("kind", "label", "attrs", "ord").alias("o")).join(new_n.select("uri", F.struct("kind", "label", "attrs", "ord").alias("n")), "uri", "full_outer")
        row = F.startswith("uri", F.lit(ROW))
        nothing = F.create_map().cast("map<string,array<string>>")
        united = F.map_zip_with(F.coalesce("o.attrs", nothing), F.coalesce("n.attrs", nothing), lambda _, a, b: F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))
        attrs = F.when(F.col("n").isNull(), F.col("o.attrs")).when(row, F.col("n.attrs")).otherwise(united)
        label = F.when(row & F.col("n").isNotNull(), F.col("n.label")).otherwise(F.coalesce("o.label", "n.label"))
        nodes = pair.select("uri", F.coalesce("n.kind", "o.kind").alias("kind"), label.alias("label"), attrs.alias("attrs"), F.coalesce("o.ord", "n.ord").alias("ord"))
        old_e = rename_legacy(self.table("edges"))
        key = ["subject_uri", "predicate", "object_uri"]
        rest = F.struct("predicate_uri", "edge_kind", "edge_weight", "label", "ord")
        both = old_e.select(*key, rest.alias("o")).join(shift(new["edges"]).select(*key, rest.alias("n")), key, "full_outer")
        edges = both.select(*key, F.coalesce("n.predicate_uri", "o.predicate_uri").alias("predicate_uri"), F.coalesce("n.edge_kind", "o.edge_kind").alias("edge_kind"), F.coalesce("n.edge_weight", "o.edge_weight").alias("edge_weight"), F.coalesce("o.label", "n.label").alias("label"), F.coalesce("o.ord", "n.ord").alias("ord"))
        edges, all_sources = drop_superseded(edges, self.table("edge_sources").unionByName(sources).distinct(), new["edges"])
        old_s = self.table("schema")
        blank = lambda c: F.nullif(F.col(c), F.lit(""))
        fill = old_s.join(schema.select("element_name", "element_type", F.col("description").alias("_d"), F.col("source").alias("_s")), ["element_name", "element_type"], "left")
        fill = fill.withColumn("description", F.coalesce(blank("description"), "_d", F.lit(""))).withColumn("source", F.coalesce(blank("source"), "_s")).drop("_d", "_s")
        all_schema = fill.unionByName(schema.join(old_s.select("element_name", "element_type"), ["element_name", "element_type"], "left_anti").select(*fill.columns))
        chunks = self.table("node_chunks").unionByName(new["node_chunks"]).distinct()
        self.save({"nodes": nodes, "edges": edges, "edge_sources": all_sources, "node_chunks": chunks, "schema": all_schema, "enriched_chunks": self.table("enriched_chunks").unionByName(g.enriched).distinct()})

    def mark_enriched(self, chunk_ids: DataFrame) -> None:
        self.save({"enriched_chunks": self.table("enriched_chunks").unionByName(chunk_ids.select("chunk_id")).filter("chunk_id <> ''").distinct()})

    def detach_chunks(self, gone: DataFrame, attr_keys: list[str] | None = None) -> None:
        """Edges that only these chunks state go, and attributes of these keys on the nodes they state."""
        src = self.table("edge_sources")
        ids = gone.select(F.col("chunk_id").alias("source_id")).distinct()
        key = ["subject_uri", "predicate", "object_uri"]
        hit = src.join(ids, "source_id", "left_semi").select(*key).distinct()
        left = src.join(ids, "source_id", "left_anti")
        dead = hit.join(left.select(*key), key, "left_anti")
        edges = self.table("edges")
        edges = edges.filter("edge_kind <> 'objectProperty'").unionByName(edges.filter("edge_kind = 'objectProperty'").join(dead, key, "left_anti").select(*edges.columns))
        out = {"edge_sources": left, "edges": edges}
        if attr_keys:
            near = self.table("node_chunks").join(gone.select("chunk_id").distinct(), "chunk_id", "left_semi").select("uri").distinct().withColumn("_h", F.lit(True))
            cut = F.map_filter("attrs", lambda k, _: ~k.isin(*attr_keys))
            out["nodes"] = self.table("nodes").join(near, "uri", "left").withColumn("attrs", F.when(F.col("_h"), cut).otherwise(F.col("attrs")))
        self.save(out)

    def prune_chunks(self, gone: DataFrame, structural: tuple[str, ...] = (X.RELATED, LEGACY_RELATED, "sameAs")) -> None:
        """Retraction over the tables: weights become the number of sources left; nodes without chunks go, classes to a fixpoint."""
        gone = gone.select("chunk_id").distinct()
        links, src = self.table("node_chunks"), self.table("edge_sources")
        cand = links.join(gone, "chunk_id", "left_semi").select("uri").distinct()
        left_links = links.join(gone, "chunk_id", "left_anti")
        left_src = src.join(gone.withColumnRenamed("chunk_id", "source_id"), "source_id", "left_anti")
        key = ["subject_uri", "predicate", "object_uri"]
        had, has = src.select(*key).distinct().withColumn("_had", F.lit(True)), left_src.groupBy(*key).agg(F.count("*").alias("_left"))
        edges = self.table("edges").join(had, key, "left").join(has, key, "left")
        mark = lambda c, n: cand.select(F.col("uri").alias(c), F.lit(True).alias(n))
        edges = edges.join(mark("subject_uri", "_cs"), "subject_uri", "left").join(mark("object_uri", "_co"), "object_uri", "left")
        # pairs in question first, then their chunks: no chunk's nodes are paired with one another
        loose = edges.filter("edge_kind = 'objectProperty' and _had is null and _cs and _co").filter(~F.col("predicate").isin(*structural)).select("subject_uri", "object_uri").distinct()
        mine = loose.join(left_links.withColumnRenamed("uri", "subject_uri"), "subject_uri")
        common = mine.join(left_links.withColumnRenamed("uri", "object_uri"), ["object_uri", "chunk_id"], "left_semi").select("subject_uri", "object_uri").distinct().withColumn("_common", F.lit(True))
        edges = edges.join(common, ["subject_uri", "object_uri"], "left")
        obj = F.col("edge_kind") == "objectProperty"
        dead = obj & F.coalesce(F.col("_had") & F.col("_left").isNull(), F.lit(False)) | obj & F.col("_had").isNull() & ~F.col("predicate").isin(*structural) & F.coalesce(F.col("_cs") & F.col("_co"), F.lit(False)) & F.col("_common").isNull()
        edges = edges.filter(~dead).withColumn("edge_weight", F.when(obj & F.col("_left").isNotNull(), F.col("_left").cast("double")).otherwise(F.col("edge_weight"))).select(*[c.split()[0] for c in TABLES["edges"].split(", ")])
        nodes = self.table("nodes")
        bare = nodes.join(left_links.select("uri").distinct(), "uri", "left_anti")
        while True:  # each round takes a level of what hangs on nothing
            near = bare.join(cand, "uri", "left_semi")
            orphans = near.filter("kind = 'instance'").select("uri")
            used = edges.filter("edge_kind in ('instanceOf', 'subClassOf', 'objectProperty_schema', 'objectProperty')").filter("subject_uri <> object_uri")
            pointed = used.select(F.col("object_uri").alias("uri")).unionByName(used.filter("edge_kind = 'objectProperty'").select(F.col("subject_uri").alias("uri")))
            orphans = settle(orphans.unionByName(near.filter("kind = 'concept'").join(pointed, "uri", "left_anti").select("uri")).distinct())
            if not orphans.limit(1).count():
                break
            up = edges.join(orphans.withColumnRenamed("uri", "subject_uri"), "subject_uri", "left_semi").filter("edge_kind in ('instanceOf', 'subClassOf', 'objectProperty_schema')").select(F.col("object_uri").alias("uri"))
            cand = settle(up.distinct())
            edges = settle(edges.join(orphans.withColumnRenamed("uri", "subject_uri"), "subject_uri", "left_anti").join(orphans.withColumnRenamed("uri", "object_uri"), "object_uri", "left_anti"))
            nodes = settle(nodes.join(orphans, "uri", "left_anti"))
            bare = settle(bare.join(orphans, "uri", "left_anti"))
        left_src = left_src.join(edges.select(*key), key, "left_semi")
        left_links = left_links.join(nodes.select("uri"), "uri", "left_semi")
        enriched = self.table("enriched_chunks").join(gone, "chunk_id", "left_anti")
        self.save({"nodes": nodes, "edges": edges, "edge_sources": left_src, "node_chunks": left_links, "enriched_chunks": enriched})

    def load(self) -> Graph:
        """The stored graph; relations and nodes carry chunk ids, typings the row identity of their uri."""
        nodes, edges, schema = self.table("nodes"), self.table("edges"), self.table("schema")
        none = F.array().cast("array<string>")
        chunks = self.table("node_chunks").groupBy("uri").agg(F.array_sort(F.collect_set("chunk_id")).alias("source_chunks"))
        src = self.table("edge_sources").filter("source_type = 'chunk'").groupBy("subject_uri", "predicate", "object_uri").agg(F.array_sort(F.collect_set("source_id")).alias("source_chunks"))
        named = nodes.filter("coalesce(label, '') <> ''")
        lab = named.select("uri", F.col("label").alias("l"))
        full = named.join(chunks, "uri", "left").withColumn("source_chunks", F.coalesce("source_chunks", none))
        e = edges.join(lab.toDF("subject_uri", "s"), "subject_uri", "left").join(lab.toDF("object_uri", "o"), "object_uri", "left")
        info = schema.filter("element_type = 'Class'").select(F.col("element_name").alias("label"), "description", "parent_class", F.when(F.col("source").isin("csv", "db"), "table").otherwise("").alias("source"))
        classes = full.filter("kind = 'concept'").join(info, "label", "left").select(F.col("label").alias("name"), "description", F.col("parent_class").alias("parent"), "source", "source_chunks", "ord")
        ident = F.when(F.startswith("uri", F.lit(ROW)), F.substr(F.col("uri"), F.lit(len(INSTANCE) + 1))).otherwise("")
        typed = e.filter("edge_kind = 'instanceOf'").select(F.col("subject_uri").alias("uri"), F.col("o").alias("class_name"), F.col("ord").alias("_eo"))
        inst = full.filter("kind = 'instance'").join(typed, "uri", "left").select(F.col("label").alias("name"), F.coalesce("class_name", F.lit("")).alias("class_name"), ident.alias("identity"), "source_chunks", F.coalesce("_eo", "ord").alias("ord"))
        rel = e.filter("edge_kind = 'objectProperty'").join(src, ["subject_uri", "predicate", "object_uri"], "left")
        rel = rel.select(F.col("s").alias("subject"), F.when(F.col("predicate") == LEGACY_RELATED, X.RELATED).otherwise(F.col("predicate")).alias("predicate"), F.col("o").alias("object"), F.lit("ObjectProperty").alias("predicate_type"), "label", F.col("edge_weight").alias("weight"), F.coalesce("source_chunks", none).alias("source_chunks"), "ord")
        vals = full.filter("attrs is not null").select(F.col("label").alias("entity"), F.explode("attrs").alias("property", "_v"), "source_chunks", "ord").select("entity", "property", F.explode("_v").alias("value"), F.lit("xsd:string").alias("value_type"), "source_chunks", "ord")
        at = place("element_name").alias("ord")
        ops = schema.filter("element_type = 'ObjectProperty'").select(F.col("element_name").alias("name"), F.coalesce("domain_class", F.lit("")).alias("domain"), F.coalesce("range_value", F.lit("")).alias("range"), "description", at)
        dps = schema.filter("element_type = 'DatatypeProperty'").select(F.col("element_name").alias("name"), F.coalesce("domain_class", F.lit("")).alias("domain"), F.col("range_value").alias("range"), F.col("element_name").alias("display_name"), at)
        up = e.filter("edge_kind = 'subClassOf'").select(F.col("o").alias("parent"), F.col("s").alias("child"), "ord")
        ids = self.table("node_chunks").select(F.col("chunk_id").alias("id")).distinct()
        return graph(self.spark, classes=classes, instances=inst, relations=rel, data_values=vals, object_props=ops, data_props=dps, hierarchy=up, chunks=ids, enriched=self.table("enriched_chunks"), uris=self.label_uris())


def rename_legacy(edges: DataFrame) -> DataFrame:
    """The old neighbour predicate by its new name; where both are, the new one holds."""
    key = ["subject_uri", "object_uri"]
    old = edges.filter((F.col("predicate") == LEGACY_RELATED) & (F.col("edge_kind") == "objectProperty"))
    rest = edges.filter(~((F.col("predicate") == LEGACY_RELATED) & (F.col("edge_kind") == "objectProperty")))
    fresh = old.join(rest.filter(F.col("predicate") == X.RELATED).select(*key), key, "left_anti")
    return rest.unionByName(fresh.withColumn("predicate", F.lit(X.RELATED)).withColumn("predicate_uri", F.lit(DOMAIN + X.RELATED)).select(*rest.columns))


def drop_superseded(edges: DataFrame, sources: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without stored relatedTo between nodes that a new named relation links, unless the new graph holds it too."""
    pair = lambda df: df.select(F.least("subject_uri", "object_uri").alias("_a"), F.greatest("subject_uri", "object_uri").alias("_b")).distinct()
    obj = new.filter("edge_kind = 'objectProperty'")
    named = pair(obj.filter(F.col("predicate") != X.RELATED)).join(pair(obj.filter(F.col("predicate") == X.RELATED)), ["_a", "_b"], "left_anti").withColumn("_n", F.lit(True))

    def cut(df: DataFrame) -> DataFrame:
        m = df.withColumn("_a", F.least("subject_uri", "object_uri")).withColumn("_b", F.greatest("subject_uri", "object_uri")).join(named, ["_a", "_b"], "left")
        return m.filter(~(F.coalesce("_n", F.lit(False)) & (F.col("predicate") == X.RELATED))).select(*df.columns)

    return cut(edges), cut(sources)
