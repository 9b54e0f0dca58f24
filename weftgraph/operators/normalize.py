"""Normalisation of a graph by the store's loading rules, as a sequence of set operations, and merges of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.functions import text as T
from weftgraph.functions import values as V
from weftgraph.schemas import Graph, conform, settled
from weftgraph.session import settle

RESERVED = {
    "instanceOf": "instanceOf", "instance_of": "instanceOf", "isA": "instanceOf", "is_a": "instanceOf", "type": "instanceOf", "rdf:type": "instanceOf",
    "subClassOf": "subClassOf", "subclass_of": "subClassOf", "rdfs:subClassOf": "subClassOf", "sameAs": "sameAs", "same_as": "sameAs", "owl:sameAs": "sameAs",
}
LEGACY_RELATED = "관련"
VOCABULARY = (T.RELATED, LEGACY_RELATED, "sameAs", "instanceOf", "subClassOf")
DATATYPES = ("string", "integer", "decimal", "date", "boolean", "number")


def first(df: DataFrame, *keys: str) -> DataFrame:
    """The row of least ord of each key."""
    w = W.partitionBy(*keys).orderBy("ord")
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merge_rows(df: DataFrame, keys: list[str], firsts: dict[str, bool], chunks: bool = True, **more) -> DataFrame:  # noqa: ANN003
    """One row a key: first values (True: first that is not empty), chunks united in order, the least ord."""
    aggs = []
    for c, filled in firsts.items():
        v = F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(c)) if filled else F.col(c)
        aggs.append(F.min_by(v, F.when(v.isNotNull(), F.col("ord")) if filled else F.col("ord")).alias(c))
    if chunks:
        steps = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("source_chunks", F.array().cast("array<string>")).alias("c"))))
        aggs.append(F.array_distinct(F.flatten(F.transform(steps, lambda s: s["c"]))).alias("source_chunks"))
    return df.groupBy(*keys).agg(*aggs, *[v.alias(k) for k, v in more.items()], F.min("ord").alias("ord"))


def relabel(g: Graph) -> Graph:
    """The canonical spelling of every name: the distinct names go through the UDF once."""
    cols = {
        "classes": ("name", "parent"), "object_props": ("name", "domain", "range"), "data_props": ("name", "domain"), "hierarchy": ("parent", "child"),
        "instances": ("name", "class_name"), "relations": ("subject", "object"), "data_values": ("entity",),
    }
    stripped = {"relations": "predicate", "data_values": "property"}

    def one(kind: str, df: DataFrame) -> DataFrame:
        if kind not in cols:
            return df
        # plain ASCII names without anything to strip stay on the JVM
        plain = lambda c: F.col(c).rlike("^[A-Za-z0-9](?:[A-Za-z0-9 _]*[A-Za-z0-9])?$") & ~F.col(c).rlike("  |^\\d{1,3}[ ]|^([A-Za-z0-9] )+[A-Za-z0-9]$")
        out = df
        for c in cols[kind]:
            new = T.normalize_label_udf(F.when(~plain(c), F.col(c)).otherwise(F.lit("")))
            out = out.withColumn(c, F.when(plain(c), F.col(c)).otherwise(F.coalesce(new, F.lit(""))))
        if kind in stripped:
            out = out.withColumn(stripped[kind], F.trim(F.coalesce(F.col(stripped[kind]), F.lit(""))))
        return out

    return g.map(one)


def normalize_graph(g: Graph, structural: tuple[str, ...] = (), relabelled: bool = False) -> Graph:
    """The loading rules; ``relabelled``: names are in canonical spelling already. Nothing is collected: each rule is a plan."""
    if not relabelled:
        g = relabel(g)
    g = settled(g)
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    fits = lambda c: V.is_class_name(F.col(c))
    named = g.instances.filter(empty("identity") != "").select("name").distinct()
    # classes
    classes = merge_rows(g.classes.filter(fits("name")), ["name"], {"description": True, "parent": True, "source": False})
    # relations that are something else
    flagged = named.withColumnRenamed("name", "subject").withColumn("_row", F.lit(True))
    rel = g.relations.join(flagged, "subject", "left").filter((empty("subject") != "") & (empty("predicate") != "") & (empty("object") != "") & (~V.is_value_like(F.col("subject")) | F.col("_row"))).drop("_row")
    reserved = F.create_map(*[F.lit(x) for kv in RESERVED.items() for x in kv])
    rel = rel.withColumn("_kind", F.try_element_at(reserved, F.col("predicate")))
    sub = rel.filter((F.col("_kind") == "subClassOf") & fits("subject") & fits("object") & (F.col("subject") != F.col("object")))
    typed = rel.filter((F.col("_kind") == "instanceOf") & fits("object"))
    same = rel.filter((F.col("_kind") == "sameAs") & (F.col("subject") != F.col("object"))).groupBy("subject").agg(F.max_by("object", "ord").alias("_same"))
    plain = rel.filter(F.col("_kind").isNull()).drop("_kind")
    # properties
    data_props = first(g.data_props.filter((empty("name") != "") & ((empty("domain") == "") | fits("domain"))), "name", "domain")
    datatype = F.startswith(F.lower(F.trim(empty("range"))), F.lit("xsd:")) | F.lower(F.trim(empty("range"))).isin(*DATATYPES)
    ok = lambda c: (empty(c) == "") | fits(c)
    object_props = first(g.object_props.filter((empty("name") != "") & ~datatype & ok("domain") & ok("range")), "name", "domain", "range")
    declared_d = data_props.select(F.col("name").alias("predicate"), F.lit(True).alias("_d")).distinct()
    declared_o = object_props.select(F.col("name").alias("predicate"), F.lit(True).alias("_o")).distinct()
    marked = plain.join(declared_d, "predicate", "left").join(declared_o, "predicate", "left").join(named.select(F.col("name").alias("object"), F.lit(True).alias("_row")), "object", "left")
    attribute = F.when(F.col("predicate_type") == "DatatypeProperty", True).when(F.col("_d") & F.col("_o").isNull(), True).when(F.col("_o") & F.col("_d").isNull(), False).otherwise(V.is_value_like(F.col("object")) & F.col("_row").isNull())
    marked = settle(marked.withColumn("_attr", attribute), "marked")
    to_values = marked.filter("_attr").select(F.col("subject").alias("entity"), F.col("predicate").alias("property"), F.col("object").alias("value"), F.lit("xsd:string").alias("value_type"), "source_chunks", (F.col("ord") + (1 << 60)).alias("ord"))
    rel = conform(marked.filter("not _attr"), "relations")
    # instances: types that are no classes go, typings come, sameAs is followed one step
    rename = lambda df, c: df.join(same.withColumnRenamed("subject", c), c, "left").withColumn(c, F.coalesce("_same", F.col(c))).drop("_same")
    inst = g.instances.withColumn("class_name", F.when(fits("class_name"), F.col("class_name")).otherwise(""))
    inst = conform(inst, "instances").unionByName(conform(typed.select(F.col("subject").alias("name"), F.col("object").alias("class_name"), F.lit("").alias("identity"), "source_chunks", (F.col("ord") + (1 << 60)).alias("ord")), "instances"))
    inst = merge_rows(rename(inst, "name").filter(empty("name") != ""), ["name", "class_name"], {"identity": False})
    has_type = inst.filter("class_name <> ''").select("name").distinct().withColumn("_t", F.lit(True))
    inst = inst.join(has_type, "name", "left").filter("class_name <> '' or _t is null").drop("_t")
    inst = settle(inst, "instances")
    rel = settle(rename(rename(rel, "subject"), "object"), "relations")
    values = rename(conform(g.data_values, "data_values").unionByName(conform(to_values, "data_values")), "entity")
    row_names = named.select(F.col("name").alias("entity"), F.lit(True).alias("_row"))
    values = values.join(row_names, "entity", "left").filter((empty("entity") != "") & (empty("property") != "") & F.col("value").isNotNull() & (~V.is_value_like(F.col("entity")) | F.col("_row"))).drop("_row")
    values = settle(first(values, "entity", "property", "value"), "values")
    # classes that are referred to
    refs = [data_props.select("domain"), object_props.select("domain"), object_props.select("range"), sub.select("object"), sub.select("subject"), typed.select("object"), g.instances.select("class_name")]
    wanted = refs[0].toDF("name")
    for r in refs[1:]:
        wanted = wanted.unionByName(r.toDF("name"))
    hierarchy = conform(g.hierarchy, "hierarchy").unionByName(sub.select(F.col("object").alias("parent"), F.col("subject").alias("child"), (F.col("ord") + (1 << 60)).alias("ord")))
    hierarchy = first(hierarchy.filter(fits("parent") & fits("child") & (F.col("parent") != F.col("child"))), "parent", "child")
    # ends must be known, declared or look like entities
    known = inst.select("name").unionByName(classes.select("name")).unionByName(wanted.filter(fits("name"))).distinct().withColumn("_k", F.lit(True))
    spawns = ~F.col("predicate").isin(*structural) if structural else F.lit(True)
    for end in ("subject", "object"):
        rel = rel.join(known.withColumnRenamed("name", end), end, "left").filter(F.col("_k").isNotNull() | ~spawns | V.is_entity_shape(F.col(end))).drop("_k")
    values = values.join(known.withColumnRenamed("name", "entity"), "entity", "left").filter(F.col("_k").isNotNull() | V.is_entity_shape(F.col("entity"))).drop("_k")
    # predicates, merges, weights
    pred, label = T.canon_predicate(F.col("predicate"))
    rel = rel.withColumn("label", F.when(spawns, F.coalesce(F.nullif(F.col("label"), F.lit("")), label)).otherwise(F.col("label"))).withColumn("predicate", F.when(spawns, pred).otherwise(F.col("predicate")))
    merged = merge_rows(rel, ["subject", "predicate", "object"], {"predicate_type": False, "label": True}, summed=F.sum(F.coalesce(F.nullif(F.col("weight"), F.lit(0.0)), F.lit(1.0))))
    stated = F.size(F.filter("source_chunks", lambda c: c != ""))
    merged = merged.withColumn("weight", F.when(stated > 0, stated.cast("double")).otherwise(F.col("summed"))).drop("summed")
    merged = settle(merged, "merged")
    pair = [F.least("subject", "object").alias("_a"), F.greatest("subject", "object").alias("_b")]
    names = merged.filter(~F.col("predicate").isin(*VOCABULARY)).select(*pair).distinct().withColumn("_named", F.lit(True))
    paired = merged.withColumn("_a", pair[0]).withColumn("_b", pair[1]).join(names, ["_a", "_b"], "left")
    gone = paired.filter((F.col("predicate") == T.RELATED) & F.col("_named"))
    moved = gone.select(F.explode(F.array("subject", "object")).alias("name"), "source_chunks", "ord").groupBy("name").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source_chunks"))), lambda s: s["source_chunks"]))).alias("_more"))
    rel = conform(paired.filter(~((F.col("predicate") == T.RELATED) & F.coalesce("_named", F.lit(False)))), "relations")
    head = inst.groupBy("name").agg(F.min("ord").alias("ord")).join(moved, "name")
    inst = inst.join(head, ["name", "ord"], "left").withColumn("source_chunks", F.when(F.col("_more").isNotNull(), F.array_union("source_chunks", F.filter("_more", lambda c: c != ""))).otherwise(F.col("source_chunks"))).drop("_more")
    # classes take what no instance did
    extra = first(hierarchy.select(F.explode(F.array("parent", "child")).alias("name"), "ord"), "name").select("name").unionByName(wanted).filter(fits("name")).distinct()
    new = extra.join(classes.select("name"), "name", "left_anti").select("name", F.lit("").alias("description"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("source"), F.array().cast("array<string>").alias("source_chunks"), ((1 << 61) + F.pmod(F.xxhash64("name"), F.lit(1 << 40))).cast("bigint").alias("ord"))
    classes = conform(classes, "classes").unionByName(conform(new, "classes"))
    to_class = moved.join(inst.select("name"), "name", "left_anti")
    classes = classes.join(to_class, "name", "left").withColumn("source_chunks", F.when(F.col("_more").isNotNull(), F.array_union("source_chunks", "_more")).otherwise(F.col("source_chunks"))).drop("_more")
    # ends that nobody stated become instances
    ends = [rel.filter(spawns).select(F.col(e).alias("name"), "source_chunks", "ord") for e in ("subject", "object")] + [values.select(F.col("entity").alias("name"), "source_chunks", "ord")]
    all_ends = ends[0].unionByName(ends[1]).unionByName(ends[2])
    unknown = all_ends.join(inst.select("name").unionByName(classes.select("name")).distinct(), "name", "left_anti").filter("name <> ''")
    spawned = merge_rows(unknown, ["name"], {}).select("name", F.lit("").alias("class_name"), F.lit("").alias("identity"), "source_chunks", (F.col("ord") + (1 << 61)).alias("ord"))
    inst = conform(inst, "instances").unionByName(conform(spawned, "instances"))
    return g.with_(classes=conform(classes, "classes"), object_props=conform(object_props, "object_props"), data_props=conform(data_props, "data_props"), hierarchy=conform(hierarchy, "hierarchy"), instances=inst, relations=rel, data_values=conform(values, "data_values"))


def merge(into: Graph, new: Graph) -> Graph:
    """Both graphs; classes and properties by name (a property's domain doesn't count), the first record holds."""
    half = F.least(F.shiftright(F.greatest("ord", F.lit(0)), 1), F.lit((1 << 61) - 1))  # room for both, however often graphs are merged
    put = lambda g, first: g.map(lambda kind, df: df.withColumn("ord", half if first else half + (1 << 61)) if "ord" in df.columns else df)
    one, two = put(into, True), put(new, False)
    both = Graph(**{k: conform(getattr(one, k), k).unionByName(conform(getattr(two, k), k)) for k in into.__dataclass_fields__})
    return both.with_(
        classes=first(both.classes, "name"), object_props=first(both.object_props, "name"), data_props=first(both.data_props, "name"),
        hierarchy=first(both.hierarchy, "parent", "child"), chunks=both.chunks.dropDuplicates(["id"]), enriched=both.enriched.distinct(),
    )


def rename_names(g: Graph, names: DataFrame, classes: bool = False) -> Graph:
    """Applies (name, canonical) to instances and what refers to them, or to classes and theirs; merges what then meets."""
    cols = {
        "classes": ("name", "parent"), "object_props": ("domain", "range"), "data_props": ("domain",), "hierarchy": ("parent", "child"), "instances": ("class_name",),
    } if classes else {"instances": ("name",), "relations": ("subject", "object"), "data_values": ("entity",)}

    def one(kind: str, df: DataFrame) -> DataFrame:
        for c in cols.get(kind, ()):
            df = df.join(names.select(F.col("name").alias(c), F.col("canonical").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", F.col(c))).drop("_to")
        return conform(df, kind) if kind in cols else df

    out = g.map(one)
    if classes:
        merged = merge_rows(out.classes, ["name"], {"description": True, "parent": True, "source": False})
        return out.with_(classes=conform(merged, "classes"), hierarchy=first(out.hierarchy.filter("parent <> child"), "parent", "child"))
    return out.with_(instances=conform(merge_rows(out.instances, ["name", "class_name"], {"identity": False}), "instances"))


def reconcile_identities(g: Graph) -> Graph:
    """One individual for each row identity: the last typed record, else the first; the others' names and chunks move to it."""
    rows = g.instances.filter("coalesce(identity, '') <> ''").withColumn("_typed", F.coalesce("class_name", F.lit("")) != "")
    best = rows.groupBy("identity").agg(F.max_by("name", F.struct("_typed", F.when(F.col("_typed"), F.col("ord")).otherwise(-F.col("ord")))).alias("canonical"))
    names = rows.join(best, "identity").filter("name <> canonical").select("name", "canonical").distinct()
    out = rename_names(g, names.groupBy("name").agg(F.min("canonical").alias("canonical")))
    # a placeholder's untyped record goes when its row has come
    inst = out.instances
    typed = inst.filter("class_name <> ''").select("name").distinct().withColumn("_t", F.lit(True))
    return out.with_(instances=conform(inst.join(typed, "name", "left").filter("class_name <> '' or _t is null"), "instances"))


def known_predicates(relations: DataFrame, limit: int = 120) -> DataFrame:
    return relations.filter("coalesce(predicate, '') <> ''").groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate").limit(limit)


def stats(g: Graph) -> DataFrame:
    """One row of counts."""
    parts = {"classes": g.classes, "object_properties": g.object_props, "data_properties": g.data_props, "relations": g.relations, "data_values": g.data_values, "chunks": g.chunks}
    out = g.instances.agg(F.countDistinct("name").alias("instances"))
    for k, df in parts.items():
        out = out.join(df.agg(F.count("*").alias(k)))  # each side is one row
    return out
