"""Reads over stored nodes (uri, kind, label, attrs), edges and node_chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.schemas import Graph




def query_tokens(query: str, most: int = 12) -> list[str]:
    import re

    return [t for t in dict.fromkeys(re.findall(r"[a-z0-9]+|[가-힣぀-ヿ一-鿿]+", query.lower())) if len(t) >= 2][:most]


def search_labels(nodes: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """(uri, label, kind, score): labels that hold some token; hits, less for long labels."""
    tokens = query_tokens(query)
    if not tokens:
        return nodes.select("uri", "label", "kind", F.lit(0.0).alias("score")).limit(0)
    low = F.lower("label")
    hits = sum((F.contains(low, F.lit(t)).cast("int") for t in tokens), F.lit(0))
    score = F.round(hits / (1 + F.length("label") / 40), 6)
    return nodes.withColumn("_h", hits).filter("_h > 0").select("uri", "label", "kind", score.alias("score")).orderBy(F.desc("score"), "label", "uri").limit(limit)


def get_node(nodes: DataFrame, node: str) -> DataFrame:
    """By uri, or by label: classes before instances before the rest."""
    return nodes.filter((F.col("uri") == node) | (F.col("label") == node)).orderBy((F.col("uri") != node).cast("int"), F.when(F.col("kind") == "concept", 0).when(F.col("kind") == "instance", 1).otherwise(2), "uri").limit(1)


def class_instances(nodes: DataFrame, edges: DataFrame, class_uri: str, limit: int = 1000) -> DataFrame:
    of = edges.filter((F.col("edge_kind") == "instanceOf") & (F.col("object_uri") == class_uri)).select(F.col("subject_uri").alias("uri")).distinct()
    return nodes.join(of, "uri", "left_semi").select("uri", "label", "kind").orderBy("label", "uri").limit(limit)


def count_class(edges: DataFrame, class_uri: str) -> DataFrame:
    return edges.filter((F.col("edge_kind") == "instanceOf") & (F.col("object_uri") == class_uri)).agg(F.count("*").alias("n"))


def neighbors(nodes: DataFrame, edges: DataFrame, start: str, hops: int = 1, limit: int = 100) -> DataFrame:
    """(hop, subject, predicate, object): edges met on a breadth-first walk, each at its first hop."""
    spark = nodes.sparkSession
    real = edges.filter("edge_kind in ('objectProperty', 'instanceOf', 'subClassOf')").select("subject_uri", "predicate", "object_uri")
    front = spark.createDataFrame([(start,)], "uri string")
    seen, out = front, None
    for hop in range(1, hops + 1):
        got = real.join(front.withColumnRenamed("uri", "subject_uri"), "subject_uri", "left_semi").unionByName(real.join(front.withColumnRenamed("uri", "object_uri"), "object_uri", "left_semi")).distinct()
        part = got.withColumn("hop", F.lit(hop))
        out = part if out is None else out.unionByName(part)
        ends = got.select(F.explode(F.array("subject_uri", "object_uri")).alias("uri")).distinct()
        front = ends.join(seen, "uri", "left_anti")
        seen = seen.unionByName(front)
    first = out.groupBy("subject_uri", "predicate", "object_uri").agg(F.min("hop").alias("hop"))
    names = nodes.select("uri", "label")
    named = first.join(names.toDF("subject_uri", "subject"), "subject_uri", "left").join(names.toDF("object_uri", "object"), "object_uri", "left")
    return named.select("hop", F.coalesce("subject", "subject_uri").alias("subject"), "predicate", F.coalesce("object", "object_uri").alias("object")).orderBy("hop", "subject", "predicate", "object").limit(limit)


def entity_labels(nodes: DataFrame, edges: DataFrame, limit: int = 300) -> DataFrame:
    """(label, degree) of the best connected instances."""
    degree = edges.filter("edge_kind = 'objectProperty'").select(F.explode(F.array("subject_uri", "object_uri")).alias("uri")).groupBy("uri").agg(F.count("*").alias("degree"))
    return nodes.filter("kind = 'instance'").join(degree, "uri", "left").select("label", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), "label").limit(limit)


def predicates(edges: DataFrame, limit: int = 120) -> DataFrame:
    return edges.filter("edge_kind = 'objectProperty'").groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate").limit(limit)


def counts(nodes: DataFrame, edges: DataFrame, node_chunks: DataFrame) -> DataFrame:
    """(what, n) by kind, of edges and of distinct chunks."""
    by_kind = nodes.groupBy(F.col("kind").alias("what")).agg(F.count("*").alias("n"))
    return by_kind.unionByName(edges.agg(F.lit("edges").alias("what"), F.count("*").alias("n"))).unionByName(node_chunks.agg(F.lit("chunks").alias("what"), F.countDistinct("chunk_id").alias("n")))


def graph_nodes(g: Graph) -> DataFrame:
    """(id, label, kind): a name that is a class and an instance is a class."""
    both = g.classes.select("name", F.lit(0).alias("r")).unionByName(g.instances.select("name", F.lit(1).alias("r"))).filter("coalesce(name, '') <> ''")
    first = both.groupBy("name").agg(F.min("r").alias("r"))
    return first.select(F.col("name").alias("id"), F.col("name").alias("label"), F.when(F.col("r") == 0, "class").otherwise("instance").alias("kind"))


def graph_edges(g: Graph) -> DataFrame:
    """(subject, predicate, object): typings, hierarchy and object relations, a bag."""
    typed = g.instances.filter("coalesce(class_name, '') <> ''").select(F.col("name").alias("subject"), F.lit("instanceOf").alias("predicate"), F.col("class_name").alias("object"))
    up = g.hierarchy.select(F.col("child").alias("subject"), F.lit("subClassOf").alias("predicate"), F.col("parent").alias("object"))
    return typed.unionByName(up).unionByName(g.relations.filter("coalesce(predicate_type, '') <> 'DatatypeProperty'").select("subject", "predicate", "object"))


LABEL, TYPE, SUBCLASS = "http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2000/01/rdf-schema#subClassOf"


def local_name(uri):  # noqa: ANN001, ANN201
    return F.regexp_extract(uri, "([^#/]*)$", 1)


def triples_search(triples: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """(s, label, score): over label triples, cut before scoring; a hit at least."""
    tokens = query_tokens(query, 8)
    low = F.lower("o")
    any_ = F.lit(False)
    hits = F.lit(0)
    for t in tokens:
        any_ = any_ | F.contains(low, F.lit(t))
        hits = hits + F.contains(low, F.lit(t)).cast("int")
    few = triples.filter((F.col("p") == LABEL) & any_).orderBy("s", "o").limit(limit)
    return few.select("s", F.col("o").alias("label"), F.greatest(hits, F.lit(1)).alias("score")).orderBy(F.desc("score"), "s")


def triples_class_instances(triples: DataFrame, class_uri: str, limit: int = 1000) -> DataFrame:
    """Members and subclasses alike, by label or local name."""
    of = triples.filter(F.col("p").isin(TYPE, SUBCLASS) & (F.col("o") == class_uri) & ~F.col("o_is_literal")).select("s").distinct()
    labels = triples.filter(F.col("p") == LABEL).groupBy("s").agg(F.min("o").alias("label"))
    return of.join(labels, "s", "left").select("s", F.coalesce("label", local_name(F.col("s"))).alias("label")).orderBy("s").limit(limit)


def triples_neighbors(triples: DataFrame, uri: str, limit: int = 100) -> DataFrame:
    """Triples in and out, but for types and labels, one hop."""
    real = triples.filter(~F.col("p").isin(TYPE, LABEL) & ~F.col("o_is_literal"))
    both = real.filter(F.col("s") == uri).unionByName(real.filter((F.col("o") == uri) & (F.col("s") != uri)))
    labels = triples.filter(F.col("p") == LABEL).groupBy("s").agg(F.min("o").alias("l"))
    named = both.join(labels.toDF("s", "sl"), "s", "left").join(labels.toDF("o", "ol"), "o", "left")
    return named.select(F.coalesce("sl", local_name(F.col("s"))).alias("subject"), local_name(F.col("p")).alias("predicate"), F.coalesce("ol", local_name(F.col("o"))).alias("object")).limit(limit)


def triples_node(triples: DataFrame, uri: str) -> DataFrame:
    """(uri, label): the local name where nothing is known."""
    label = triples.filter((F.col("s") == uri) & (F.col("p") == LABEL)).agg(F.min("o").alias("l"))
    return label.select(F.lit(uri).alias("uri"), F.coalesce("l", local_name(F.lit(uri))).alias("label"))
