"""Retraction of chunks: what no remaining chunk states goes, in set operations, classes to a fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.schemas import Graph, conform, evidence, settled
from weftgraph.session import settle


def retract_chunks(g: Graph, gone: DataFrame, structural: tuple[str, ...] = ()) -> Graph:
    """``g`` without the chunks (chunk_id) and what they alone supported. Only classes are iterated, by joins."""
    g = settled(g)
    gone = settle(gone.select("chunk_id").distinct(), "gone")
    ev = settle(evidence(g), "evidence")
    hit = ev.join(gone, "chunk_id", "left_semi").select("name").distinct()
    left = ev.join(gone, "chunk_id", "left_anti").join(hit, "name", "left_semi")
    # names that lose some chunk, and how many they keep; the chunks stay rows, as a hub's are too many to hand to its relations
    remaining = settle(hit.join(left.groupBy("name").agg(F.count("*").alias("_n")), "name", "left").select("name", F.coalesce("_n", F.lit(0)).alias("_n")), "remaining")
    # relations: the chunks that stay, by explode, anti join and regroup (many sources may go at once)
    rel = g.relations.withColumn("_rid", F.xxhash64("subject", "predicate", "object", "label", "ord"))
    kept_chunks = rel.select("_rid", F.posexplode("source_chunks").alias("_p", "chunk_id")).join(gone, "chunk_id", "left_anti")
    kept_chunks = kept_chunks.groupBy("_rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "chunk_id"))), lambda s: s["chunk_id"]).alias("_keep"))
    of = lambda end, c: remaining.select(F.col("name").alias(end), F.col("_n").alias(c))
    own = F.size(F.filter("source_chunks", lambda c: c != "")) > 0
    is_object = F.coalesce("predicate_type", F.lit("")) != "DatatypeProperty"
    free = F.col("predicate").isin(*structural) if structural else F.lit(False)
    # what both ends keep counts for relations without sources of their own, and for values
    pairs = rel.filter(~F.coalesce(own, F.lit(False)) | ~is_object).select("subject", "object").distinct()
    both = _common(pairs.join(of("subject", "_ls"), "subject").join(of("object", "_lo"), "object").filter("_ls > 0 and _lo > 0"), left)
    r = rel.join(kept_chunks, "_rid", "left").join(of("subject", "_ls"), "subject", "left").join(of("object", "_lo"), "object", "left").join(both, ["subject", "object"], "left")
    shared = F.col("_both").isNotNull()
    dies = is_object & F.when(own, F.col("_keep").isNull()).otherwise(~free & F.col("_ls").isNotNull() & F.col("_lo").isNotNull() & ~shared)
    r = settle(r.filter(~dies), "relations")
    classes = g.classes.select("name").distinct()
    orphans = settle(remaining.filter("_n = 0").select("name").join(classes, "name", "left_anti"), "orphans")
    hit_classes = hit.join(classes, "name", "left_semi").unionByName(g.instances.join(orphans, "name", "left_semi").select(F.col("class_name").alias("name")).distinct().join(classes, "name", "left_semi")).distinct()
    stated = ev.join(gone, "chunk_id", "left_anti").select("name").distinct()
    ends = r.filter(is_object).select("subject", "object").join(orphans.withColumnRenamed("name", "subject"), "subject", "left_anti").join(orphans.withColumnRenamed("name", "object"), "object", "left_anti")
    bare = classes.filter("name <> ''").join(stated, "name", "left_anti").join(ends.select(F.explode(F.array("subject", "object")).alias("name")).distinct(), "name", "left_anti")
    dead = _dead_classes(g, bare, hit_classes, orphans)
    gone_names = orphans.unionByName(dead)
    keep = lambda df, c: df.join(gone_names.withColumnRenamed("name", c), c, "left_anti")

    keep_classes = lambda df, c: df.join(dead.withColumnRenamed("name", c), c, "left_anti")

    def chunks_left(df: DataFrame, *keys: str) -> DataFrame:
        d = df.withColumn("_id", F.xxhash64(*keys, "ord"))
        stay = d.select("_id", F.posexplode("source_chunks").alias("_p", "chunk_id")).join(gone, "chunk_id", "left_anti").groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "chunk_id"))), lambda s: s["chunk_id"]).alias("_keep"))
        return d.join(stay, "_id", "left").withColumn("source_chunks", F.coalesce("_keep", F.array().cast("array<string>"))).drop("_id", "_keep")

    instances = conform(chunks_left(keep(g.instances, "name"), "name", "class_name"), "instances")
    values = conform(chunks_left(keep(g.data_values, "entity"), "entity", "property", "value"), "data_values")
    touched = F.col("_ls").isNotNull() | F.col("_lo").isNotNull()
    borrowed = F.coalesce("_both", F.array().cast("array<string>"))
    stays = F.coalesce("_keep", F.array().cast("array<string>"))
    new = F.when(touched, F.when(F.size(stays) > 0, stays).otherwise(borrowed)).otherwise(F.coalesce("_keep", "source_chunks"))
    relations = conform(keep(keep(r.withColumn("source_chunks", new), "subject"), "object"), "relations")
    left_classes = chunks_left(keep(g.classes, "name"), "name")
    is_dead = lambda c, flag: dead.select(F.col("name").alias(c), F.lit(True).alias(flag))
    left_classes = left_classes.join(is_dead("parent", "_dead"), "parent", "left").withColumn("parent", F.when(F.col("_dead").isNull(), F.col("parent")))
    used_p, used_a = relations.select(F.col("predicate").alias("name")).distinct(), values.select(F.col("property").alias("name")).distinct()
    marked = lambda props, used: props.join(is_dead("domain", "_dd"), "domain", "left").join(is_dead("range", "_dr"), "range", "left").join(used.withColumn("_u", F.lit(True)), "name", "left")
    object_props = conform(marked(g.object_props, used_p).filter("(_dd is null and _dr is null) or _u is not null"), "object_props")
    data_props = conform(marked(g.data_props, used_a).filter("_dd is null or _u is not null"), "data_props")
    hierarchy = conform(keep_classes(keep_classes(g.hierarchy, "parent"), "child"), "hierarchy")
    chunks = g.chunks.join(gone.withColumnRenamed("chunk_id", "id"), "id", "left_anti").select(*g.chunks.columns)
    enriched = g.enriched.join(gone, "chunk_id", "left_anti")
    return g.with_(classes=conform(left_classes, "classes"), object_props=object_props, data_props=data_props, hierarchy=hierarchy, instances=instances, relations=relations, data_values=values, chunks=chunks, enriched=enriched)


def _common(pairs: DataFrame, left: DataFrame) -> DataFrame:
    """(subject, object, _both): the chunks in ``left`` (name, chunk_id) of both ends, where there are some; the end with fewer is looked up in the other."""
    fewer = F.col("_ls") <= F.col("_lo")
    few = pairs.withColumn("_few", F.when(fewer, F.col("subject")).otherwise(F.col("object"))).withColumn("_many", F.when(fewer, F.col("object")).otherwise(F.col("subject")))
    met = few.join(left.select(F.col("name").alias("_few"), "chunk_id"), "_few").join(left.select(F.col("name").alias("_many"), "chunk_id"), ["_many", "chunk_id"], "left_semi")
    return met.groupBy("subject", "object").agg(F.array_sort(F.collect_set("chunk_id")).alias("_both"))


def _dead_classes(g: Graph, bare: DataFrame, start: DataFrame, orphans: DataFrame) -> DataFrame:
    """(name) of ``bare`` classes that nothing refers to, round by round from ``start``; rounds are joins on written tables."""
    bare = settle(bare, "bare")
    candidates = settle(start.join(bare, "name", "left_semi"), "candidates")
    if not candidates.limit(1).count():
        return bare.limit(0)
    # name is referred to while "by" is there; with up, it is looked at again when "by" goes
    of = lambda df, by, name, up=True: df.select(F.col(by).alias("by"), F.col(name).alias("name"), F.lit(up).alias("up"))
    refs = of(g.hierarchy, "child", "parent").unionByName(of(g.classes, "name", "parent")).unionByName(of(g.object_props, "domain", "range")).filter("not (by <=> name)")
    # an instance goes later only as a class of that name; the others of a class are one row before the join on it
    typed = g.instances.select("name", "class_name").join(orphans, "name", "left_anti").join(bare.withColumn("_c", F.lit(True)), "name", "left").withColumn("_by", F.when(F.col("_c"), F.col("name")))
    refs = refs.join(orphans.withColumnRenamed("name", "by"), "by", "left_anti").unionByName(of(typed.select("_by", "class_name").distinct(), "_by", "class_name", False))
    refs = settle(refs.distinct().join(bare, "name", "left_semi").select("by", "name", "up"), "refs")
    dead = bare.limit(0)
    while True:
        new = settle(candidates.join(refs, "name", "left_anti"), "dead")
        if not new.limit(1).count():
            return dead
        dead = settle(dead.unionByName(new), "dead")
        went = new.withColumnRenamed("name", "by")
        candidates = settle(refs.filter("up").join(went, "by", "left_semi").select("name").distinct(), "candidates")
        refs = settle(refs.join(went, "by", "left_anti").select("by", "name", "up"), "refs")
