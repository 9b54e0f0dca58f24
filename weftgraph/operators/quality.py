"""A quality report: one row of counts and scores, from joins of names and an aggregate each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.schemas import Graph

WEIGHTS = {"completeness": 0.40, "integrity": 0.25, "grounding": 0.20, "shape": 0.15}


def review_quality(g: Graph) -> DataFrame:
    """class_count to quality_score, as a row. A name with several types counts by the last one."""
    some = lambda df, c, a: df.filter(F.coalesce(F.col(c), F.lit("")) != "").select(F.col(c).alias(a)).distinct()
    flag = lambda df, name: df.withColumn(name, F.lit(True))
    cls, inst = some(g.classes, "name", "n"), some(g.instances, "name", "n")
    used = some(g.instances, "class_name", "n")
    domains = some(g.object_props, "domain", "n").unionByName(some(g.data_props, "domain", "n"))
    ends = some(g.object_props, "domain", "n").unionByName(some(g.object_props, "range", "n"))
    marks = cls.join(flag(used, "u"), "n", "left").join(flag(some(g.hierarchy, "parent", "n"), "p"), "n", "left")
    marks = marks.join(flag(domains.distinct(), "d"), "n", "left").join(flag(ends.distinct(), "e"), "n", "left")
    by_class = marks.agg(F.count("*").alias("class_count"), F.count_if(F.expr("u is null and p is null and d is null")).alias("classes_without_instance"), F.count_if(F.expr("u is null and e is null")).alias("orphan_class_count"))
    rel = g.relations.filter("coalesce(predicate_type, '') <> 'DatatypeProperty'")
    nodes = flag(inst.unionByName(cls).distinct(), "k")
    last = g.instances.filter("coalesce(name, '') <> ''").groupBy("name").agg(F.max_by("class_name", "ord").alias("c"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("source_chunks", F.array().cast("array<string>"))))).alias("ch"))
    of = lambda end, t: last.select(F.col("name").alias(end), F.col("c").alias(f"{t}c"), F.col("ch").alias(f"{t}h"), F.lit(True).alias(f"{t}i"))
    props = g.object_props.filter("coalesce(name, '') <> '' and coalesce(domain, '') <> ''").groupBy(F.col("name").alias("predicate")).agg(F.max_by("domain", "ord").alias("dom"))
    r = rel.join(nodes.select(F.col("n").alias("subject"), F.col("k").alias("sk")), "subject", "left").join(nodes.select(F.col("n").alias("object"), F.col("k").alias("ok")), "object", "left")
    r = r.join(of("subject", "s"), "subject", "left").join(of("object", "o"), "object", "left").join(props, "predicate", "left")
    lost = F.expr("(coalesce(subject, '') <> '' and sk is null) or (coalesce(object, '') <> '' and ok is null)")
    within = F.expr("si and oi")
    bare = F.size(F.coalesce("source_chunks", F.array().cast("array<string>"))) == 0
    apart = bare & ~F.coalesce(F.arrays_overlap("sh", "oh"), F.lit(False))
    by_rel = r.agg(
        F.count_if(lost).alias("dangling"), F.count_if(within).alias("inst_relations"), F.count_if(within & apart).alias("_ungrounded"),
        F.count_if(F.expr("dom is not null and si and sc <> dom")).alias("domain_violation"), F.count_if(~bare).alias("_marked"),
    )
    typed = g.instances.filter("coalesce(name, '') <> ''").join(flag(cls.withColumnRenamed("n", "class_name"), "k"), "class_name", "left")
    by_inst = typed.agg(F.countDistinct("name").alias("instance_count"), F.count_if(F.expr("k is null")).alias("untyped"), F.count_if(F.size(F.coalesce("source_chunks", F.array().cast("array<string>"))) > 0).alias("_im"))
    names = some(g.object_props, "name", "n")
    by_pred = names.agg(F.count("*").alias("relation_count"))
    wild = some(rel, "predicate", "n").join(names, "n", "left_anti").agg(F.count("*").alias("ungoverned"))
    row = by_class.join(by_rel).join(by_inst).join(by_pred).join(wild)  # rows of one each
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    complete = F.when(F.col("class_count") > 0, F.round(100.0 * (F.col("class_count") - F.col("classes_without_instance")) / F.col("class_count"), 1)).otherwise(0.0)
    loose = F.when((F.col("_marked") > 0) | (F.col("_im") > 0), F.col("_ungrounded")).otherwise(0)
    grounding = F.when((F.col("inst_relations") > 0), F.round(100.0 * (F.col("inst_relations") - loose) / F.col("inst_relations"), 1)).otherwise(100.0)
    integrity = F.when(F.col("inst_relations") + F.col("dangling") > 0, 100.0 * (1 - F.col("dangling") / (F.col("inst_relations") + F.col("dangling")))).otherwise(100.0)
    off = 0.4 * ratio(F.col("untyped"), F.col("instance_count")) + 0.3 * ratio(F.col("ungoverned"), F.col("relation_count") + F.col("ungoverned")) + 0.3 * F.least(F.lit(1.0), ratio(F.col("domain_violation"), F.col("inst_relations")))
    shape = 100.0 * (1 - F.least(F.lit(1.0), off))
    out = row.withColumn("completeness_pct", complete).withColumn("ungrounded", loose).withColumn("grounding_pct", grounding).withColumn("integrity_score", F.round(integrity, 6)).withColumn("shape_score", F.round(shape, 6))
    score = WEIGHTS["completeness"] * complete + WEIGHTS["integrity"] * integrity + WEIGHTS["shape"] * shape + WEIGHTS["grounding"] * grounding
    warn = F.array_compact(F.array(
        F.when(F.col("dangling") > 0, F.concat(F.col("dangling").cast("string"), F.lit(" dangling references"))),
        F.when((F.col("class_count") > 0) & (complete < 50), F.lit("few classes have instances")),
        F.when(F.col("untyped") > 0, F.concat(F.col("untyped").cast("string"), F.lit(" untyped instances"))),
        F.when(F.col("ungoverned") > 0, F.concat(F.col("ungoverned").cast("string"), F.lit(" undeclared predicates"))),
        F.when(F.col("domain_violation") > 0, F.concat(F.col("domain_violation").cast("string"), F.lit(" domain violations"))),
        F.when((F.col("inst_relations") > 0) & (grounding < 80), F.lit("few relations share a source")),
        F.when(F.col("orphan_class_count") > 0, F.concat(F.col("orphan_class_count").cast("string"), F.lit(" orphan classes"))),
    ))
    return out.withColumn("quality_score", F.round(score, 1)).withColumn("warnings", F.to_json(warn)).drop("_ungrounded", "_marked", "_im")
