"""Predicates: one spelling each, one direction each, and names from a vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.functions import text as T

VOTES, RATIO = 4, 0.75


def govern_predicates(relations: DataFrame, object_props: DataFrame, seeds: list[str] | None = None, endings: str | None = T.ENDINGS) -> DataFrame:
    """Relations with predicates in the spelling of seeds, else of the schema, else the shortest, first seen."""
    spark = relations.sparkSession
    lean = relations.withColumn("predicate", F.trim(T.strip_argument_noun(F.trim("predicate"), F.coalesce("subject", F.lit("")), F.coalesce("object", F.lit("")))))
    lean = lean.withColumn("_norm", T.normalize_predicate(F.col("predicate"), endings))
    seed = spark.createDataFrame([(s, i) for i, s in enumerate(seeds or [])], "predicate string, ord bigint").withColumn("_rank", F.lit(0))
    schema = object_props.select(F.trim("name").alias("predicate"), "ord").withColumn("_rank", F.lit(1))
    used = lean.filter("_norm <> ''").groupBy("predicate").agg(F.min("ord").alias("ord")).withColumn("_rank", F.lit(2))
    names = seed.unionByName(schema).unionByName(used).withColumn("_norm", T.normalize_predicate(F.col("predicate"), endings)).filter("_norm <> ''")
    length = F.when(F.col("_rank") == 2, F.length("predicate")).otherwise(0)
    canon = names.groupBy("_norm").agg(F.min_by("predicate", F.struct("_rank", length, "ord")).alias("_canon"))
    return lean.join(canon, "_norm", "left").withColumn("predicate", F.coalesce("_canon", "predicate")).select(*relations.columns)


def vote_direction(relations: DataFrame, types: DataFrame, endings: str | None = T.ENDINGS) -> DataFrame:
    """Relations of the minority direction turned round: by (predicate, type pair), else by the roles of both ends.

    types: (name, class_name), one row a name.
    """
    of = lambda end, s: types.select(F.col("name").alias(end), F.nullif(F.col("class_name"), F.lit("")).alias(s))
    r = relations.withColumn("subject", F.trim("subject")).withColumn("object", F.trim("object")).withColumn("_p", T.normalize_predicate(F.col("predicate"), endings))
    r = r.join(of("subject", "_s"), "subject", "left").join(of("object", "_o"), "object", "left").withColumn("_s", F.coalesce("_s", "subject")).withColumn("_o", F.coalesce("_o", "object"))
    r = r.withColumn("_a", F.least("_s", "_o")).withColumn("_b", F.greatest("_s", "_o")).withColumn("_fwd", F.col("_s") == F.col("_a"))
    votes = r.filter("_p <> '' and _s <> '' and _o <> '' and _s <> _o").groupBy("_p", "_a", "_b").agg(F.count_if(F.col("_fwd")).alias("f"), F.count_if(~F.col("_fwd")).alias("v"))
    major = votes.filter((F.col("f") + F.col("v") >= VOTES) & (F.greatest("f", "v") / (F.col("f") + F.col("v")) >= RATIO)).select("_p", "_a", "_b", (F.col("f") >= F.col("v")).alias("_want"))
    ends = r.filter("_p <> '' and subject <> '' and object <> '' and subject <> object")
    role = ends.select("_p", F.explode(F.array(F.struct(F.col("subject").alias("name"), F.lit(1).alias("s"), F.lit(0).alias("o")), F.struct(F.col("object").alias("name"), F.lit(0).alias("s"), F.lit(1).alias("o")))).alias("x"))
    role = role.groupBy("_p", F.col("x.name").alias("name")).agg(F.sum("x.s").alias("rs"), F.sum("x.o").alias("ro"))
    side = lambda end, tag: role.select("_p", F.col("name").alias(end), F.col("rs").alias(f"_{tag}s"), F.col("ro").alias(f"_{tag}o"))
    both = r.join(major, ["_p", "_a", "_b"], "left").join(side("subject", "s"), ["_p", "subject"], "left").join(side("object", "o"), ["_p", "object"], "left")
    s_subj, s_obj, o_subj, o_obj = F.col("_ss") - 1, F.col("_so"), F.col("_os"), F.col("_oo") - 1
    enough = (s_subj + s_obj >= VOTES) & (o_subj + o_obj >= VOTES)
    turned = enough & (s_obj / F.greatest(F.lit(1), s_subj + s_obj) >= RATIO) & (o_subj / F.greatest(F.lit(1), o_subj + o_obj) >= RATIO)
    flip = F.when(F.col("_want").isNotNull(), F.col("_fwd") != F.col("_want")).otherwise(F.coalesce((F.col("_p") != "") & turned, F.lit(False)))
    out = both.withColumn("_flip", flip)
    return out.select(*[F.when(F.col("_flip"), F.col({"subject": "object", "object": "subject"}[c])).otherwise(F.col(c)).alias(c) if c in ("subject", "object") else F.col(c) for c in relations.columns])


def merge_predicates(relations: DataFrame, key: F.Column | None = None) -> DataFrame:
    """Predicates of one stem become the most frequent of them; one whose pairs all belong to another joins it.

    ``key``: the stem, of column predicate; numbers keep predicates apart.
    """
    stem = F.concat(key if key is not None else T.normalize_predicate(F.col("predicate")), F.regexp_replace("predicate", "\\D", ""))
    counts = relations.filter("predicate not in ('instanceOf', 'subClassOf') and trim(predicate) <> ''").groupBy("predicate").agg(F.count("*").alias("n")).withColumn("_stem", stem)
    canon = counts.groupBy("_stem").agg(F.max_by("predicate", F.struct("n", -F.length("predicate"), "predicate")).alias("_to"))
    names = counts.join(canon, "_stem").select("predicate", "_to", "n")
    once = relations.join(names, "predicate", "left").withColumn("predicate", F.coalesce("_to", "predicate")).drop("_to", "n")
    pairs = once.filter("predicate not in ('instanceOf', 'subClassOf')").select("predicate", "subject", "object").distinct()
    size = pairs.groupBy("predicate").agg(F.count("*").alias("n"))
    other = pairs.select(F.col("predicate").alias("_q"), "subject", "object")
    common = pairs.join(other, ["subject", "object"]).filter("predicate <> _q").groupBy("predicate", "_q").agg(F.count("*").alias("c"))
    inside = common.join(size, "predicate").join(size.select(F.col("predicate").alias("_q"), F.col("n").alias("m")), "_q")
    inside = inside.filter("c = n and (n < m or (n = m and predicate > _q))").groupBy("predicate").agg(F.max_by("_q", F.struct("m", "_q")).alias("_to"))
    last = once.join(inside, "predicate", "left").withColumn("predicate", F.coalesce("_to", "predicate")).drop("_to")
    w = W.partitionBy("subject", "predicate", "object").orderBy("ord")
    return last.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*relations.columns)


def vocabulary_of(object_props: DataFrame) -> DataFrame:
    """Declared predicates that are valid names, the first of each."""
    good = object_props.filter(F.col("name").rlike("^[A-Za-z][A-Za-z0-9_]*$"))
    return good.groupBy("name").agg(F.min_by("description", "ord").alias("description"), F.min("ord").alias("ord"))


def canonicalize_predicates(relations: DataFrame, vocabulary: DataFrame, mapping: DataFrame, frequent: int = 0) -> DataFrame:
    """Relations held to a vocabulary (name): mapped (predicate, to) names follow, frequent ones join it, others become relatedTo with a label."""
    known = vocabulary.select(F.col("name").alias("predicate"), F.lit(True).alias("_in")).distinct()
    often = relations.groupBy("predicate").agg((F.count("*") >= frequent).alias("_often")) if frequent else relations.select("predicate").distinct().withColumn("_often", F.lit(False))
    r = relations.join(mapping.select("predicate", F.col("to").alias("_to")), "predicate", "left").join(known, "predicate", "left").join(often, "predicate", "left")
    keep = F.coalesce("_in", F.lit(False)) | F.col("_often") | F.col("predicate").isin("instanceOf", "subClassOf", "sameAs", T.RELATED)
    new = F.when(keep, F.col("predicate")).otherwise(F.coalesce("_to", F.lit(T.RELATED)))
    label = F.when((new == T.RELATED) & (F.col("predicate") != T.RELATED), F.coalesce("label", "predicate")).otherwise(F.col("label"))
    return r.withColumn("_label", label).withColumn("predicate", new).withColumn("label", F.col("_label")).select(*relations.columns)
