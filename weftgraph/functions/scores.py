"""Cuts and scores over sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def natural_cut(scored: DataFrame, score: str = "score", group: list[str] | None = None, min_k: int = 0, max_k: int = 0) -> DataFrame:
    """(group, k): how many of the highest scores stand out: the k that maximises k (n - k) (mean of head - mean of tail)^2.

    The smallest such k; all, if scores are flat. Groups are score lists of bounded length (vocabularies, counts by name).
    """
    group = group or []
    keys = group or [F.lit(1).alias("_all")]
    base = scored.select(*keys, F.col(score).cast("double").alias("_s"))
    cols = group or ["_all"]
    w = W.partitionBy(*cols).orderBy(F.desc("_s"))
    head = base.withColumn("_k", F.row_number().over(w)).withColumn("_sum", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0)))
    total = base.groupBy(*cols).agg(F.count("*").alias("_n"), F.sum("_s").alias("_total"), F.max("_s").alias("_hi"), F.min("_s").alias("_lo"))
    gap = F.col("_sum") / F.col("_k") - (F.col("_total") - F.col("_sum")) / (F.col("_n") - F.col("_k"))
    value = F.when(F.col("_k") < F.col("_n"), F.round(F.col("_k") * (F.col("_n") - F.col("_k")) * gap * gap, 9))
    best = head.join(total, cols).withColumn("_v", value).groupBy(*cols).agg(F.max_by(F.col("_k"), F.struct(F.coalesce("_v", F.lit(-1.0)), -F.col("_k"))).alias("k"), F.first("_n").alias("n"), F.first("_hi").alias("hi"), F.first("_lo").alias("lo"))
    k = F.when(F.col("hi") == F.col("lo"), F.col("n")).otherwise(F.col("k"))
    k = F.greatest(k, F.least(F.lit(min_k), F.col("n"))) if min_k else k
    k = F.least(k, F.lit(max_k)) if max_k else k
    return best.select(*group, k.cast("bigint").alias("k"))
