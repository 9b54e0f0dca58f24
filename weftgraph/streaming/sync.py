"""Rows that change: fingerprints, differences, and a foreachBatch that keeps a graph in step with a stream of snapshots."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import values as V

STATE = "key string, fingerprint string"


def mapping_signature(columns: list[str], key: str, label: str | None = None, fks: list[dict] | None = None) -> str:
    """Of how rows are read: another mapping makes every row a changed one."""
    body = {"columns": list(columns), "key": key, "label": label, "fks": sorted(json.dumps(f, sort_keys=True) for f in fks or [])}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def fingerprint(signature: str, df: DataFrame, columns: list[str]) -> Column:
    """Null and empty text differ."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = [F.when(F.col(c).isNotNull(), V.value_text(F.col(c), kinds[c])) for c in columns]
    return F.sha2(F.to_json(F.array(F.lit(signature), *cells), {"ignoreNullFields": "false"}), 256)


def diff_rows(rows: DataFrame, columns: list[str], key: str, known: DataFrame, signature: str | None = None, complete: bool = True) -> DataFrame:
    """(key, change, fingerprint, row): added, changed, unchanged; missing where the read was complete. Blank keys are skipped.

    Of rows with one key, one stands for it: the greatest fingerprint.
    """
    sig = signature or mapping_signature(columns, key)
    kind = rows.schema[key].dataType
    now = rows.withColumn("_key", V.value_text(F.col(key), kind)).filter("trim(_key) <> ''").withColumn("_fp", fingerprint(sig, rows, columns))
    now = now.groupBy("_key").agg(F.max(F.struct("_fp", F.struct(*[F.col(c) for c in columns]).alias("row"))).alias("m")).select(F.col("_key").alias("key"), F.col("m._fp").alias("fp"), F.col("m.row").alias("row"))
    both = now.join(known.select("key", F.col("fingerprint").alias("old")), "key", "full_outer")
    change = F.when(F.col("fp").isNull(), "missing").when(F.col("old").isNull(), "added").when(F.col("fp") != F.col("old"), "changed").otherwise("unchanged")
    out = both.select("key", change.alias("change"), F.col("fp").alias("fingerprint"), "row")
    return out if complete else out.filter("change <> 'missing'")


def summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("n"))


class RowSync:
    """State of one source in versioned Parquet folders; ``apply(to_load, missing_keys, batch_id)`` changes the graph.

    A batch that was applied is not applied again: the state's version is its batch id.
    """

    def __init__(self, path: str, columns: list[str], key: str, apply: Callable[[DataFrame, DataFrame, int], None], complete: bool = True, signature: str | None = None) -> None:
        self.path, self.columns, self.key, self.apply, self.complete = path.rstrip("/"), columns, key, apply, complete
        self.signature = signature or mapping_signature(columns, key)

    def _last(self, spark) -> int:  # noqa: ANN001
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return -1
        done = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((int(n[2:]) for n in done if n.startswith("v=")), default=-1)

    def known(self, spark) -> DataFrame:  # noqa: ANN001
        v = self._last(spark)
        return spark.createDataFrame([], STATE) if v < 0 else spark.read.schema(STATE).parquet(f"{self.path}/v={v}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if self._last(spark) >= batch_id:
            return
        diff = diff_rows(batch, self.columns, self.key, self.known(spark), self.signature, self.complete).persist()
        try:
            load = diff.filter("change in ('added', 'changed')").select("row.*")
            self.apply(load, diff.filter("change = 'missing'").select("key"), batch_id)
            state = diff.filter("fingerprint is not null").select("key", "fingerprint")
            if not self.complete:
                state = state.unionByName(self.known(spark).join(state.select("key"), "key", "left_anti"))
            state.write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")
        finally:
            diff.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, **trigger: object):  # noqa: ANN201
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by window and type; on a stream, with a watermark."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
