"""What the training-data operators share: table access, written cuts of lineage, and bounds of what a Python worker holds."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftgraph import session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Rows of an Arrow batch of texts, at most: what a Python worker holds at once follows it. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialise(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again: the lineage ends there, on files every executor sees.

    With ``by`` the files are bucketed by that column, so what groups by it reads them without a shuffle.
    """
    return session.settle(df, tag) if by is None else session.settle_by(df, by, shuffles(df.sparkSession), tag)


def few_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's few rows. Of plain tuples Spark makes it through Python workers of their own in each executor; Arrow goes without."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds), schema)


def forget() -> None:
    """Deletes what materialise() has written; results that still read it must be consumed before."""
    session.forget()


def batches_by_chars(texts: list[str | None], most: int) -> Iterator[list[str | None]]:
    """Neighbours of about ``most`` characters together; a longer text is by itself."""
    group: list[str | None] = []
    size = 0
    for t in texts:
        if group and size + len(t or "") > most:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t or "")
    if group:
        yield group


def release() -> None:
    """Gives the allocators' free memory back to the system: a reused worker would keep it from one task to the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with release() at the end of each task, after what it held is gone."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return task
