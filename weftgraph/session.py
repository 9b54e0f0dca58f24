"""A local session with the settings that tests and bench.py share, and cuts of lineage in the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


_own_dir: list[str] = []
_written: list[tuple[SparkSession, str]] = []
_settled: weakref.WeakSet[DataFrame] = weakref.WeakSet()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where that is unset and the master is local (tests), one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="weft-shared-"))
        atexit.register(shutil.rmtree, _own_dir[0].removeprefix("file://"), ignore_errors=True)
    return _own_dir[0]


def settle(df: DataFrame, tag: str = "cut") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: later steps plan from there and survive lost executors."""
    if df in _settled:
        return df
    path = f"{shared_dir(df.sparkSession)}/weft-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _settled.add(out)
    _written.append((df.sparkSession, path))
    return out


def settle_by(df: DataFrame, by: str, buckets: int, tag: str = "cut") -> DataFrame:
    """settle() with files in ``buckets`` hash buckets of column ``by``: groups by it need no shuffle. The catalog's entry goes at once, the files stay."""
    spark, name = df.sparkSession, f"weft_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name.replace('_', '-')}/{tag}"
    # an entry is the one way to tell Spark of buckets
    df.write.format("parquet").bucketBy(buckets, by).option("path", path).saveAsTable(f"spark_catalog.default.{name}")
    _written.append((spark, path))
    out = spark.table(f"spark_catalog.default.{name}")
    spark.sql(f"drop table spark_catalog.default.{name}")
    return out


@atexit.register
def forget() -> None:
    """Deletes what settle() has written; a cluster's driver ends with it, or a job calls it once results are stored."""
    while _written:
        spark, path = _written.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone already
            return
