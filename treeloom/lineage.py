"""Tables that cut lineage: written to the folder all executors share, read back lazily."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where it is unset and the master is local (tests, one machine) a folder of our own, which is then recorded in the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set: a cluster's machines need a folder they share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-treeloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/treeloom/{name}-{uuid.uuid4().hex[:12]}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours below the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_WRITTEN: dict[str, list[str]] = {}


def release(spark: SparkSession) -> None:
    """Deletes the tables :func:`written` has left in this session. For the caller, when the results built on them have been stored: they are read lazily."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        removed(spark, path)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read again: later plans start there, also after the loss of an executor."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
