"""Settings of a session and what a plan reads and shuffles."""

from __future__ import annotations

import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are written for; a cluster's own values have precedence.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.files.maxPartitionBytes": "128m"}


def session(name: str = "treeloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per Spark context, so that their Python finds it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_treeloom_sent", False):
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="spark-treeloom-")  # the driver's own; Spark sends the file on from there
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
    context._treeloom_sent = True


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def columns_read(df: DataFrame) -> list[set[str]]:
    """The columns each scan of a plan reads."""
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<(.*)>", plan_text(df))]


def shuffles(df: DataFrame) -> int:
    return len(re.findall(r"^\(\d+\) Exchange", plan_text(df), re.M))
