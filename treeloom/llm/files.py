"""Files put together from the leaves of the code table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions.text import extension


def whole_files(code: DataFrame, languages: DataFrame, wanted: list[str], keep: Column | None = None) -> DataFrame:
    """``file, language, text`` of the files whose extension is that of a ``wanted`` language.

    The leaves are joined by a line feed in the order of ``line_start``; exact duplicates count once. Rows without file, or without source, add nothing;
    a file none of whose rows has a source is not returned.
    """
    names = languages.where(F.col("language").isin(wanted)).select(F.lower("extension").alias("ext"), "language").distinct()
    leaves = code.where("source is not null and file is not null")
    leaves = leaves.where(keep) if keep is not None else leaves
    leaves = leaves.select("file", "line_start", "source").withColumn("ext", extension(F.col("file"))).join(names, "ext")
    lines = F.array_sort(F.collect_set(F.struct("line_start", "source")))
    return leaves.groupBy("file").agg(F.first("language").alias("language"), lines.alias("leaves")).select(
        "file", "language", F.array_join(F.transform("leaves", lambda x: x["source"]), "\n").alias("text"))
