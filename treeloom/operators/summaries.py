"""Summaries from comments and read-me files, signatures, and values kept over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: marks that lead comment lines.
LEADING_MARKS = r"^([ \t]*(///|//|/\*|\*/|#|\*))*[ \t]*"


def comment_summary(source: Column) -> Column:
    """The first three lines of a comment that hold a letter or digit, without marks, joined by a blank; a first line that looks like a call is left out; null if nothing is left."""
    lines = F.transform(F.split(source, "\n"), lambda x: F.rtrim(F.regexp_replace(F.regexp_replace(x, "\r$", ""), LEADING_MARKS, "")))
    lines = F.filter(lines, lambda x: ~F.contains(x, F.lit('"""')) & x.rlike("[A-Za-z0-9]"))
    lines = F.when((F.size(lines) > 0) & F.get(lines, F.lit(0)).rlike(r"^[A-Za-z_][A-Za-z0-9_.!]*\("), F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines)
    text = F.array_join(F.slice(lines, 1, 3), " ")
    return F.when(text != "", text)


def declaration_line(source: Column) -> Column:
    """The first line of a declaration, trimmed: neither blank nor a comment, a decorator, or part of a string that opens the source; null if there is none."""
    rest = F.regexp_replace(source, r'(?s)\A\s*"""(?:[^"]|"{1,2}(?!"))*"""', "")
    lines = F.transform(F.split(rest, "\n"), lambda x: F.trim(F.regexp_replace(x, "\r$", "")))
    return F.get(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(#|//|/\*|\*|@)")), F.lit(0))


def readme_paragraph(source: Column) -> Column:
    """All lines of the first paragraph that isn't a heading, joined by a blank; null if there is none."""
    parts = F.split(F.regexp_replace(source, "\r", ""), r"\n[ \t]*\n")
    bodies = F.transform(parts, lambda p: F.array_join(F.transform(F.filter(F.split(p, "\n"), lambda x: ~x.rlike(r"^\s*#") & (F.trim(x) != "")), lambda x: F.trim(x)), " "))
    first = F.get(F.filter(bodies, lambda b: b != ""), F.lit(0))
    return first


def with_fallback(nodes: DataFrame, offered: DataFrame) -> DataFrame:
    """``id, summary``: the node's own summary, else the ``offered`` one (``id, offer``)."""
    return nodes.select("id", "summary").join(offered, "id", "left").select("id", F.coalesce(F.when(F.trim("summary") != "", F.col("summary")), "offer").alias("summary"))


def overrides(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """``id, summary`` that differ from the baseline (null equals null), as a table to be applied later."""
    base = baseline.select("id", F.col("summary").alias("base"))
    return now.select("id", "summary").join(base, "id").where(~F.col("summary").eqNullSafe(F.col("base"))).select("id", "summary")


def apply_overrides(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """``nodes`` with the summaries of ``changes`` in place of their own; a change to null counts."""
    c = changes.select("id", F.col("summary").alias("_new"), F.lit(True).alias("_has"))
    return nodes.join(c, "id", "left").withColumn("summary", F.when(F.col("_has"), F.col("_new")).otherwise(F.col("summary"))).drop("_new", "_has")
