"""Line algebra: files as rows of lines, paragraphs, gaps, blocks and Markdown structure, as windows over a file's lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line``: the lines of each text from 1; a line feed at the end begins no line, a carriage return before a line feed is dropped, an empty text has one empty line."""
    parts = F.split(F.regexp_replace(F.regexp_replace(F.col(text), "\r\n", "\n"), r"\n\z", ""), "\n", -1)
    return texts.where(F.col(text).isNotNull()).select(key, F.posexplode(parts)).select(key, (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))


def line_features(lines: DataFrame) -> DataFrame:
    """Adds ``blank``, ``indent`` (leading blanks; a tab goes on to the next multiple of four) and ``closes`` (the line begins with a closing mark)."""
    lead = F.regexp_extract("line", r"^([ \t]*)", 1)
    width = F.aggregate(F.filter(F.split(lead, ""), lambda c: c != ""), F.lit(0), lambda n, c: F.when(c == "\t", n + 4 - n % 4).otherwise(n + 1))
    return lines.withColumn("blank", F.col("line").rlike(r"^\s*$")).withColumn("indent", F.when(F.col("line").rlike(r"^\s*$"), None).otherwise(width)).withColumn("closes", F.col("line").rlike(r"^\s*(\}|\)|\]|</)"))


def near_text(lines: DataFrame, key: str) -> DataFrame:
    """Adds ``next_text`` and ``previous_text``: numbers of the nearest lines after and before that aren't blank."""
    w = Window.partitionBy(key).orderBy("line_no")
    no = F.when(~F.col("blank"), F.col("line_no"))
    return lines.withColumn("next_text", F.min(no).over(w.rowsBetween(1, Window.unboundedFollowing))).withColumn("previous_text", F.max(no).over(w.rowsBetween(Window.unboundedPreceding, -1)))


def paragraphs(lines: DataFrame, key: str) -> DataFrame:
    """``key, paragraph, line_start, line_end``: runs of lines cut where text follows a blank line; blank lines belong to the paragraph before, leading ones to the first."""
    w = Window.partitionBy(key).orderBy("line_no")
    begins = (~F.col("blank") & F.coalesce(F.lag("blank").over(w), F.lit(True))).cast("int")
    numbered = lines.withColumn("begins", begins).withColumn("paragraph", F.greatest(F.lit(1), F.sum("begins").over(w)))
    return numbered.groupBy(key, "paragraph").agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"))


def block_ends(lines: DataFrame, key: str) -> DataFrame:
    """``key, line_no, end_no``: for each line whose next text is indented deeper, the last line before the next text as far left as itself, with a closing line of its own indent attached.

    The nearest later line of at most the same indent is found per (text, indent) in one window, so the work grows with lines times the indents a text has.
    """
    text = near_text(lines, key).where(~F.col("blank"))
    ahead = text.select(key, F.col("line_no").alias("next_text"), F.col("indent").alias("next_indent"))
    opens = text.join(ahead, [key, "next_text"]).where("next_indent > indent and not closes").select(key, "line_no", "indent")
    levels = opens.select(key, F.col("indent").alias("level")).distinct()
    last = lines.groupBy(key).agg(F.max("line_no").alias("last_no"))
    per_level = text.join(levels, key).where("indent <= level")
    w = Window.partitionBy(key, "level").orderBy("line_no")
    stops = per_level.withColumn("stop", F.lead("line_no").over(w)).withColumn("stop_closes", F.lead("closes").over(w)).withColumn("stop_indent", F.lead("indent").over(w)).where("indent = level").select(key, "line_no", "stop", "stop_closes", "stop_indent")
    found = opens.join(stops, [key, "line_no"]).join(last, key)
    end = F.when(F.col("stop").isNull(), F.col("last_no")).when(F.col("stop_closes") & (F.col("stop_indent") == F.col("indent")), F.col("stop")).otherwise(F.col("stop") - 1)
    return found.select(key, "line_no", end.alias("end_no"))


def outer_spans(spans: DataFrame, key: str) -> DataFrame:
    """Spans that no other span of the same text contains (of equal ones, one): a span is contained if one that begins no later ends no earlier."""
    d = spans.select(key, "line_start", "line_end").distinct()
    w = Window.partitionBy(key).orderBy("line_start", F.col("line_end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("reach", F.max("line_end").over(w)).where("reach is null or line_end > reach").drop("reach")


def gaps(spans: DataFrame, key: str) -> DataFrame:
    """``key, gap_start, gap_end``: lines between consecutive spans of a text."""
    w = Window.partitionBy(key).orderBy("line_start", "line_end")
    return spans.withColumn("gap_start", F.max("line_end").over(w) + 1).withColumn("gap_end", F.lead("line_start").over(w) - 1).where("gap_start <= gap_end").select(key, "gap_start", "gap_end")


def islands(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``key, line_start, line_end, n``: runs of rows each of which begins on the line after the one before ends."""
    w = Window.partitionBy(key).orderBy(start, end)
    cut = F.when(F.col(start) == F.lag(end).over(w) + 1, 0).otherwise(1)
    return rows.withColumn("_cut", cut).withColumn("_run", F.sum("_cut").over(w)).groupBy(key, "_run").agg(F.min(start).alias("line_start"), F.max(end).alias("line_end"), F.count("*").alias("n")).drop("_run")


def markdown_blocks(lines: DataFrame, key: str) -> DataFrame:
    """``key, line_no, block``: ``fence`` for lines of fenced code with their fences, ``heading``, ``list``, ``table``, ``rule``, ``blank`` or ``paragraph``."""
    w = Window.partitionBy(key).orderBy("line_no")
    mark = F.col("line").rlike(r"^\s*(```|~~~)")
    before = F.coalesce(F.sum(F.when(mark, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    block = (
        F.when(mark | (before % 2 == 1), "fence").when(F.col("line").rlike(r"^\s*$"), "blank").when(F.col("line").rlike(r"^#{1,6}\s"), "heading")
        .when(F.col("line").rlike(r"^\s*(---+|\*\*\*+)\s*$"), "rule").when(F.col("line").rlike(r"^\s*([-*+]|\d+[.)])\s"), "list").when(F.col("line").rlike(r"^\s*\|"), "table").otherwise("paragraph"))
    return lines.select(key, "line_no", block.alias("block"))


def sections(lines: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """``key, section_no, title, line_start, line_end``: a section runs from a heading to the line before the next; lines before the first heading are section 0."""
    rows = lines.join(blocks, [key, "line_no"])
    w = Window.partitionBy(key).orderBy("line_no")
    rows = rows.withColumn("section_no", F.sum(F.when(F.col("block") == "heading", 1).otherwise(0)).over(w))
    title = F.max(F.when(F.col("block") == "heading", F.regexp_replace(F.regexp_replace("line", r"^#+\s*", ""), "`", "")))
    return rows.groupBy(key, "section_no").agg(title.alias("title"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"))


def line_slice(lines: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """Source of a line range: ``lines`` joined to ``first`` and ``last`` columns, put together again in order."""
    inside = lines.where(F.col("line_no").between(F.col(first), F.col(last)))
    return inside.groupBy(key, first, last).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
