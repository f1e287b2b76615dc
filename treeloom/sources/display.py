"""Tables as compact Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.functions.scalars import shortened, table_cell


def markdown(df: DataFrame, rows: int = 20, columns: int = 20, width: int = 360) -> str:
    """The first rows and columns as a Markdown table, long values cut, with how many rows and columns are left out. Rows come in the order of ``df``."""
    names = df.columns[:columns]
    shown = df.select(*[table_cell(shortened(F.col(f"`{c}`").cast("string"), width)).alias(c) for c in names]).limit(rows).collect()
    out = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(r) + " |" for r in shown)]
    more = df.count() - len(shown)
    notes = [f"{more} more rows"] * (more > 0) + [f"{len(df.columns) - len(names)} more columns"] * (len(df.columns) > len(names))
    return "\n".join(out + ([", ".join(notes)] if notes else []))
