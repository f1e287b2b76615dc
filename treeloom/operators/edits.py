"""Edits of texts as column expressions: line ranges, splices, replacements of whole lines at any indent, counted replacements."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _dedented(text: str) -> list[str]:
    """The lines of a constant without the blanks that all lines with text begin with."""
    lines = text.split("\n")
    cut = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
    return [x[cut:] if x.strip() and x.startswith(" " * cut) else x for x in lines]


def sliced(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last``; a line feed at the end begins no line; null where the range isn't within the text or is upside down. An empty text has one empty line."""
    lines = _lines(F.regexp_replace(text, r"\n\z", ""))
    return F.when((first >= 1) & (last >= first) & (last <= F.size(lines)), F.array_join(F.slice(lines, F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0))), "\n"))


def spliced(text: Column, first: Column, last: Column, fresh: Column) -> Column:
    """The text with lines ``first`` to ``last`` replaced by those of ``fresh``, of which one line feed at the end is dropped; null where the range isn't within the text."""
    lines = _lines(text)
    new = _lines(F.regexp_replace(fresh, r"\n\z", ""))
    joined = F.array_join(F.concat(F.slice(lines, F.lit(1), F.greatest(first - 1, F.lit(0))), new, F.slice(lines, F.greatest(last + 1, F.lit(1)), F.size(lines))), "\n")
    return F.when((first >= 1) & (last >= first) & (last <= F.size(lines)), joined)


def _indent(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(\s*)", 1))


def line_matches(text: Column, pattern: str) -> Column:
    """Numbers of the lines at which the lines of ``pattern`` stand one after the other, all indented by as many blanks more than there; blank lines match blank lines. Whole lines only; a blank pattern matches nothing."""
    want, lines = _dedented(pattern), _lines(text)
    told = next((k for k, x in enumerate(want) if x.strip()), None)
    if told is None:
        return F.array().cast("array<int>")

    def here(i: Column) -> Column:
        at = lambda k: F.get(lines, i + (k - 1))
        offset = _indent(at(told))
        met = F.lit(True)
        for k, x in enumerate(want):
            met = met & (F.concat(F.repeat(F.lit(" "), offset), F.lit(x)) == at(k) if x.strip() else F.trim(at(k)) == "")
        return met

    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines) - (len(want) - 1), F.lit(0)), F.lit(1)), here) if len(want) == 1 else F.when(
        F.size(lines) >= len(want), F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines) - (len(want) - 1), F.lit(1))), here)).otherwise(F.array().cast("array<int>"))


def replaced_lines(text: Column, pattern: str, fresh: str, count: int) -> Column:
    """The text with the first ``count`` matches of :func:`line_matches` replaced by ``fresh``, indented as each match was; later matches are replaced first, so the numbers of earlier ones hold."""
    want, new = _dedented(pattern), _dedented(fresh)
    told = next((k for k, x in enumerate(want) if x.strip()), 0)
    original = _lines(text)

    def put(now: Column, i: Column) -> Column:
        pad = F.repeat(F.lit(" "), _indent(F.get(original, i + (told - 1))))
        body = F.array(*[F.concat(pad, F.lit(x)) if x.strip() else F.lit(x) for x in new])
        return F.concat(F.slice(now, F.lit(1), i - 1), body, F.slice(now, i + len(want), F.size(now)))

    return F.array_join(F.aggregate(F.reverse(F.slice(line_matches(text, pattern), 1, count)), original, put), "\n")


def replaced_first(text: Column, pattern: str, fresh: str) -> Column:
    """The text with the first match of a regular expression (which may have no groups of its own) replaced."""
    if re.compile(pattern).groups:
        raise ValueError("the expression has groups")
    return F.regexp_replace(text, f"(?s)\\A(.*?)(?:{pattern})", "$1" + fresh.replace("\\", "\\\\").replace("$", "\\$"))


def edited(nodes: DataFrame, pattern: str, fresh: str, count: int = 1) -> DataFrame:
    """``id, n_found, state, source`` of nodes ``id, source``: ``state`` is ``not_found`` (the source stays), ``replaced``, or ``more_left`` where there were more matches than were to be replaced."""
    found = nodes.where("source is not null").select("id", "source", F.size(line_matches(F.col("source"), pattern)).alias("n_found"))
    state = F.when(F.col("n_found") == 0, "not_found").when(F.col("n_found") > count, "more_left").otherwise("replaced")
    return found.select("id", "n_found", state.alias("state"), F.when(F.col("n_found") == 0, F.col("source")).otherwise(replaced_lines(F.col("source"), pattern, fresh, count)).alias("source"))
