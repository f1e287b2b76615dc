"""Scalar rules as JVM-side expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shortened(text: Column, n: int) -> Column:
    """At most ``n`` characters; a cut text ends with three dots within them."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 3)), F.lit("..."))).otherwise(text)


def clipped(text: Column, n: int) -> Column:
    """The first ``n`` characters; a cut text has three dots after them."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def advisory(kinds: Column) -> Column:
    """What to say of a selection by the kinds of its nodes: that files stand beside others, or that half or more of six or more are chunks; else null."""
    files, chunks, n = F.size(F.filter(kinds, lambda k: k == "file")), F.size(F.filter(kinds, lambda k: k == "chunk")), F.size(kinds)
    return F.when((files > 0) & (files < n), "mixed").when((n >= 6) & (chunks * 2 >= n), "chunks")


def has_keys(text: Column, keys: list[str]) -> Column:
    """Whether a text is a JSON object with exactly these keys."""
    return F.coalesce(F.array_sort(F.json_object_keys(text)) == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))


def table_cell(value: Column) -> Column:
    """Text of a Markdown table cell: line ends and bars escaped, null as missing."""
    for old, new in (("\r", " "), ("\n", "\\n"), ("|", "\\|"), ("\t", " ")):
        value = F.replace(value, F.lit(old), F.lit(new))
    return F.coalesce(value, F.lit("missing"))


def base_name(path: Column) -> Column:
    name = F.regexp_extract(path, "([^/]+)$", 1)
    return F.when(name != "", name)


def folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), "").otherwise("")


def parameters(signature: Column) -> Column:
    """What stands in the first pair of brackets without brackets inside; null if nothing does."""
    found = F.regexp_extract(signature, r"\(([^()]*)\)", 1)
    return F.when(found != "", found)


def branch_words(source: Column) -> Column:
    """How many words that branch stand in a source."""
    return F.size(F.regexp_extract_all(source, F.lit(r"\b(if|for|while|elif|elseif|case|catch|except)\b"), F.lit(0)))


def counted(n: Column, what: str) -> Column:
    """``1 node``, ``2 nodes``."""
    return F.concat(n.cast("string"), F.when(n == 1, f" {what}").otherwise(f" {what}s"))


def duration(start: Column, end: Column) -> Column:
    """Time between two ISO timestamps as ``42s`` or ``3m 20s``; empty if one is invalid or the end comes first."""
    s = F.try_to_timestamp(end).cast("bigint") - F.try_to_timestamp(start).cast("bigint")
    return F.when(s.isNull() | (s < 0), "").when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))


def padded(value: Column, width: int) -> Column:
    """Filled with blanks to a width, never cut, at least one blank after it."""
    return F.when(F.length(value) < width, F.rpad(value, width, " ")).otherwise(F.concat(value, F.lit(" ")))


def dedented(text: Column) -> Column:
    """Without the blanks that all lines with text begin with."""
    lines = F.split(text, "\n", -1)
    lead = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(F.regexp_extract(x, "^( *)", 1)))
    cut = F.coalesce(F.array_min(lead), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.when(F.trim(x) != "", F.substring(x, cut + 1, F.length(x))).otherwise(F.lit(""))), "\n")


def ignore_rules(lines: list[str]) -> list[tuple[str, bool]]:
    """Regular expressions of ignore-file lines with whether each takes back: comments and blank lines are none, a leading ``!`` takes back, a slash in front or within anchors, one at the end means folders."""
    rules = []
    for line in lines:
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        line = line[1:] if back else line
        line = line[1:] if line[:2] in ("\\#", "\\!") else line
        only_folder, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.lstrip("/")
        body = "".join({"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in re.split(r"(\*\*/|\*\*|\*|\?)", line) if p)
        rules.append((("^" if anchored else "(?:^|/)") + body + ("/" if only_folder else "(?:/|$)"), back))
    return rules


def ignored(paths: DataFrame, path: str, lines: list[str]) -> DataFrame:
    """``path, ignored`` by the last rule that matches the path below its repository; a folder's rule covers what is in it."""
    inner = F.regexp_replace(path, "^[^/]+/", "")
    verdict = F.lit(False)
    for rule, back in ignore_rules(lines):
        verdict = F.when(inner.rlike(rule), F.lit(not back)).otherwise(verdict)
    return paths.select(path, verdict.alias("ignored"))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with ``{{name}}`` replaced by the values; null where a name is unknown or a bracket is left over."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return F.when(~out.rlike(r"\{\{|\}\}"), out)


def next_checkpoint(elapsed: Column) -> Column:
    """The next of 30, 60, 120, ... seconds after what has elapsed, doubling."""
    return F.when(elapsed < 30, F.lit(30)).otherwise((F.lit(30) * F.pow(F.lit(2), F.floor(F.log2(elapsed / 30)) + 1)).cast("int"))


def shown_output(text: Column, most: int) -> Column:
    """The text, or beyond so many characters its first five lines with a note of its length."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 5), "\n")
    return F.when(F.length(text) > most, F.concat(head, F.lit("\n... "), F.length(text).cast("string"), F.lit(" characters in all"))).otherwise(text)
