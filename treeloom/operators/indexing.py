"""Index rows of files by their lines: blocks by indentation, chunks by blank lines, Markdown by headings.

Each file is read by one function in a task, since the blocks of a level depend on those above; Spark spreads the files.
The result has the sixteen columns of the code table (:data:`ROWS`).
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = (
    "id string, parent string, depth int, sibling_order int, kind string, name string, qname string, language string, summary string, source string, signature string, "
    "file string, line_start int, line_end int, n_lines int, n_children int")
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]
#: Lines from which a Markdown file shows its paragraphs and code besides its headings.
DETAIL_LINES = 30
CLOSING = re.compile(r"\}|\)|\]|</")
ITEM = re.compile(r"(\s*)([-+*]|\d+[.)])\s+")
CONTINUED = re.compile(r"\s{2,}\S")
DELIMITER = re.compile(r"\|?(?:\s*:?-+:?\s*\|)+\s*:?-+:?\s*\|?")


class Lines:
    """What the rules ask of a file's lines, numbered from 1: whether they are blank, their indent, and the next line with text, at all and at no deeper indent."""

    def __init__(self, text: str):
        self.text = text.split("\n")
        if self.text[-1] == "":
            self.text.pop()
        n = len(self.text)
        stripped = [x.strip() for x in self.text]
        self.filled = [False, *map(bool, stripped)]
        self.count = list(accumulate(map(int, self.filled)))
        self.indent = [0, *map(indent_width, self.text)]
        self.closes = [False, *(bool(CLOSING.match(x)) for x in stripped)]
        self.next, self.outer, open_lines = [0] * (n + 2), [0] * (n + 2), []
        after = 0
        for i in range(n, 0, -1):
            self.next[i] = after
            if self.filled[i]:
                while open_lines and self.indent[open_lines[-1]] > self.indent[i]:
                    open_lines.pop()
                self.outer[i] = open_lines[-1] if open_lines else 0
                open_lines.append(i)
                after = i

    def blank(self, first: int, last: int) -> bool:
        return self.count[last] == self.count[first - 1]

    def source(self, first: int, last: int) -> str:
        return "\n".join(self.text[first - 1:last])

    def opens(self, i: int, last: int) -> bool:
        """Whether the next line with text is deeper."""
        after = self.next[i]
        return self.filled[i] and 0 < after <= last and self.indent[after] > self.indent[i]

    def block(self, i: int, last: int) -> int | None:
        """The last line of the block that line ``i`` opens: up to the next text as far left, with a closing line at once after it; none if that comes after blank lines."""
        if not self.opens(i, last):
            return None
        stop = self.outer[i] if 0 < self.outer[i] <= last else 0
        end = stop - 1 if stop else last
        if stop and self.closes[stop] and not self.opens(stop, last):
            if not self.filled[stop - 1]:
                return None
            end = stop
        return end if self.count[end] - self.count[i - 1] >= 2 else None

    def paragraphs(self, first: int, last: int) -> list[tuple[int, int]]:
        """Runs of lines, each from a text after blank lines to the line before the next; leading blank lines belong to the first."""
        begins = [i for i in range(first, last + 1) if self.filled[i] and (i == first or not self.filled[i - 1])]
        return [(first if k == 0 else a, begins[k + 1] - 1 if k + 1 < len(begins) else last) for k, a in enumerate(begins)]


def indent_width(line: str) -> int:
    """Leading blanks; a tab goes on to the next multiple of four."""
    width = 0
    for c in line:
        if c not in " \t":
            break
        width += 1 if c == " " else 4 - width % 4
    return width


def blocks(lines: Lines, first: int, last: int, inside: bool) -> list[dict]:
    """Spans of the children of a range: the outermost blocks, those that a closing line joins to the one before under a block of their own, and chunks between them. ``inside``: the range is a block, which isn't its own child."""
    found, i = [], first
    while i <= last:
        end = lines.block(i, last)
        if end is None or inside and (i, end) == (first, last):
            i += 1
            continue
        span = {"kind": "block", "name": "block", "first": i, "last": end, "within": None}
        if found and lines.closes[i] and found[-1]["last"] + 1 == i:
            before = found[-1]
            if before["within"] is None:
                found[-1] = before = {**before, "within": [before]}
            before["within"].append(span)
            before["last"] = end
        else:
            found.append(span)
        i = end + 1
    out, at = [], first
    for span in [*found, None]:
        end = span["first"] - 1 if span else last
        if at <= end:
            if not lines.blank(at, end):
                out += [{"kind": "chunk", "name": "chunk", "first": a, "last": b, "within": []} for a, b in lines.paragraphs(at, end)]
            elif out:
                out[-1]["last"] = end
            elif span:
                span["first"] = at
        if span:
            out.append(span)
            at = span["last"] + 1
    return [s for s in out if not (inside and s["kind"] == "block" and (s["first"], s["last"]) == (first, last))]


def markdown_spans(lines: Lines) -> list[tuple[str, int, int]]:
    """``kind, first, last`` of a Markdown file's blocks: fence, heading, rule, list, table or paragraph."""
    text, n, out, i = [x.strip() for x in lines.text], len(lines.text), [], 0
    is_rule = lambda x: re.fullmatch("---+", x)
    is_heading = lambda x: re.match(r"#{1,6}\s+", x) or is_rule(x)
    table_at = lambda k: k + 1 < n and text[k].startswith("|") and DELIMITER.fullmatch(text[k + 1])
    while i < n:
        start = i
        if not text[i]:
            i += 1
            continue
        if text[i].startswith("```"):
            kind, i = "fence", next((k for k in range(i + 1, n) if text[k].startswith("```")), n - 1) + 1
        elif is_heading(text[i]):
            kind, i = "rule" if is_rule(text[i]) else "heading", i + 1
        elif item := ITEM.match(lines.text[i]):
            width, ordered = len(item[1]), item[2][0].isdigit()

            def goes_on(line: str) -> bool:
                m = ITEM.match(line)
                if m and (len(m[1]) > width or len(m[1]) == width and m[2][0].isdigit() == ordered):
                    return True
                return bool(CONTINUED.match(line))

            kind, i = "list", i + 1
            while i < n and (goes_on(lines.text[i]) or not text[i] and i + 1 < n and goes_on(lines.text[i + 1])):
                i += 1
        elif table_at(i):
            kind, i = "table", next((k for k in range(i + 2, n) if not text[k].startswith("|")), n)
        else:
            kind = "paragraph"
            while i < n and text[i] and not text[i].startswith("```") and not is_heading(text[i]) and not ITEM.match(lines.text[i]) and not table_at(i):
                i += 1
        out.append((kind, start + 1, i))
    return out


def markdown_children(lines: Lines, detail_lines: int) -> list[dict]:
    """Spans of a Markdown file's children: headings as functions by their title, paragraphs and code as chunks from ``detail_lines`` on, chunks for what is between; blank lines go to the span before."""
    n, out, at = max(1, len(lines.text)), [], 1
    shown = [x for x in markdown_spans(lines) if x[0] == "heading" or x[0] in ("paragraph", "fence") and n >= detail_lines]
    for kind, first, last in [*shown, ("", n + 1, n)] if shown else []:
        if at < first:
            if not lines.blank(at, first - 1):
                out.append({"kind": "chunk", "name": "chunk", "first": at, "last": first - 1, "within": []})
            elif out:
                out[-1]["last"] = first - 1
            else:
                first = at
        if kind:
            name = re.sub(r"^#+\s*", "", lines.text[last - 1].strip()).replace("`", "") if kind == "heading" else "chunk"
            out.append({"kind": "function" if kind == "heading" else "chunk", "name": name, "first": first, "last": last, "within": []})
        at = last + 1
    return out


def rows_of_file(file: str, language: str | None, text: str, detail_lines: int = DETAIL_LINES) -> list[tuple]:
    """The rows of a file: itself, and its blocks and chunks below it in the order of the text."""
    lines, base = Lines(text), file.rsplit("/", 1)[-1]
    folder = file.rpartition("/")[0]
    n = max(1, len(lines.text))
    qname = ".".join([*folder.split("/"), base]) if folder else base
    children = markdown_children(lines, detail_lines) if language == "markdown" else blocks(lines, 1, n, False) if lines.text and not lines.blank(1, n) else []
    rows = [(file, folder or None, file.count("/"), 0, "file", base, qname, language, None, None if children else text, None, file, 1, n, n, len(children))]
    todo = deque([(file, qname, file.count("/") + 1, children)])
    while todo:
        parent, parent_qname, depth, spans = todo.popleft()
        seen: Counter = Counter()
        for k, s in enumerate(spans):
            seen[s["name"]] += 1
            suffix = s["name"] + (f"${seen[s['name']]}" if seen[s["name"]] > 1 else "")
            own = s["within"] if s["within"] is not None else blocks(lines, s["first"], s["last"], True)
            rows.append((
                f"{parent}:{suffix}", parent, depth, k, s["kind"], s["name"], f"{parent_qname}.{suffix}", language, None, None if own else lines.source(s["first"], s["last"]), None, file,
                s["first"], s["last"], s["last"] - s["first"] + 1, len(own)))
            todo.append((f"{parent}:{suffix}", f"{parent_qname}.{suffix}", depth + 1, own))
    return rows


def _index(detail_lines: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, language, text in zip(batch["file"], batch["language"], batch["text"]):
                yield pd.DataFrame(rows_of_file(file, language if isinstance(language, str) else None, text, detail_lines), columns=COLUMNS).astype({"parent": "object"})

    return run


def file_rows(files: DataFrame, detail_lines: int = DETAIL_LINES) -> DataFrame:
    """Index rows (:data:`ROWS`) of ``file, language, text``: Markdown by its blocks, all else by indentation and blank lines. A file of blank lines only, or of nothing, is a leaf; rows without file or text give none."""
    rows = files.where("file is not null and text is not null").select("file", F.lower("language").alias("language"), "text")
    return rows.mapInPandas(_index(detail_lines), ROWS)


def reindexed(table: DataFrame, files: DataFrame, summaries: DataFrame | None = None, detail_lines: int = DETAIL_LINES) -> DataFrame:
    """An index with the rows of ``files`` built anew in place of theirs; nodes whose id is still there keep the summaries of ``summaries`` (``id, summary``)."""
    from treeloom.operators.summaries import apply_overrides
    from treeloom.operators.tables import replaced

    fresh = replaced(table, file_rows(files, detail_lines).select(*table.columns), "file")
    return apply_overrides(fresh, summaries).select(*table.columns) if summaries is not None else fresh
