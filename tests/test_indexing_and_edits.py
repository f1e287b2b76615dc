import random

import pytest
from pyspark.sql import functions as F

from treeloom.operators import edits, indexing


def spans(text, language=None, **how):
    return [(r[0].partition(":")[2], r[12], r[13], r[15]) for r in indexing.rows_of_file("r/a/f.x", language, text, **how)]


def test_blocks_and_chunks():
    """Blocks by indent with their closing line, joined ones under a block of their own, paragraphs between; blank lines go to what stands before."""
    text = "a = 1\n\nif x {\n  y\n\n  z\n} else {\n  w\n}\n\nfoo(\n    1,\n)\n\n\nplain\nmore\n\nlast\n"
    assert spans(text) == [
        ("", 1, 19, 5), ("chunk", 1, 2, 0), ("block", 3, 10, 2), ("block$2", 11, 13, 1), ("chunk$2", 14, 18, 0), ("chunk$3", 19, 19, 0), ("block:block", 3, 6, 2), ("block:block$2", 7, 9, 1),
        ("block$2:chunk", 11, 13, 0), ("block:block:chunk", 3, 5, 0), ("block:block:chunk$2", 6, 6, 0), ("block:block$2:chunk", 7, 9, 0)]


def test_rows_of_a_file():
    rows = indexing.rows_of_file("r/a/f.x", "julia", "function f\n  1\nend\n")
    assert [len(r) for r in rows] == [16] * len(rows) and rows[0][:8] == ("r/a/f.x", "r/a", 2, 0, "file", "f.x", "r.a.f.x", "julia")
    assert [r[6] for r in rows] == ["r.a.f.x", "r.a.f.x.block", "r.a.f.x.chunk", "r.a.f.x.block.chunk"] and [r[9] for r in rows] == [None, None, "end", "function f\n  1"]
    for blank in ("", "\n", "  \n\n"):
        (row,) = indexing.rows_of_file("r/f.x", None, blank)
        assert row[9] == blank and row[15] == 0


def test_markdown():
    text = "\n# Title `x`\n\ntext\nmore\n\n- a\n  b\n\n- c\n1. d\n\n```\n# no\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n## Two\n"
    assert indexing.markdown_spans(indexing.Lines(text)) == [("heading", 2, 2), ("paragraph", 4, 5), ("list", 7, 10), ("list", 11, 11), ("fence", 13, 15), ("table", 17, 19), ("heading", 20, 20)]
    assert spans(text, "markdown", detail_lines=5) == [("", 1, 20, 6), ("Title x", 1, 3, 0), ("chunk", 4, 5, 0), ("chunk$2", 6, 12, 0), ("chunk$3", 13, 15, 0), ("chunk$4", 16, 19, 0), ("Two", 20, 20, 0)]
    assert spans(text, "markdown") == [("", 1, 20, 3), ("Title x", 1, 2, 0), ("chunk", 3, 19, 0), ("Two", 20, 20, 0)]
    assert spans("only text\n", "markdown") == [("", 1, 1, 0)]


@pytest.mark.parametrize("seed", range(3))
def test_outermost_blocks_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        text = "\n".join("" if rng.random() < 0.2 else " " * rng.randrange(0, 7) + rng.choice(["a", "b {", "}", ")"]) for _ in range(rng.randrange(1, 14)))
        lines = indexing.Lines(text)
        n = len(lines.text)
        every = [(i, e) for i in range(1, n + 1) if (e := lines.block(i, n))]
        for i, _ in every:  # the nearest later line as far left, looked for line by line
            later = [j for j in range(i + 1, n + 1) if lines.filled[j] and lines.indent[j] <= lines.indent[i]]
            assert lines.outer[i] == (later[0] if later else 0)
        outer = [s for s in every if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in every)]
        found = [(a, b) for s in indexing.blocks(lines, 1, n, False) if s["kind"] == "block" for a, b in ([(x["first"], x["last"]) for x in s["within"]] if s["within"] else [(s["first"], s["last"])])]
        assert [a for a, _ in found] == [a for a, _ in outer] or [a for a, _ in found][1:] == [a for a, _ in outer][1:]


def test_file_rows(spark):
    df = spark.createDataFrame([("r/a.md", "Markdown", "# A\n"), ("r/b.x", None, "x\n"), (None, "x", "y"), ("r/c.x", "x", None)], "file string, language string, text string").selectExpr("*", "1 as id", "2 as depth")
    rows = indexing.file_rows(df)
    assert rows.columns == indexing.COLUMNS and sorted(r.id for r in rows.collect()) == ["r/a.md", "r/a.md:A", "r/b.x", "r/b.x:chunk"]
    summaries = spark.createDataFrame([("r/b.x", "kept"), ("r/b.x:gone", "lost")], "id string, summary string")
    fresh = spark.createDataFrame([("r/b.x", None, "x\n\ny\n")], "file string, language string, text string")
    again = {r.id: r.summary for r in indexing.reindexed(rows, fresh, summaries).collect()}
    assert again == {"r/a.md": None, "r/a.md:A": None, "r/b.x": "kept", "r/b.x:chunk": None, "r/b.x:chunk$2": None}
    assert indexing.file_rows(df.limit(0)).count() == 0


def one(spark, expression, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expression.alias("x")).first().x


def test_line_ranges(spark):
    part = lambda t, a, b: one(spark, edits.sliced(F.col("t"), F.col("a"), F.col("b")), t=t, a=a, b=b)
    assert [part("a\nb\nc\n", 2, 3), part("a\nb\nc\n", 3, 4), part("a\nb", 0, 1), part("a\nb", 2, 1), part("", 1, 1), part("", 1, 2)] == ["b\nc", None, None, None, "", None]
    put = lambda t, a, b, f: one(spark, edits.spliced(F.col("t"), F.col("a"), F.col("b"), F.col("f")), t=t, a=a, b=b, f=f)
    assert [put("a\nb\nc\n", 2, 2, "x\ny\n"), put("a\nb\nc\n", 1, 3, ""), put("a", 1, 1, "b"), put("a", 2, 2, "b")] == ["a\nx\ny\nc\n", "\n", "b", None]


def test_replacements_at_any_indent(spark):
    text = "if a:\n    x = 1\n\n    y = 2\nx = 1\n \ny = 2\n\tx = 1\n"
    nodes = spark.createDataFrame([("n", text), ("m", "z"), ("e", ""), ("o", None)], "id string, source string").selectExpr("*", "1 as n_found")
    got = {r.id: (r.n_found, r.state, r.source) for r in edits.edited(nodes, "  x = 1\n\n  y = 2", "x = 3\n  if b:\n\n").collect()}
    assert got == {"n": (2, "more_left", "if a:\n    x = 3\n      if b:\n\n\nx = 1\n \ny = 2\n\tx = 1\n"), "m": (0, "not_found", "z"), "e": (0, "not_found", "")}
    both = {r.id: r.source for r in edits.edited(nodes, "x = 1", "x", count=5).collect()}
    assert both["n"] == "if a:\n    x\n\n    y = 2\nx\n \ny = 2\n\tx = 1\n"
    assert edits.edited(nodes.where("id = 'n'"), "  \n", "x").first().state == "not_found"
    assert one(spark, edits.replaced_first(F.col("t"), "b+", "$1\\"), t="a\nbb\nb") == "a\n$1\\\nb"
    with pytest.raises(ValueError):
        edits.replaced_first(F.col("t"), "(b)", "x")
