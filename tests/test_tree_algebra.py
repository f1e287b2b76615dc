import random

from treeloom.operators import hierarchy, sessions, symbols, tables, tasks, trees
from treeloom.functions import scalars
from pyspark.sql import functions as F

NODES = "id string, parent string, kind string, depth int, sibling_order int"


def nodes_with_rings(spark):
    rows = [("r", None, "codebase", 0, 0), ("a", "r", "file", 1, 1), ("b", "r", "file", 1, 0), ("c", "a", "chunk", 2, 1), ("d", "a", "chunk", 2, 0), ("e", "d", "chunk", 3, None), ("f", "lost", "chunk", 0, 0)]
    rows += [("x", "z", "file", 0, 0), ("y", "x", "file", 0, 0), ("z", "y", "file", 0, 0), ("w", "x", "file", 0, 0), ("s", "s", "file", 0, 0)]
    return spark.createDataFrame(rows + rows[:3], NODES).distinct()


def test_climbing_and_selection(spark):
    nodes = nodes_with_rings(spark)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert {tuple(r) for r in trees.climbed(ids("e", "f", "w", "s", "r"), nodes).collect()} == {("e", "d", 1), ("e", "a", 2), ("e", "r", 3)}
    assert {r.id for r in trees.outermost(ids("a", "e", "b", "w", "x"), nodes).collect()} == {"a", "b", "w", "x"}
    assert {tuple(r) for r in trees.first_leaves(nodes).collect()} == {("r", "b"), ("a", "e"), ("d", "e")}
    assert {tuple(r) for r in trees.first_leaves(nodes, sound_only=False).collect()} == {("r", "b"), ("a", "e"), ("d", "e"), ("x", "w"), ("y", "w"), ("z", "w")}
    assert sorted(map(tuple, trees.ordered_leaves(ids("r", "b"), nodes).collect())) == [("b", "b", 0), ("r", "b", 0), ("r", "c", 2), ("r", "e", 1)]
    assert trees.climbed(ids("e").limit(0), nodes).count() == 0


def test_cycles(spark):
    got = {tuple(r) for r in hierarchy.cycles(nodes_with_rings(spark)).collect()}
    assert got == {("x", 0, "x"), ("x", 1, "z"), ("x", 2, "y"), ("s", 0, "s")}
    rng = random.Random(1)
    order = list(range(40))
    rng.shuffle(order)
    ring = [(f"n{a:02}", f"n{b:02}", "file", 0, 0) for a, b in zip(order, order[1:] + order[:1])]
    found = {r.id: r.position for r in hierarchy.cycles(spark.createDataFrame(ring, NODES)).collect()}
    up = {a: b for a, b, *_ in ring}
    at = "n00"
    for k in range(40):
        assert found[at] == k
        at = up[at]
    assert hierarchy.cycles(spark.createDataFrame([], NODES)).count() == 0


def test_fragments_are_bounded(spark, monkeypatch):
    """One locality holds most rows: no group exceeds the bound, and ways through many groups are put together."""
    rows = [(f"one:{i}", f"one:{i // 2}" if i else None, "codebase" if i == 0 else "chunk", 0, i) for i in range(600)] + [(f"k{i}:x", None, "codebase", 0, 0) for i in range(200)]
    walk = hierarchy.walk_fragment

    def checked(group):
        assert len(group) <= 100
        return walk(group)

    monkeypatch.setattr(hierarchy, "walk_fragment", checked)
    df = hierarchy.hierarchy(spark.createDataFrame(rows, NODES), fragment_rows=100, with_line=False)
    assert df.where("issue = 'no_root' or steps is null").count() == 0 and df.agg(F.max("steps")).first()[0] == 10


def test_ranked_children(spark):
    rows = [(f"c{k}", "p", kind, name, summary, lines, k) for k, (kind, name, summary, lines) in enumerate([("chunk", "z", None, 9), ("file", "README.md", None, 1), ("function", "f", None, None), ("class", "k", None, 3), ("function", "g", "says", 2), ("block", "b", None, 50)])]
    df = spark.createDataFrame(rows + [("q1", "q", "chunk", "x", None, 1, 5), ("q0", "q", "chunk", "y", "s", 1, 9)], "id string, parent string, kind string, name string, summary string, n_lines int, sibling_order int")
    first, omitted = trees.ranked_children(df, 3)
    assert {(r.parent, r.id, r["rank"]) for r in first.collect()} == {("p", "c1", 1), ("p", "c4", 2), ("p", "c3", 3), ("q", "q1", 1), ("q", "q0", 2)}
    assert {tuple(r) for r in omitted.collect()} == {("p", "function", 1), ("p", "chunk", 1), ("p", "block", 1)}
    scores = spark.createDataFrame([("c5", 2, 2), ("c0", 1, 9)], "id string, n_distinct long, n_total long")
    assert {r.id for r in trees.ranked_children(df, 5, scores)[0].collect() if r.parent == "p"} == {"c1", "c4", "c3", "c2", "c0"}


def test_tasks(spark):
    rows = [("l", i, p, "x", 0, k, s, k) for k, (i, p, s) in enumerate([("1", None, "pending"), ("2", "1", "done"), ("3", "1", "pending"), ("4", "3", "pending"), ("5", "3", "in_progress"), ("6", None, "done"), ("7", "6", "done")])]
    df = spark.createDataFrame(rows, "list_id string, id string, parent string, kind string, depth int, sibling_order int, status string, row_no int")
    assert {tuple(r) for r in tasks.folded_states(df).collect()} == {("1", "pending"), ("3", "pending"), ("6", "done")}
    assert {tuple(r) for r in tasks.insert_rows(df, "row_no").collect()} == {("l", "1", 5, 1), ("l", "2", 2, 2), ("l", "3", 5, 3), ("l", "4", 4, 4), ("l", "5", 5, 5), ("l", "6", 7, 6), ("l", "7", 7, 7)}
    begun = {r.id: r.status for r in tasks.started(df, spark.createDataFrame([("l", "4")], "list_id string, id string")).collect()}
    assert begun == {"1": "pending", "2": "done", "3": "pending", "4": "in_progress", "5": "pending", "6": "done", "7": "done"}
    for bad in ("2", "3", "9"):
        assert {r.id: r.status for r in tasks.started(df, spark.createDataFrame([("l", bad)], "list_id string, id string")).collect()} == {r[1]: r[6] for r in rows}
    assert {tuple(r) for r in tasks.focus_paths(df, spark.createDataFrame([("l", "5")], "list_id string, id string")).collect()} == {("l", 1, "1"), ("l", 2, "3"), ("l", 3, "5")}


def test_sessions(spark):
    fields = "session string, n int, type string, timestamp string, id int, content string, raw_content string, source string, output string"
    rows = [("a", 1, "session_start", "2025-01-01T10:00:00Z", 7, None, None, None, None), ("a", 2, "user_message", "t", None, "thought", None, "reflection", None), ("a", 3, "user_message", "t", None, "do\n this", "raw\n  this", None, None),
            ("a", 4, "llm_response", "t", None, "one", None, None, None), ("a", 5, "llm_response", "t", None, None, None, None, "two"), ("a", 6, "session_end", "2025-01-01T10:03:20Z", None, None, None, None, None), ("b", 1, "session_start", "2025-01-01T10:00:00Z", 8, None, None, None, None), ("c", 1, "user_message", "t", None, "x", None, None, None)]
    df = spark.createDataFrame(rows, fields)
    assert {tuple(r) for r in sessions.listing(df, "session", "n").collect()} == {("a", 7, "2025-01-01T10:00", "3m 20s", "raw this"), ("b", 8, "2025-01-01T10:00", "", "(no description)")}
    assert [tuple(r) for r in sessions.final_messages(df, "session", "n").collect()] == [("a", "two")]
    usage = spark.createDataFrame([(0, 5, 1, 0, "s"), (100, 150, 2, 1, "s")], "baseline int, last_call int, turn_index int, auto_turns int, state string")
    told = [r.message for r in sessions.steering(usage, F.lit("{{turn_index}}: {{turn_tokens}} of {{turn_token_limit}}, {{julia_state}}"), {"turn_token_limit": 900}).orderBy("turn_index").collect()]
    assert told == [None, "2: 50 of 900, s"]
    assert sessions.steering(usage, F.lit("{{other}}"), {}).where("message is not null").count() == 0


def test_file_changes(spark):
    paths = lambda *x: spark.createDataFrame([(i,) for i in x], "path string")
    diff = spark.createDataFrame([("m", None, "modified"), ("n", "o", "renamed"), ("u", None, "modified")], "path string, old_path string, status string")
    working = spark.createDataFrame([("t", "untracked", False, True), ("u", "unmerged", True, False), ("v", "unmerged", False, True), ("m", "modified", True, False)], "path string, status string, has_staged boolean, has_unstaged boolean")
    args = (paths("m", "u", "t"), paths("m", "t"), paths("m"), paths("n"))
    got = {r.path: tuple(r)[1:] for r in tables.file_changes(diff, working, *args, "all").collect()}
    assert got == {
        "m": (None, "modified", True, True, True, False), "n": ("o", "renamed", False, False, False, True), "u": (None, "unmerged", False, False, True, False), "v": (None, "unmerged", False, False, False, True),
        "t": (None, "untracked", True, False, False, True)}
    assert {r.path for r in tables.file_changes(diff.where("path = 'm'"), working, *args, "staged").collect()} == {"m", "u"}
    assert {r.path for r in tables.file_changes(diff.where("path = 'n'"), working, *args, "unstaged").collect()} == {"n", "t", "v"}
    assert tables.file_changes(diff.limit(0), working.limit(0), *args, "all").count() == 0


def test_symbols_of_texts(spark):
    fields = "id string, kind string, name string, file string, line_start int, line_end int, source string, lang string"
    rows = [("f", "function", "f", "a.py", 1, 3, "def f(x):\n  y = g(x) + z\n  return y == k\n", "python"), ("h", "function", "h", "b.py", 1, 9, None, "python"), ("h:c", "chunk", "c", "b.py", 1, 4, "w = 1\nfor q in w: use (q)\n", "python"), ("h:d", "chunk", "d", "b.py", 5, 9, "w + q + v\n", "python"),
            ("m", "chunk", "m", "r.md", 1, 9, "`k`\n```python\na = b(c)\n```\n```\nf(1) g f\n```\n```other\nf\n```\n    h x\n", "markdown")]
    df = spark.createDataFrame(rows, fields)
    got = {tuple(r) for r in symbols.text_symbols(df).collect()}
    assert got == {("f", "f", "call"), ("f", "g", "call"), ("f", "x", "var_ref"), ("f", "z", "var_ref"), ("f", "k", "var_ref"), ("h:c", "use", "call"), ("h:d", "v", "var_ref")}
    names = symbols.known_names(df)
    assert {r.name for r in names.collect()} == {"f", "h"}
    assert {tuple(r) for r in symbols.markdown_symbols(df, names, ["python"]).collect()} == {("m", "b", "call"), ("m", "c", "var_ref"), ("m", "f", "call"), ("m", "f", "var_ref"), ("m", "h", "var_ref")}


def test_small_rules(spark):
    row = spark.createDataFrame([("abcdef", ["file", "chunk"], ["chunk"] * 3 + ["block"] * 3, '{"b": 1, "a": 2}')], "t string, k array<string>, l array<string>, j string").select(
        scalars.clipped(F.col("t"), 3).alias("a"), scalars.clipped(F.col("t"), 6).alias("b"), scalars.advisory(F.col("k")).alias("c"), scalars.advisory(F.col("l")).alias("d"), scalars.has_keys(F.col("j"), ["a", "b"]).alias("e"), scalars.has_keys(F.col("j"), ["a"]).alias("f"), scalars.has_keys(F.col("t"), ["a"]).alias("g")).first()
    assert tuple(row) == ("abc...", "abcdef", "mixed", "chunks", True, False, False)
