from pyspark.sql import functions as F

from treeloom.functions import scalars
from treeloom.operators import diffs, sessions


def test_patches_and_hunks(spark):
    old = "\n".join(f"line {i}" for i in range(40))
    new = old.replace("line 3\n", "line three\n").replace("line 30\n", "line 30\nadded\n")
    df = spark.createDataFrame([("a", old, new), ("b", old, old), ("c", None, "x\ny"), ("d", "x", None)], "path string, old string, new string")
    patch = diffs.patches(df).cache()
    assert sorted(r.path for r in patch.collect()) == ["a", "c", "d"]
    rows = {(r.path, r.hunk_no): tuple(r)[2:] for r in diffs.hunks(patch).collect()}
    assert rows == {("a", 1): (1, 7, 1, 7, 1, 1), ("a", 2): (29, 6, 29, 7, 0, 1), ("c", 1): (0, 0, 1, 2, 0, 2), ("d", 1): (1, 1, 0, 0, 1, 0)}
    part = diffs.selected_patch(patch, spark.createDataFrame([("a", 2)], "path string, hunk_no int")).collect()
    assert len(part) == 1 and part[0].patch.startswith("--- a/a\n+++ b/a\n@@ -29,6 +29,7 @@") and "+added" in part[0].patch and "three" not in part[0].patch


def test_changed_nodes(spark):
    base = spark.createDataFrame([("f", "f:a", "1"), ("f", "f:b", "2"), ("g", "g:a", "1"), ("h", "h:a", None)], "file string, id string, text string")
    target = spark.createDataFrame([("f", "f:a", "1"), ("f", "f:b", "3"), ("g", "g:a", "1"), ("g", "g:n", "9"), ("h", "h:a", None)], "file string, id string, text string")
    assert {tuple(r) for r in diffs.changed_nodes(base, target).collect()} == {("f", "f:b", False), ("g", None, True)}


def test_selectors(spark):
    nodes = spark.createDataFrame([("r", "codebase", None), ("r/m", "module", None), ("r/m/f.py", "file", "r/m/f.py"), ("r/m/f.py:x", "function", "r/m/f.py"), ("r/g.py", "file", "r/g.py"), ("r/g.py:y", "function", "r/g.py")], "id string, kind string, file string")
    found, unknown = diffs.resolved(spark.createDataFrame([("r/m",), ("r/m/f.py:x",), ("r/g.py:y",), ("nope",)], "selector string"), nodes)
    assert {(r.file, r.whole_file, tuple(r.ids)) for r in found.collect()} == {("r/m/f.py", True, ()), ("r/g.py", False, ("r/g.py:y",))}
    assert [r.selector for r in unknown.collect()] == ["nope"]


def test_change_lists(spark):
    raw = spark.createDataFrame([("M\0a\0R100\0old\0new\0A\0R\0D\0gone\0",)], "t string")
    assert [tuple(r) for r in diffs.name_status(raw, "t").collect()] == [("modified", "a", None), ("renamed", "new", "old"), ("added", "R", None), ("deleted", "gone", None)]
    lines = spark.createDataFrame([("?? new file\nM  staged\n M unstaged\nUU both\nAM x\n",)], "t string")
    assert [tuple(r) for r in diffs.porcelain(lines, "t").collect()] == [("new file", "untracked", False, True), ("staged", "modified", True, False), ("unstaged", "modified", False, True), ("both", "unmerged", True, True), ("x", "added", True, True)]


def test_small_rules(spark):
    df = spark.createDataFrame([("Hi {{name}}, {{n}}", "Bo", 1), ("Hi {{who}}", "Bo", 2), ("plain", "Bo", 3)], "t string, name string, n int")
    got = df.select(scalars.filled(F.col("t"), {"name": F.col("name"), "n": F.col("n").cast("string")}).alias("x")).collect()
    assert [r.x for r in got] == ["Hi Bo, 1", None, "plain"]
    times = spark.createDataFrame([(0,), (29,), (30,), (59,), (60,), (500,)], "s int").select(scalars.next_checkpoint(F.col("s")).alias("x")).collect()
    assert [r.x for r in times] == [30, 30, 60, 60, 120, 960]
    out = spark.createDataFrame([("a\nb",), ("1\n2\n3\n4\n5\n6",)], "t string").select(scalars.shown_output(F.col("t"), 5).alias("x")).collect()
    assert [r.x for r in out] == ["a\nb", "1\n2\n3\n4\n5\n... 11 characters in all"]
    retry = spark.createDataFrame([(429, 0), (503, 2), (404, 0), (500, 5)], "s int, a int").select(sessions.retry_delay(F.col("s"), F.col("a"), 5).alias("x")).collect()
    assert [r.x for r in retry] == [1000, 4000, None, None]


def test_binary_paths(spark):
    from treeloom.operators.diffs import binary_paths

    raw = spark.createDataFrame([("3\t1\ta.jl\0-\t-\tx y.png\0-\t-\t\0old.bin\0new.bin\0" + "2\t0\t\0b\0c\0",), ("",), (None,)], "t string")
    assert {r.path for r in binary_paths(raw, "t").collect()} == {"x y.png", "new.bin"}
