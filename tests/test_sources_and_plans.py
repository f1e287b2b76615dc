import os

import pytest
from pyspark.sql import functions as F

from treeloom.operators.trees import child_counts, nodes_of
from treeloom.plans.session import columns_read, plan_text, shuffles
from treeloom.sources.display import markdown
from treeloom.sources.files import file_tree, structural_rows, texts


def test_file_tree(spark, tmp_path):
    files = {
        "a.py": b"x = 1\n", "b.bin": b"\0\1", ".git/config": b"x", ".gitignore": b"# c\nbuild/\n*.o\n!keep.o\n**/.env\n", "build/x.py": b"1", "src/x.o": b"1", "src/keep.o": b"1", "src/.env": b"1", "src/.gitignore": b"/local.py\n!y.o\n", "src/local.py": b"1", "src/sub/local.py": b"1", "src/y.o": b"1",
        "out/.gitignore": b"*\n", "out/z.py": b"1"}
    for path, content in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    got = file_tree(spark, str(tmp_path)).cache()
    assert sorted(r.path for r in got.collect()) == ["a.py", "b.bin", "src/keep.o", "src/sub/local.py", "src/y.o"]
    names = spark.createDataFrame([(".py", "python")], "extension string, language string")
    rows = {r.path: r for r in texts(got, names).collect()}
    assert rows["a.py"].language == "python" and rows["a.py"].text == "x = 1\n" and len(rows["a.py"].hash) == 64 and "b.bin" not in rows
    tree = {r.id: (r.parent, r.kind, r.depth, r.sibling_order) for r in structural_rows(got, "root").collect()}
    assert tree["root"] == (None, "codebase", 0, 0) and tree["src/sub"] == ("root", "module", 1, 3) and tree["src/sub/local.py"] == ("src/sub", "file", 2, 0) and tree["a.py"] == ("root", "file", 1, 0)


def test_markdown(spark):
    df = spark.createDataFrame([("a|b", "x\ny", None), ("c" * 9, "d", 1), ("e", "f", 2)], "p string, q string, r int").orderBy(F.col("r").asc_nulls_first())
    assert markdown(df, rows=2, columns=2, width=6) == "| p | q |\n|---|---|\n| a\\|b | x\\ny |\n| ccc... | d |\n1 more rows, 1 more columns"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_plans_read_what_they_need(spark):
    code = spark.read.parquet("/root/testdata/sf0.001/code.parquet")
    df = child_counts(nodes_of(code))
    assert all("source" not in read and "summary" not in read for read in columns_read(df))
    assert shuffles(df) <= 4 and "CartesianProduct" not in plan_text(df)


def test_written_tables_are_released(spark):
    from pathlib import Path

    from treeloom.lineage import release, shared_folder, written

    df = written(spark.range(3).toDF("a"), "kept")
    folders = lambda: {p.name for p in Path(shared_folder(spark).removeprefix("file://"), "treeloom").iterdir() if p.name.startswith("kept-")}
    assert df.count() == 3 and len(folders()) == 1
    release(spark)
    assert folders() == set()
    release(spark)
