import random

import pytest
from pyspark.sql import functions as F

from treeloom.operators.components import components
from treeloom.operators.hierarchy import broken_links, descendants, hierarchy, placed_nodes

SCHEMA = "id string, parent string, kind string, depth int, sibling_order int"


def brute(nodes):
    """nodes: id -> (parent, kind, depth)."""
    issues = {}
    for i, (_, _, depth) in nodes.items():
        seen, at = [i], i
        while True:
            parent = nodes[at][0]
            if parent is None:
                if nodes[at][1] != "codebase":
                    issues[i] = "no_root"
                elif depth != len(seen) - 1:
                    issues[i] = "wrong_depth"
                break
            if parent not in nodes:
                issues[i] = "no_root"
                break
            if parent in seen:
                issues[i] = "cycle" if parent == i else "below_cycle"
                break
            seen.append(parent)
            at = parent
    return issues


@pytest.mark.parametrize("seed, n", [(1, 40), (2, 200), (3, 800)])
def test_random_links(spark, seed, n):
    rng = random.Random(seed)
    nodes = {}
    for i in range(n):
        r = rng.random()
        parent = None if i < 3 or r < 0.02 else f"n{rng.randrange(n)}" if r < 0.08 else "gone" if r < 0.1 else f"n{rng.randrange(i)}"
        nodes[f"n{i}"] = (parent, "codebase" if parent is None and rng.random() < 0.8 else "file", 0)
    depth = {i: len(path(nodes, i)) - 1 for i in nodes}
    nodes = {i: (p, k, depth[i] if rng.random() < 0.9 else 7) for i, (p, k, _) in nodes.items()}
    rows = [(i, p, k, d, rng.randrange(3)) for i, (p, k, d) in nodes.items()]
    df = spark.createDataFrame(rows + rows[: n // 5], SCHEMA).withColumn("near", F.lit(1)).withColumn("cuts", F.lit("x"))
    for locality, size in ((F.lit("one"), 10_000), (F.lit("one"), 5), (F.substring("id", 1, 3), 3), (F.col("id"), 1)):
        got = [tuple(r) for r in broken_links(df, locality=locality, fragment_rows=size).collect()]
        assert len(got) == len(set(got))
        assert dict(got) == brute(nodes)


def path(nodes, i):
    out = [i]
    while nodes[i][0] in nodes and nodes[i][0] not in out:
        i = nodes[i][0]
        out.append(i)
    return out


def test_long_ring_over_fragments(spark):
    rows = [(f"r{i}", f"r{(i + 1) % 50}", "file", 0, 0) for i in range(50)] + [("t", "r3", "file", 0, 0), ("u", "t", "file", 0, 0), ("s", "s", "file", 0, 0)]
    got = dict(tuple(r) for r in broken_links(spark.createDataFrame(rows, SCHEMA), locality=F.col("id")).collect())
    assert got == {**{f"r{i}": "cycle" for i in range(50)}, "t": "below_cycle", "u": "below_cycle", "s": "cycle"}


def test_place_and_order(spark):
    rows = [("r", None, "codebase", 0, 0), ("a", "r", "file", 1, 1), ("b", "r", "file", 1, 0), ("c", "a", "chunk", 2, 0), ("d", "a", "chunk", 2, 0), ("e", "a", "chunk", 2, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    placed = {r.id: r for r in placed_nodes(df, locality=F.col("id")).collect()}
    assert [r.id for r in sorted(placed.values(), key=lambda r: r.order_key)] == ["r", "b", "a", "c", "d", "e"]
    assert placed["d"].path == "r > a > d" and placed["r"].n_descendants == 5 and placed["a"].n_descendants == 3 and placed["c"].steps == 2 and placed["e"].root == "r"
    assert {tuple(r) for r in descendants(df).collect()} == {("r", "a", 1), ("r", "b", 1), ("r", "c", 2), ("r", "d", 2), ("r", "e", 2), ("a", "c", 1), ("a", "d", 1), ("a", "e", 1)}


def test_empty_and_nulls(spark):
    assert hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "x", None, None, None), ("x", None, None, None, None)], SCHEMA)
    assert [tuple(r) for r in broken_links(df).collect()] == [("x", "no_root")]


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 3)] + [(i, i + 1) for i in range(100, 160)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, **{i: 100 for i in range(100, 161)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
