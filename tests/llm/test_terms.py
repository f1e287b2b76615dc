import random
import unicodedata

from treeloom.llm.terms import term_frequencies

SCHEMA = "file string, node_id string, symbol string, kind string"


def brute(rows):
    seen, nodes, every = {}, {}, set()
    for file, node, symbol, kind in set(rows):
        if symbol is None or kind is None:
            continue
        s, k = unicodedata.normalize("NFC", symbol.strip()), kind.strip().lower()
        if not s or k not in ("call", "var_ref"):
            continue
        seen[s, k] = seen.get((s, k), 0) + 1
        nodes.setdefault((s, k), set())
        if node is not None:
            nodes[s, k].add(node)
            every.add(node)
    return {(s, k, n, len(nodes[s, k]), "rare" if len(nodes[s, k]) < 3 else "common" if len(nodes[s, k]) > 0.2 * len(every) else None) for (s, k), n in seen.items()}


def test_splits_against_brute_force(spark):
    """A hot term and a small bound: partitions are split by term and then by record."""
    rng = random.Random(1)
    rows = [(f"f{rng.randrange(3)}", rng.choice([None, f"n{rng.randrange(400)}"]), "hot" if rng.random() < 0.4 else f"s{int(rng.paretovariate(0.6)) % 300}", rng.choice(["call", " VAR_REF", "Call\u00a0", "x", None])) for _ in range(4000)]
    rows += [("f", "n1", " caf\u00e9", "call"), ("f", "n2", "cafe\u0301\t", "call"), ("f", None, "", "call"), ("f", "n", None, "call"), ("f", "n", "  ", "call")] + rows[:300]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "2 as r1", "3 as _k")
    for bound in (50, 1_000_000):
        got = [tuple(r) for r in term_frequencies(df, partition_rows=bound).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute(rows)


def test_empty(spark):
    assert term_frequencies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_groups_are_split(spark):
    """One term without nodes, one term of one node in many files, and copies of one row: no part exceeds the bound, nothing counts twice."""
    from treeloom.llm import terms

    rows = [(f"f{i}", None, "hot", "call") for i in range(700)] + [(f"f{i}", "n1", "hot", "call") for i in range(600)] + [("f", "n2", "copy", "call")] * 500 + [("f", f"n{i}", "x", "call") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    parts, n_parts = terms.radix_partitions(terms.counting_rows(df), df.count(), 60)
    sizes = [r["count"] for r in parts.groupBy("part").count().collect()]
    assert max(sizes) <= 60 and len(sizes) <= n_parts
    assert {tuple(r) for r in term_frequencies(df, partition_rows=60).collect()} == brute(rows)
