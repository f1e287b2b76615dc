import random

import pytest

from treeloom.llm import spans


def brute(texts, least):
    seen = {}
    for i, t in texts.items():
        for k in range(len(t) - least + 1):
            seen.setdefault(t[k:k + least], set()).add(i)
    return {(a, b) for s in seen.values() for a in s for b in s if a < b}


def covered(texts, least):
    seen = {}
    for i, t in texts.items():
        for k in range(len(t) - least + 1):
            seen.setdefault(t[k:k + least], set()).add(i)
    out = {}
    for i, t in texts.items():
        marks = set()
        for k in range(len(t) - least + 1):
            if len(seen[t[k:k + least]]) > 1:
                marks |= set(range(k, k + least))
        out[i] = len(marks)
    return out


@pytest.mark.parametrize("seed, large, batches", [(1, 64, 1), (2, 64, 3), (3, 3, 2), (4, 1, 5)])
def test_against_brute_force(spark, monkeypatch, seed, large, batches):
    """Small and large groups, runs of exactly the least length, one short of it, repetitions within a text, periodic text."""
    monkeypatch.setattr(spans, "LARGE_GROUP", large)
    monkeypatch.setattr(spans, "PART_DOCS", 4)
    rng, least = random.Random(seed), 30
    make = lambda n: "".join(rng.choice("abcdeö\U0001f600 \n") for _ in range(n))
    parts = [make(n) for n in (29, 30, 31, 60, 200)] + ["ab" * 40, "x" * 90]
    texts = {i: "".join(rng.choice([make(rng.randrange(0, 50)), rng.choice(parts), rng.choice(parts)[:rng.randrange(20, 60)]]) for _ in range(rng.randrange(0, 5))) for i in range(60)}
    texts[60] = texts[61] = make(80)
    rows = [(i, t) for i, t in texts.items()] + [(62, None), (None, texts[60]), (60, texts[60])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as pos", "3 as batch")
    pairs, found = spans.shared_spans(df, least, batches=batches, fanout=2)
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, least)
    amounts = {r.doc_id: (r.n_chars, r.shared_chars) for r in spans.shared_amounts(df, least, batches=batches).collect()}
    assert amounts == {i: (len(texts[i]), n) for i, n in covered(texts, least).items()}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spans.shared_spans(df)[0].count() == 0
    assert spans.shared_amounts(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")).collect()[0].share == 0.0


def test_compaction_and_reopening(spark):
    """Runs are merged level by level, a stored index goes on where it ended, and nothing stays in the catalogue."""
    rng, least = random.Random(9), 30
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    part = make(50)
    texts = {i: make(40) + (part if i % 3 == 0 else "") + make(20) for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tables = spark.catalog.listTables()
    index, got = spans.SpanIndex(spark, least, fanout=2), set()
    for k in range(5):
        if k == 3:
            index.close()
            index = spans.SpanIndex.open(spark, index.folder)
        pairs, _ = index.add(df.where(f"doc_id % 5 = {k}"))
        got |= {tuple(r) for r in pairs.collect()}
        levels = sorted(level for kind, level, _ in index.runs if kind == "run")
        assert len(levels) == bin(k + 1).count("1")  # as a counter in base two
    assert got == brute(texts, least)
    index.discard()
    assert spark.catalog.listTables() == tables
