import random
from datetime import datetime, timedelta

import pytest

from treeloom.operators.snapshots import listing_changes, snapshot_diff

SCHEMA = "snapshot_no int, delivered_at timestamp, path string, hash string, commit_hash string"


def brute(rows):
    held = {}
    for no, at, path, h, c in set(rows):
        if path is None or no is None:
            continue
        p = path.replace("\\", "/")
        while "//" in p:
            p = p.replace("//", "/")
        p = p.removeprefix("./")
        if not p:
            continue
        rank = (at or datetime.min, (h or "").lower(), (c or "").lower())
        if (p, no) not in held or rank > held[p, no][0]:
            held[p, no] = (rank, h and h.lower(), c and c.lower())
    out, listed = set(), {}
    for (p, no), (_, h, c) in held.items():
        listed.setdefault(p.split("/")[0], {}).setdefault(no, {})[p] = (h, c)
    for listings in listed.values():
        nos = sorted(listings)
        for a, b in zip(nos, nos[1:]):
            old, new = listings[a], listings[b]
            for p in old.keys() | new.keys():
                if p not in old:
                    out.add((p, b, "added"))
                elif p not in new:
                    out.add((p, b, "removed"))
                elif old[p][0] != new[p][0]:
                    out.add((p, b, "changed"))
                elif old[p][1] is not None and new[p][1] is not None and not old[p][1].startswith(new[p][1]) and not new[p][1].startswith(old[p][1]):
                    out.add((p, b, "recommitted"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    start = datetime(2025, 1, 1)
    rows = []
    for _ in range(1500):
        repo, file = rng.choice("abc"), f"d/f{rng.randrange(60)}"
        path = rng.choice([f"{repo}/{file}", f"./{repo}/{file}", f"{repo}\\{file}", f"{repo}//{file}"])
        rows.append((rng.choice([1, 2, 4, 5, None]), start + timedelta(seconds=rng.randrange(50)), path if rng.random() > 0.02 else None, rng.choice(["AA", "aa", "b", None]), rng.choice([None, "c1", "c1d2", "e5", ""])))
    rows += rows[:100]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as grp", "2 as h", "3 as seq")
    got = [tuple(r) for r in listing_changes(df).select("path", "snapshot_no", "change").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_empty_and_single(spark):
    assert listing_changes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert listing_changes(spark.createDataFrame([(1, None, "a/b", None, None)], SCHEMA)).count() == 0


def test_deep_tree(spark):
    """Many ranges and few differences: only those rows come back."""
    rows = [("g", s, f"k{i}", f"v{i}" if (i, s) != (77, 2) else "new") for i in range(3000) for s in (1, 2, 3)]
    df = spark.createDataFrame(rows, "grp string, seq int, key string, v string")
    diff = snapshot_diff(df, ["v"], rows_per_leaf=1)
    assert diff.count() < 30
    assert {(r.seq, r.now.v, r.before.v) for r in diff.where("not now <=> before").collect()} == {(2, "new", "v77"), (3, "v77", "new")}
