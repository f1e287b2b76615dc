"""Parent-child links to hierarchies: path, depth, root, descendants and broken links.

Rows are cut into fragments of bounded size (by a locality key, salted where one key is too large).
Each fragment is walked depth first with node colouring in one task. What remains is the graph of
fragment roots, whose components are found by pointer doubling on joins; its result is handed down
to the rows. A component of any size is thus spread over many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.lineage import written

TREE, ON_CYCLE, BELOW_CYCLE = 0, 1, 2
LOCAL = "id string, parent string, is_top boolean, given int, frag string, steps int, pre int, size int, state int, line array<struct<ord int, id string>>"


def walk_fragment(rows: pd.DataFrame) -> pd.DataFrame:
    """Depth-first walk of the links among the rows of one group.

    A row whose parent isn't among them starts a tree (``frag`` is its id); ``steps`` is the depth below it, ``pre`` and ``size`` give
    the place in the walk and the rows of the subtree, ``line`` the way down from it in sibling order. Rows on a cycle get state 1, rows below one 2.
    """
    rows = rows.sort_values(["ord", "id", "parent", "given", "kind"], kind="stable", na_position="last").drop_duplicates("id", ignore_index=True)
    with_line = "want_line" in rows.columns
    ids, n = rows["id"].tolist(), len(rows)
    at = {v: i for i, v in enumerate(ids)}
    parents = [at.get(p, -1) if p is not None and p == p else -1 for p in rows["parent"].tolist()]
    children: list[list[int]] = [[] for _ in range(n)]
    for i, p in enumerate(parents):  # rows are in sibling order
        if p >= 0:
            children[p].append(i)
    frag, steps, pre, size, state = [-1] * n, [0] * n, [0] * n, [1] * n, [-1] * n
    count = 0

    def descend(start: int, top: int, as_state: int) -> None:
        nonlocal count
        stack = [(start, 0)]
        order = []
        while stack:
            i, d = stack.pop()
            frag[i], steps[i], pre[i], state[i] = top, d, count, as_state
            count += 1
            order.append(i)
            for c in reversed(children[i]):
                if state[c] < 0:
                    stack.append((c, d + 1))
        for i in reversed(order[1:]):
            size[parents[i]] += size[i]

    for i in range(n):
        if parents[i] < 0:
            descend(i, i, TREE)
    for i in range(n):  # what no root reaches leads into a cycle among these rows
        if state[i] >= 0:
            continue
        trail, grey = [], {}
        while i not in grey:  # colour the way up until it meets itself: that edge goes back
            grey[i] = len(trail)
            trail.append(i)
            i = parents[i]
        ring = trail[grey[i]:]
        for j in ring:
            state[j], frag[j] = ON_CYCLE, j
        for j in ring:
            for c in children[j]:
                if state[c] < 0:
                    descend(c, j, BELOW_CYCLE)
    out = pd.DataFrame({
        "id": ids, "parent": rows["parent"], "is_top": (rows["kind"] == "codebase").astype(bool), "given": rows["given"].astype("Int32"),
        "frag": [ids[f] for f in frag], "steps": np.array(steps, np.int32), "pre": np.array(pre, np.int32), "size": np.array(size, np.int32), "state": np.array(state, np.int32)})
    if with_line:
        ords = [None if o != o else int(o) for o in rows["ord"].astype("float64").tolist()]
        lines: list[list | None] = [None] * n
        for i in sorted(range(n), key=pre.__getitem__):
            if state[i] == TREE:
                lines[i] = [*(lines[parents[i]] if parents[i] >= 0 else []), {"ord": ords[i], "id": ids[i]}]
        out["line"] = lines
    else:
        out["line"] = None
    return out


def _resolve(tops: DataFrame, with_line: bool) -> DataFrame:
    """For each fragment root: ``frag, root, status, base, ring_at``: where its links end, after how many steps, and if it lies on a cycle of fragments the place in the walk at which the cycle enters it. Fragments without parent outside are resolved at once; the others double their pointers until all are, or only cycles remain."""
    cols = ["frag", "up", "base", "status", "root", *(["line"] if with_line else [])]
    now = written(tops.select(*cols), "fragments")
    open_before = -1
    while True:
        left = now.where("status is null").count()
        if left in (0, open_before):
            break
        open_before = left
        above = now.select(F.col("frag").alias("up"), F.col("up").alias("up2"), F.col("base").alias("base2"), F.col("status").alias("status2"), F.col("root").alias("root2"), *([F.col("line").alias("line2")] if with_line else []))
        moved = now.where("status is null").join(above, "up").select(
            "frag", F.when(F.col("status2").isNull(), F.col("up2")).alias("up"), (F.col("base") + F.col("base2")).alias("base"),
            F.col("status2").alias("status"), F.col("root2").alias("root"), *([F.concat("line2", "line").alias("line")] if with_line else []))
        now = written(now.where("status is not null").unionByName(moved), "fragments")
    done = now.where("status is not null")
    if left == 0:
        return done.withColumn("on_ring", F.lit(False))
    step = tops.join(now.where("status is null").select("frag"), "frag", "left_semi").select("frag", "up")
    jump = written(step, "ring")
    for _ in range(math.ceil(math.log2(max(2, left)))):  # after as many steps as there are fragments only cycles are reached
        jump = written(jump.join(jump.select(F.col("frag").alias("up"), F.col("up").alias("up2")), "up").select("frag", F.col("up2").alias("up")), "ring")
    ring = jump.select(F.col("up").alias("frag")).distinct().withColumn("on_ring", F.lit(True))
    rest = now.where("status is null").join(ring, "frag", "left").withColumn("on_ring", F.coalesce("on_ring", F.lit(False))).withColumn("status", F.lit("cycle"))
    return done.withColumn("on_ring", F.lit(False)).unionByName(rest)


def hierarchy(nodes: DataFrame, locality: Column | None = None, with_line: bool = True, fragment_rows: int = 50_000) -> DataFrame:
    """Place of each row of ``nodes`` (``id, parent, kind, depth, sibling_order``; other columns are ignored) in the hierarchy its links form.

    locality: rows with the same value are likely linked; it bears on speed only. Default: the id up to the first colon.
    fragment_rows: rows of a fragment at most; each is a group of its own, whatever the number of tasks.
    Returns ``id, issue, root, steps, depth, line, local_size``: ``issue`` is null for a sound row, else ``cycle``, ``below_cycle``, ``no_root`` or ``wrong_depth``;
    ``root`` and ``steps`` are null on and below cycles; ``line`` (with_line) is the way from the root as (sibling order, id), by which rows sort in document order; siblings in the same place go by id.
    Exact duplicates count once. Of several rows for one id the first in the order sibling_order, parent, depth, kind (nulls last) holds. Rows without id are left out; they can be no one's parent.
    """
    key = locality if locality is not None else F.substring_index("id", ":", 1)
    rows = nodes.where("id is not null").select("id", "parent", "kind", F.col("depth").cast("int").alias("given"), F.col("sibling_order").cast("int").alias("ord"), key.alias("near"))
    if with_line:
        rows = rows.withColumn("want_line", F.lit(True))
    sizes = written(rows.groupBy("near").agg(F.count("*").alias("n")), "localities")
    # localities above a quarter of the bound are cut by hash, the others put together by hash: four shares of a group's mean are far above any it has by chance
    share = max(1, fragment_rows // 4)
    groups = max(1, -(-(sizes.where(F.col("n") <= share).agg(F.sum("n")).first()[0] or 0) // share))
    cuts = sizes.where(F.col("n") > share).select(F.col("near").alias("wide"), F.ceil(F.col("n") / share).cast("int").alias("cuts"))
    rows = rows.join(cuts, rows["near"].eqNullSafe(F.col("wide")), "left")
    rows = rows.withColumn("part", F.when(F.col("cuts").isNotNull(), F.concat_ws(":", F.xxhash64("near"), F.pmod(F.hash("id"), F.col("cuts")))).otherwise(F.pmod(F.xxhash64("near"), F.lit(groups)).cast("string")))
    local = written(rows.drop("cuts", "near", "wide").groupBy("part").applyInPandas(walk_fragment, LOCAL), "walked")

    tops = local.where("state = 0 and id = frag").select("frag", "parent", "is_top", *(["line"] if with_line else []))
    outside = local.select(F.col("id").alias("parent"), F.col("frag").alias("to"), F.col("steps").alias("down"), F.col("state").alias("to_state"), *([F.col("line").alias("to_line")] if with_line else []), "pre")
    linked = tops.join(outside, "parent", "left")
    status = (
        F.when(F.col("parent").isNull(), F.when(F.col("is_top"), "rooted").otherwise("no_root"))
        .when(F.col("to").isNull(), "no_root").when(F.col("to_state") != TREE, "below_cycle"))
    linked = written(linked.select(
        "frag", F.when(status.isNull(), F.col("to")).alias("up"), F.when(status.isNull(), F.col("down") + 1).otherwise(0).alias("base"), status.alias("status"),
        F.when(status.isin("rooted", "no_root"), F.col("frag")).alias("root"), F.col("pre").alias("enters"),
        *([F.when(status.isNull(), F.col("to_line")).otherwise(F.array().cast("array<struct<ord:int,id:string>>")).alias("line")] if with_line else [])), "linked")
    ends = _resolve(linked, with_line)
    rings = ends.where("on_ring").select("frag").join(linked, "frag").select(F.col("up").alias("frag"), F.col("enters").alias("ring_at"))
    ends = ends.join(rings, "frag", "left").select("frag", "base", "status", "root", "ring_at", *([F.col("line").alias("above")] if with_line else []))

    on_ring = F.col("ring_at").isNotNull() & (F.col("pre") <= F.col("ring_at")) & (F.col("ring_at") < F.col("pre") + F.col("size"))
    depth = F.col("base") + F.col("steps")
    ended = F.col("status").isin("rooted", "no_root")
    issue = (
        F.when((F.col("state") == ON_CYCLE) | on_ring, "cycle")
        .when((F.col("state") == BELOW_CYCLE) | F.col("status").isin("cycle", "below_cycle"), "below_cycle")
        .when(F.col("status") == "no_root", "no_root")
        .when(~F.col("given").eqNullSafe(depth), "wrong_depth"))
    inside = local.join(ends, "frag", "left")
    return inside.select(
        "id", issue.alias("issue"), F.when(ended, F.col("root")).alias("root"), F.when(ended, depth).alias("steps"), F.col("given").alias("depth"),
        *([F.when(ended, F.concat("above", "line")).alias("line")] if with_line else []))


def broken_links(nodes: DataFrame, **how) -> DataFrame:
    """``id, issue`` of the rows whose links or depth don't fit, see :func:`hierarchy`."""
    return hierarchy(nodes, with_line=False, **how).where("issue is not null").select("id", "issue")


def descendants(nodes: DataFrame, **how) -> DataFrame:
    """``ancestor, descendant, distance`` for every sound pair; one row per node and step of its path. Rows on or below cycles have none."""
    placed = hierarchy(nodes, with_line=True, **how).where("line is not null")
    return placed.select(F.col("id").alias("descendant"), F.size("line").alias("n"), F.posexplode("line")).select(
        F.col("col")["id"].alias("ancestor"), "descendant", (F.col("n") - 1 - F.col("pos")).alias("distance")).where("distance > 0")


def placed_nodes(nodes: DataFrame, **how) -> DataFrame:
    """``id, root, steps, path, order_key, n_descendants, issue`` for every node: ``path`` is the ids from the root joined by `` > ``, ``order_key`` sorts rows in document order."""
    placed = written(hierarchy(nodes, with_line=True, **how), "placed")
    below = placed.where("line is not null").select(F.explode(F.slice("line", 1, F.size("line") - 1)).alias("a")).groupBy(F.col("a")["id"].alias("id")).agg(F.count("*").alias("n"))
    part = F.transform("line", lambda x: F.concat(F.lpad(F.coalesce(x["ord"], F.lit(999999)).cast("string"), 6, "0"), F.lit(" "), x["id"]))
    return placed.join(below, "id", "left").select(
        "id", "root", "steps", F.array_join(F.transform("line", lambda x: x["id"]), " > ").alias("path"), F.array_join(part, "\u0001").alias("order_key"),
        F.when(F.col("line").isNotNull(), F.coalesce("n", F.lit(0))).alias("n_descendants"), "issue")


def cycles(nodes: DataFrame, **how) -> DataFrame:
    """``ring, position, id`` of the rows on cycles: ``ring`` is the least id of the cycle, ``position`` counts from 0 there along ``parent``.

    Rows double their pointers, so a cycle of any length takes a number of rounds that grows with its logarithm; no task holds a cycle.
    """
    on = broken_links(nodes, **how).where("issue = 'cycle'").select("id")
    best = F.min_by("parent", F.struct(F.col("sibling_order").isNull(), "sibling_order", F.col("parent").isNull(), "parent", F.col("depth").isNull(), "depth", F.col("kind").isNull(), "kind"))
    links = written(nodes.join(on, "id", "left_semi").groupBy("id").agg(best.alias("to")), "ring")
    rounds = math.ceil(math.log2(max(2, links.count())))
    now = links.select("id", "to", F.col("id").alias("least"))
    for _ in range(rounds):
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"))
        now = written(now.join(ahead, "to").select("id", F.col("to2").alias("to"), F.least("least", "least2").alias("least")), "ring")
    ring = now.select("id", F.least("least", "to").alias("ring"))
    # steps along the links to the least id, at which the way ends
    away = written(links.join(ring, "id").select("id", "ring", F.when(F.col("id") == F.col("ring"), F.col("id")).otherwise(F.col("to")).alias("to"), F.when(F.col("id") == F.col("ring"), 0).otherwise(1).alias("left")), "ring")
    for _ in range(rounds):
        ahead = away.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("left").alias("left2"))
        away = written(away.join(ahead, "to").select("id", "ring", F.col("to2").alias("to"), (F.col("left") + F.col("left2")).alias("left")), "ring")
    size = away.groupBy("ring").agg(F.count("*").alias("n"))
    return away.join(size, "ring").select("ring", F.pmod(F.col("n") - F.col("left"), F.col("n")).alias("position"), "id")
