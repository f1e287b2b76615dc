"""Filling containers of fixed capacity, by a grouping genetic algorithm on islands.

Texts fall by hash into cells of bounded size. In each cell several islands evolve packings: a
crossover injects whole well-filled bins of one parent into the other and drops the bins that hold
the same texts; a mutation empties the least filled bins and some others. What was displaced is
exchanged for less in bins that it fills better, and the rest is best-fitted. Between epochs each island's best packing
migrates to the next one; at the end the best packing of a cell is taken, and the least filled bins of all
cells are packed anew together.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.lineage import written
from treeloom.llm.tokens import VOCABULARY, sized_texts

CELL_ITEMS, ISLANDS, EPOCHS, POPULATION, GENERATIONS, KINDS_AT_ONCE = 1_000, 2, 2, 6, 30, 100
#: Displaced texts that are tried in exchanges at most at once, largest first; the others are best-fitted.
TRIED = 40
STATE = "container_name string, cell int, island int, capacity int, sizes array<int>, packings array<array<int>>, bins int, squares double, best_fit_bins int"


def best_fit(bins: list[list[int]], fill: list[int], items: list[int], sizes: list[int], capacity: int) -> None:
    """Put items, as ordered, each into the bin it fits best, opening bins as needed."""
    room = sorted((capacity - f, k) for k, f in enumerate(fill) if f < capacity)
    for i in items:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
        else:
            left, k = capacity, len(bins)
            bins.append([])
            fill.append(0)
        bins[k].append(i)
        fill[k] += sizes[i]
        if left > sizes[i]:
            insort(room, (left - sizes[i], k))


def exchanged(bins: list[list[int]], fill: list[int], free: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Displaced items change places with less in bins that they fill better: one or two items of a bin for one or two larger ones. Returns what is displaced then."""
    free = sorted(free, key=lambda i: sizes[i])
    for k, group in enumerate(bins):
        if fill[k] == capacity or not free:
            continue
        out = [(sizes[i], (i,)) for i in group] + [(sizes[i] + sizes[j], (i, j)) for n, i in enumerate(group) for j in group[n + 1:]]
        best, found = 0, None
        for taken, leave in [(0, ()), *out]:
            room = capacity - fill[k] + taken
            at = bisect_right(free, room, key=lambda i: sizes[i])
            if at and sizes[free[at - 1]] - taken > best:
                best, found = sizes[free[at - 1]] - taken, (leave, (free[at - 1],))
            low, high = 0, min(at, len(free)) - 1
            while low < high:  # the best two of the sorted sizes
                both = sizes[free[low]] + sizes[free[high]]
                if both > room:
                    high -= 1
                    continue
                if both - taken > best:
                    best, found = both - taken, (leave, (free[low], free[high]))
                low += 1
            if best == capacity - fill[k]:
                break
        if found:
            leave, enter = found
            bins[k] = [i for i in group if i not in leave] + list(enter)
            fill[k] += best
            free = sorted([i for i in free if i not in enter] + list(leave), key=lambda i: sizes[i])
    return free


def refilled(bins: list[list[int]], displaced: list[int], sizes: list[int], capacity: int) -> list[int]:
    """The packing after displaced items were put back."""
    fill = [sum(sizes[i] for i in g) for g in bins]
    displaced.sort(key=lambda i: -sizes[i])
    tried = exchanged(bins, fill, displaced[:TRIED], sizes, capacity)
    best_fit(bins, fill, sorted(tried + displaced[TRIED:], key=lambda i: -sizes[i]), sizes, capacity)
    return _bin_of(bins, len(sizes))


def _groups(packing: list[int]) -> list[list[int]]:
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(packing):
        groups.setdefault(b, []).append(i)
    return list(groups.values())


def crossed(one: list[int], other: list[int], sizes: list[int], capacity: int, rng: random.Random) -> list[int]:
    """A child of two packings (bin of each item): well-filled bins of the other go whole into the first."""
    ranked = sorted(_groups(other), key=lambda g: -sum(sizes[i] for i in g))
    injected = [g for g in ranked[: max(1, len(ranked) // 2)] if rng.random() < 0.6]
    taken = {i for g in injected for i in g}
    bins, displaced = [list(g) for g in injected], []
    for g in _groups(one):
        rest = [i for i in g if i not in taken]
        if len(rest) == len(g):
            bins.append(g)
        else:
            displaced.extend(rest)
    return refilled(bins, displaced, sizes, capacity)


def mutated(packing: list[int], sizes: list[int], capacity: int, rng: random.Random) -> list[int]:
    """A packing of which the two least filled bins and up to three others were emptied."""
    ranked = sorted(_groups(packing), key=lambda g: sum(sizes[i] for i in g))
    emptied = {0, 1} | {rng.randrange(len(ranked)) for _ in range(3)}
    return refilled([g for k, g in enumerate(ranked) if k not in emptied], [i for k, g in enumerate(ranked) if k in emptied for i in g], sizes, capacity)


def least_bins(sizes: list[int], capacity: int) -> int:
    """Bins that no packing can do without: by the sum, and for each size by the items that can't share a bin with one of that size."""
    ordered = sorted(sizes, reverse=True)
    ahead = [0]
    for x in ordered:
        ahead.append(ahead[-1] + x)
    n, best = len(ordered), max(1, -(-ahead[-1] // capacity))
    halves = bisect_left(ordered, -(capacity // 2), key=lambda x: -x)  # items above half
    for a in sorted({x for x in ordered if x <= capacity // 2} | {0}):
        alone = bisect_left(ordered, -(capacity - a), key=lambda x: -x)  # items that leave less room than a
        last = bisect_right(ordered, -a, key=lambda x: -x) if a else n
        middle = (halves - alone) * capacity - (ahead[halves] - ahead[alone])
        best = max(best, halves + max(0, -(-(ahead[last] - ahead[halves] - middle) // capacity)))
    return best


def _bin_of(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, g in enumerate(bins):
        for i in g:
            out[i] = k
    return out


def fitness(packing: list[int], sizes: list[int]) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones, which leave room that can be used."""
    fill: dict[int, int] = {}
    for i, b in enumerate(packing):
        fill[b] = fill.get(b, 0) + sizes[i]
    return len(fill), -float(sum(f * f for f in fill.values()))


def evolve(sizes: list[int], capacity: int, packings: list[list[int]], seed: int) -> list[list[int]]:
    """Packings after some generations, the best first: crossovers and mutations in turn, each child in the place of the worst if it is better. A packing that reaches the lower bound ends the search."""
    rng, n = random.Random(seed), len(sizes)
    least = least_bins(sizes, capacity)
    ranked = sorted(packings, key=lambda p: fitness(p, sizes))
    while len(ranked) < POPULATION and not (ranked and fitness(ranked[0], sizes)[0] <= least):
        noise = 0.0 if not ranked else 0.2
        order = sorted(range(n), key=lambda i: -sizes[i] * (1 + noise * rng.random()))
        bins: list[list[int]] = []
        best_fit(bins, [], order, sizes, capacity)
        ranked.append(_bin_of(bins, n))
    scored = sorted((fitness(p, sizes), k, p) for k, p in enumerate(ranked))
    for g in range(GENERATIONS):
        if scored[0][0][0] <= least:
            break
        if g % 2 and len(scored) > 1:
            one, other = rng.sample(range(len(scored)), 2)
            child = crossed(scored[one][2], scored[other][2], sizes, capacity, rng)
        else:
            child = mutated(scored[0 if g % 4 else rng.randrange(len(scored))][2], sizes, capacity, rng)
        worth = fitness(child, sizes)
        if all(worth != s for s, _, _ in scored):
            scored = sorted([*scored, (worth, len(ranked) + g, child)])[:POPULATION]
    return [p for _, _, p in scored]


def best_fit_bins(sizes: list[int], capacity: int) -> int:
    """Bins of the plain best fit, largest first."""
    bins: list[list[int]] = []
    best_fit(bins, [], sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, capacity)
    return len(bins)


def _epoch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["container_name", "cell", "island", "capacity", "sizes", "packings", "bins", "squares", "best_fit_bins"]
    for batch in batches:
        for name, cell, island, capacity, sizes, packings in zip(batch["container_name"], batch["cell"], batch["island"], batch["capacity"], batch["sizes"], batch["packings"]):
            sizes = [int(x) for x in sizes]
            ranked = evolve(sizes, int(capacity), [[int(b) for b in p] for p in packings], int(cell) * ISLANDS + int(island))
            yield pd.DataFrame([(name, cell, island, capacity, sizes, ranked, *fitness(ranked[0], sizes), best_fit_bins(sizes, int(capacity)))], columns=columns)


def _evolved(cells: DataFrame) -> DataFrame:
    """``container_name, cell, bins, best_fit_bins``: the best packing of each cell (``container_name, cell, capacity, items``) as the bin of each item, and the bins plain best fit takes."""
    state = cells.select("container_name", "cell", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "capacity", F.transform("items", lambda x: x["n_tokens"]).alias("sizes"), F.array().cast("array<array<int>>").alias("packings"))
    spark = cells.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    for epoch in range(EPOCHS):  # a stated number of tasks: the rows are few bytes and much work, so they mustn't be put together by size
        if epoch:  # each island's best goes to the next
            elite = state.select("container_name", "cell", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.slice("packings", 1, 1).alias("elite"))
            state = state.join(elite, ["container_name", "cell", "island"]).withColumn("packings", F.array_distinct(F.concat("elite", "packings"))).drop("elite")
        state = written(state.repartition(tasks, "container_name", "cell", "island").mapInPandas(_epoch, STATE), "epoch")
    best = F.min_by(F.struct(F.col("packings")[0].alias("bins"), "best_fit_bins"), F.struct("bins", "squares", "island")).alias("b")
    return state.groupBy("container_name", "cell").agg(best).select("container_name", "cell", "b.*")


def _into_cells(loose: DataFrame, cell_items: int) -> DataFrame:
    """Loose pieces in cells of about ``cell_items`` by hash: ``container_name, cell, capacity, items``."""
    counts = loose.groupBy("container_name", "capacity").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / cell_items)).cast("int").alias("cells"))
    rows = loose.join(counts, ["container_name", "capacity"]).withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece_no"), F.col("cells")).cast("int"))
    items = F.sort_array(F.collect_list(F.struct("n_tokens", "doc_id", "piece_no", "start_token")), asc=False)
    return written(rows.groupBy("container_name", "cell", "capacity").agg(items.alias("items")), "cells")


def _placed(cells: DataFrame, chosen: DataFrame, mark: str) -> DataFrame:
    return cells.join(chosen, ["container_name", "cell"]).select("container_name", "cell", "capacity", F.explode(F.arrays_zip("items", "bins")).alias("z")).select(
        "container_name", F.concat_ws("/", "container_name", F.lit(mark) if mark else F.lit(None), "cell", F.col("z.bins")).alias("bin_id"), "cell", "capacity", "z.items.doc_id", "z.items.piece_no", "z.items.start_token", "z.items.n_tokens")


def _packed(documents: DataFrame, containers: DataFrame, vocabulary: str, cell_items: int) -> tuple[DataFrame, DataFrame]:
    """The placed pieces, and ``container_name, bins, best_fit_bins`` of every cell."""
    sized = written(sized_texts(documents, path=vocabulary).select("doc_id", "n_tokens"), "sized")
    kinds = containers.where("capacity_tokens > 0 and container_name is not null").groupBy("container_name").agg(F.max("capacity_tokens")).orderBy("container_name").collect()
    blocks = [kinds[k:k + KINDS_AT_ONCE] for k in range(0, len(kinds), KINDS_AT_ONCE)]  # each text is placed once for each kind
    every = reduce(DataFrame.unionByName, [
        sized.withColumn("kind", F.explode(F.array(*[F.struct(F.lit(n).alias("container_name"), F.lit(int(c)).alias("capacity")) for n, c in block]))).select("doc_id", "n_tokens", "kind.*")
        for block in blocks or [[("none", 1)]]])
    every = every if kinds else every.limit(0)
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int") - 1)
    pieces = every.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last))).withColumn("start_token", F.col("piece_no") * F.col("capacity"))
    pieces = pieces.withColumn("n_tokens", F.least("capacity", F.col("n_tokens") - F.col("start_token")))
    full = pieces.where("n_tokens = capacity").select(
        "container_name", F.concat_ws("/", "container_name", F.lit("full"), "doc_id", "piece_no").alias("bin_id"), "doc_id", "piece_no", "start_token", "n_tokens", F.lit(0).alias("space_left"))
    cells = _into_cells(pieces.where("n_tokens < capacity"), cell_items)
    chosen = written(_evolved(cells), "chosen")
    rows = written(_placed(cells, chosen, ""), "placed")
    # the least filled bin of each cell is packed anew with those of the other cells, where that takes fewer bins
    bins = rows.groupBy("container_name", "capacity", "cell", "bin_id").agg(F.sum("n_tokens").alias("used"))
    several = chosen.groupBy("container_name").agg(F.count("*").alias("cells")).where("cells > 1").select("container_name")
    open_bins = bins.groupBy("container_name", "capacity", "cell").agg(F.min_by("bin_id", F.struct("used", "bin_id")).alias("bin_id")).join(several, "container_name", "left_semi")
    open_bins = written(open_bins.select("container_name", "bin_id"), "open")
    again = _into_cells(rows.join(open_bins, ["container_name", "bin_id"], "left_semi").drop("bin_id", "cell"), cell_items)
    anew = written(_evolved(again), "anew")
    taken = anew.groupBy("container_name").agg(F.sum(F.array_max("bins") + 1).alias("after")).join(open_bins.groupBy("container_name").agg(F.count("*").alias("before")), "container_name").where("after < before").select("container_name")
    kept = rows.join(open_bins.join(taken, "container_name", "left_semi"), ["container_name", "bin_id"], "left_anti")
    rows = kept.unionByName(_placed(again, anew, "rest").join(taken, "container_name", "left_semi"))
    used = rows.groupBy("container_name", "bin_id").agg(F.sum("n_tokens").alias("used"))
    rows = rows.join(used, ["container_name", "bin_id"]).select("container_name", "bin_id", "doc_id", "piece_no", "start_token", "n_tokens", (F.col("capacity") - F.col("used")).cast("int").alias("space_left"))
    report = chosen.select("container_name", (F.array_max("bins") + 1).alias("bins"), "best_fit_bins")
    return rows.unionByName(full), report


def packed(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY, cell_items: int = CELL_ITEMS) -> DataFrame:
    """``container_name, bin_id, doc_id, piece_no, start_token, n_tokens, space_left`` for every text and container.

    A text longer than the capacity is cut into pieces of exactly the capacity and a rest; others stay whole. ``bin_id`` is the filled copy of the container, ``space_left`` what is free in it.
    Texts without tokens (null, empty) are placed too and take no room. Exact duplicates count once, of several texts for one id the one with the greatest SHA-256 holds; rows without id, and containers
    without a positive capacity, are left out; of several capacities for one name the greatest holds. Extra columns are ignored.
    """
    return _packed(documents, containers, vocabulary, cell_items)[0]


def usage(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY, cell_items: int = CELL_ITEMS) -> DataFrame:
    """``container_name, n_bins, n_items, tokens, least_bins, best_fit_bins, fill``: ``least_bins`` is the tokens over the capacity, rounded up, which no packing can beat; ``best_fit_bins`` what plain best fit, largest first, takes in the same cells."""
    rows, report = _packed(documents, containers, vocabulary, cell_items)
    total = rows.groupBy("container_name").agg(
        F.countDistinct("bin_id").alias("n_bins"), F.count("*").alias("n_items"), F.sum("n_tokens").alias("tokens"),
        F.sum(F.when(F.contains("bin_id", F.lit("/full/")), 1).otherwise(0)).alias("full"))
    fitted = report.groupBy("container_name").agg(F.sum("best_fit_bins").alias("fitted"))
    capacity = containers.where("capacity_tokens > 0").groupBy("container_name").agg(F.max("capacity_tokens").alias("capacity"))
    return total.join(fitted, "container_name", "left").join(capacity, "container_name").select(
        "container_name", "n_bins", "n_items", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"), (F.col("full") + F.coalesce("fitted", F.lit(0))).alias("best_fit_bins"),
        F.round(F.col("tokens") / (F.col("n_bins") * F.col("capacity")), 6).alias("fill"))
