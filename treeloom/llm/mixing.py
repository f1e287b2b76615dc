"""Mixing sources to target weights, by a min-cost flow over membership patterns.

A text that several sources hold belongs to all of them. Texts are summed up by the set of sources
they belong to; a flow routes their tokens to the quotas of the sources, where each further use of
a text costs more than the one before. Texts are then taken in a seeded order to fill the flows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions.text import strip_unicode
from treeloom.lineage import written
from treeloom.llm.tokens import VOCABULARY, sized_texts

FLOWS = "mix_name string, pattern string, source string, lo bigint, hi bigint, once bigint, budget bigint"


class Flow:
    """Arcs with capacity and cost; ``run`` sends as much as it can along cheapest ways."""

    def __init__(self):
        self.out: dict[object, list[int]] = {}
        self.arcs: list[list] = []  # to, capacity left, cost

    def arc(self, a, b, capacity: int, cost: int) -> int:
        for x, y, c, k in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.arcs))
            self.out.setdefault(y, [])
            self.arcs.append([y, c, k])
        return len(self.arcs) - 2

    def sent(self, arc: int) -> int:
        return self.arcs[arc + 1][1]

    def run(self, source, sink) -> None:
        height = dict.fromkeys(self.out, 0)
        while True:
            reach, via, todo = {source: 0}, {}, [(0, 0, source)]
            tie = 0
            while todo:
                d, _, a = heappop(todo)
                if d > reach[a]:
                    continue
                for e in self.out[a]:
                    b, left, cost = self.arcs[e]
                    new = d + cost + height[a] - height[b]
                    if left and new < reach.get(b, math.inf):
                        reach[b], via[b] = new, e
                        tie += 1
                        heappush(todo, (new, tie, b))
            if sink not in reach:
                return
            for a in height:
                height[a] += min(reach.get(a, math.inf), reach[sink])
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.arcs[via[at] ^ 1][0]
            amount = min(self.arcs[e][1] for e in path)
            for e in path:
                self.arcs[e][1] -= amount
                self.arcs[e ^ 1][1] += amount


def route(patterns: dict[str, int], targets: dict[str, tuple[float, int]], budget: int) -> list[tuple[str, str, int, int, int]]:
    """``pattern, source, lo, hi, tokens of the pattern``: the part of a pattern's tokens, laid end to end once per use, that goes to each source."""
    flow, ways = Flow(), []
    for pattern, once in sorted(patterns.items()):
        own = [s for s in pattern.split("\u0001") if targets.get(s, (0, 0))[0] > 0 and targets[s][1] > 0]
        for use in range(max((targets[s][1] for s in own), default=0)):
            flow.arc("from", ("p", pattern), once, use * use)
        ways += [(pattern, s, once, flow.arc(("p", pattern), ("s", s), once * targets[s][1], 0)) for s in own]
    for s, (share, _) in sorted(targets.items()):
        flow.arc(("s", s), "to", round(share * budget), 0)
    flow.out.setdefault("from", [])
    flow.out.setdefault("to", [])
    flow.run("from", "to")
    out, place = [], {}
    for pattern, s, once, arc in ways:
        sent = flow.sent(arc)
        if sent:
            lo = place.get(pattern, 0)
            place[pattern] = lo + sent
            out.append((pattern, s, lo, lo + sent, once))
    return out


def _route_mixes(budget: int | None):
    def run(mix: pd.DataFrame) -> pd.DataFrame:
        name = mix["mix_name"].iloc[0]
        targets = {s: (float(w), int(r)) for s, w, r in zip(mix["source"], mix["target_share"], mix["max_repeats"])}
        held = mix.dropna(subset=["pattern"])
        patterns = {p: int(n) for p, n in zip(held["pattern"], held["once"])}
        usable = {p: n for p, n in patterns.items() if any(targets.get(s, (0, 0))[0] > 0 for s in p.split("\u0001"))}
        total = budget if budget is not None else sum(usable.values())
        return pd.DataFrame([(name, p, s, lo, hi, once, total) for p, s, lo, hi, once in route(usable, targets, total)], columns=["mix_name", "pattern", "source", "lo", "hi", "once", "budget"])

    return run


def mixture(documents: DataFrame, mix_targets: DataFrame, budget: int | None = None, seed: int = 17, vocabulary: str = VOCABULARY) -> DataFrame:
    """``mix_name, source, doc_id, n_tokens, times, budget``: the texts chosen for each mix, the source they count for, and how often.

    budget: tokens of a mix; default all tokens of the distinct texts its sources hold. No text is used more than ``max_repeats`` times in all (a text of several sources: the greatest of theirs).
    Sources are compared without white space at the ends and in lower case. Copies of a text count as one text of all their sources; ``doc_id`` is the least of them.
    Texts without tokens, without source, or only in sources of weight zero are in no mix. Exact duplicate rows count once. The order of choice is a hash of the text and ``seed``.
    """
    name = lambda c: F.lower(strip_unicode(F.col(c)))
    rows = sized_texts(documents, "source", path=vocabulary).where("n_tokens > 0").withColumn("source", name("source")).where("source <> ''")
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.array_join(F.array_sort(F.collect_set("source")), "\u0001").alias("pattern"))
    sized = written(texts.select("doc_id", "pattern", "n_tokens", F.xxhash64(F.lit(seed), "digest").alias("h")), "sized")
    bits = max(4, min(20, math.ceil(math.log2(max(2, sized.count() / 10_000))) + 4))
    sized = sized.withColumn("slot", F.shiftrightunsigned("h", 64 - bits))
    slots = written(sized.groupBy("pattern", "slot").agg(F.sum("n_tokens").alias("n")), "slots")  # at most 2^bits rows a pattern
    ahead = slots.withColumn("before", F.sum("n").over(Window.partitionBy("pattern").orderBy("slot")) - F.col("n")).select("pattern", "slot", "before")
    inside = F.sum("n_tokens").over(Window.partitionBy("pattern", "slot").orderBy("h", "doc_id")) - F.col("n_tokens")
    placed = sized.withColumn("inside", inside).join(ahead, ["pattern", "slot"]).select("doc_id", "pattern", "n_tokens", (F.col("before") + F.col("inside") + F.col("n_tokens") / 2).alias("mid"))

    targets = mix_targets.where("mix_name is not null and source is not null and target_share is not null").select("mix_name", name("source").alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).distinct()
    sums = slots.groupBy("pattern").agg(F.sum("n").alias("once")).withColumn("source", F.explode(F.split("pattern", "\u0001")))  # a row per set of sources and source in it
    flows = written(targets.join(sums, "source", "left").groupBy("mix_name").applyInPandas(_route_mixes(budget), FLOWS), "flows")
    uses = F.greatest(F.lit(0), F.ceil((F.col("hi") - F.col("mid")) / F.col("once"))) - F.greatest(F.lit(0), F.ceil((F.col("lo") - F.col("mid")) / F.col("once")))
    return placed.join(flows, "pattern").withColumn("times", uses.cast("int")).where("times > 0").select("mix_name", "source", "doc_id", "n_tokens", "times", "budget")


def shares(documents: DataFrame, mix_targets: DataFrame, **how) -> DataFrame:
    """``mix_name, source, target_share, n_texts, tokens, actual_share, share_of_budget`` for every row of the targets: what each source really reaches."""
    got = mixture(documents, mix_targets, **how).groupBy("mix_name", "source").agg(F.count("*").alias("n_texts"), F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.max("budget").alias("budget"))
    targets = mix_targets.select("mix_name", F.lower(strip_unicode(F.col("source"))).alias("source"), "target_share").distinct()
    rows = targets.join(got, ["mix_name", "source"], "left")
    w = Window.partitionBy("mix_name")
    return rows.select(
        "mix_name", "source", "target_share", F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.round(F.coalesce("tokens", F.lit(0)) / F.sum("tokens").over(w), 6).alias("actual_share"), F.round(F.coalesce("tokens", F.lit(0)) / F.max("budget").over(w), 6).alias("share_of_budget"))
