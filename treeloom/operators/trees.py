"""Tree algebra over the flat code table: children, order, leaves, subtrees, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions.text import extension
from treeloom.lineage import written
from treeloom.operators.hierarchy import broken_links, hierarchy

# How kinds rank as evidence; others come last.
KIND_PRIORITY = {
    "module": 1, "file": 2, "class": 3, "function": 4, "type": 5, "variable": 6, "import": 7, "loop": 8, "conditional": 9, "try": 10, "with": 11, "comment": 12, "chunk": 13}


def nodes_of(code: DataFrame, *more: str) -> DataFrame:
    """One row per node with the columns of its place and ``more``; exact duplicates count once."""
    return code.where("id is not null").select("id", "parent", "kind", "depth", "sibling_order", *more).distinct()


def language_of(code: DataFrame, languages: DataFrame) -> DataFrame:
    """``code`` with ``lang``: its language trimmed and in lower case, else that of the file's extension, else null."""
    known = languages.select(F.lower("extension").alias("_ext"), F.col("language").alias("_named"))
    own = F.lower(F.trim("language"))
    joined = code.withColumn("_ext", extension(F.col("file"))).join(known, "_ext", "left")
    return joined.withColumn("lang", F.coalesce(F.when(own != "", own), F.col("_named"))).drop("_ext", "_named")


def child_counts(nodes: DataFrame) -> DataFrame:
    """``id, n_found``: direct children of every node, zero for leaves."""
    counts = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_found"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("n_found", F.lit(0)).alias("n_found"))


def sibling_positions(nodes: DataFrame) -> DataFrame:
    """``id, position``: place from 0 among the children of one parent, in sibling order, ties by id. A parent's children are one window: trees are far wider in all than at any node."""
    w = Window.partitionBy("parent").orderBy(F.col("sibling_order").asc_nulls_last(), "id")
    return nodes.where("parent is not null").select("id", (F.row_number().over(w) - 1).alias("position"))


def ordinal_ids(items: DataFrame, scope: str, name: str, order: list[Column]) -> DataFrame:
    """``items`` with ``ordinal_id``: the name, from its second use in ``scope`` on with ``$2``, ``$3``, ..."""
    n = F.row_number().over(Window.partitionBy(scope, name).orderBy(*order))
    return items.withColumn("ordinal_id", F.concat(name, F.when(n > 1, F.concat(F.lit("$"), n)).otherwise("")))


def subtree_totals(nodes: DataFrame, measure: str, more: list[Column] | None = None) -> DataFrame:
    """``id, n_nodes, total``: nodes of the subtree with its root, and the sum of ``measure`` over them; and further aggregates of the column ``v``, its value."""
    placed = hierarchy(nodes).where("line is not null").select("id", F.transform("line", lambda x: x["id"]).alias("above"))
    measured = placed.join(nodes.select("id", F.col(measure).alias("v")), "id")
    return measured.select("v", F.explode("above").alias("id")).groupBy("id").agg(F.count("*").alias("n_nodes"), F.sum("v").alias("total"), *(more or []))


def climbed(starts: DataFrame, nodes: DataFrame, until: DataFrame | None = None) -> DataFrame:
    """``id, ancestor, up`` of every start (``id``) that is not on or below a cycle, one row per step of its way up (``up`` from 1); no further than the first ancestor in ``until`` (``id``).

    All starts go up together, one step a round, so the work is that of their ways and not of the tree.
    """
    cyclic = broken_links(nodes).where("issue in ('cycle', 'below_cycle')").select("id")
    links = nodes.where("parent is not null").select(F.col("id").alias("at"), "parent").distinct()
    links = written(links.join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi"), "links")
    stops = until.select(F.col("id").alias("at")).distinct() if until is not None else None
    step = starts.select("id").distinct().join(cyclic, "id", "left_anti").withColumn("at", F.col("id"))
    found, rounds = None, 0
    while found is None or not step.isEmpty():
        if found is not None and stops is not None:
            step = step.join(stops, "at", "left_anti")
        rounds += 1
        step = written(step.select("id", "at").join(links, "at").select("id", F.col("parent").alias("at"), F.lit(rounds).alias("up")), "step")
        found = step if found is None else found.unionByName(step)
    return found.select("id", F.col("at").alias("ancestor"), "up")


def first_leaves(nodes: DataFrame, sound_only: bool = True) -> DataFrame:
    """``id, leaf``: for every inner node the leaf that comes first below it in document order; sound_only: none for nodes on or below a cycle, else none where the way of first children has no end.

    The first leaf is where the way of first children ends; pointers along it are doubled, so the rounds grow with the logarithm of the depth.
    """
    order = F.struct(F.col("sibling_order").isNull(), "sibling_order", "id")
    inner = nodes.where("parent is not null").join(nodes.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi")
    now = inner.groupBy(F.col("parent").alias("id")).agg(F.min_by("id", order).alias("leaf"))
    if sound_only:
        now = now.join(broken_links(nodes).where("issue in ('cycle', 'below_cycle')").select("id"), "id", "left_anti")
    now = written(now, "first")
    for _ in range(now.count().bit_length() + 1):  # a longer way goes round
        ahead = now.select(F.col("id").alias("leaf"), F.col("leaf").alias("further"))
        moved = written(now.join(ahead, "leaf", "left").select("id", F.coalesce("further", "leaf").alias("leaf"), F.col("further").isNotNull().alias("moved")), "first")
        now = moved.select("id", "leaf")
        if moved.where("moved").isEmpty():
            return now
    return now.join(now.select(F.col("id").alias("leaf")), "leaf", "left_anti").select("id", "leaf")


def outermost(selected: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id`` of the selected nodes none of whose ancestors is selected; those on or below a cycle stay."""
    chosen = written(selected.select("id").distinct(), "selected")
    inner = climbed(chosen, nodes, until=chosen).join(chosen.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id")
    return chosen.join(inner, "id", "left_anti")


def ordered_leaves(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, leaf, position`` of the leaves below each start (``id``) in document order, from 0; a start without children is its own leaf."""
    placed = hierarchy(nodes).where("line is not null").select("id", "line")
    inner = nodes.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    leaves = placed.join(inner, "id", "left_anti")
    order = F.transform("line", lambda x: F.struct(x["ord"].isNull().alias("last"), x["ord"].alias("ord"), x["id"].alias("id")))
    below = leaves.select(F.col("id").alias("leaf"), order.alias("at"), F.explode(F.transform("line", lambda x: x["id"])).alias("id")).join(starts.select("id").distinct(), "id", "left_semi")
    return below.select("id", "leaf", (F.row_number().over(Window.partitionBy("id").orderBy("at")) - 1).alias("position"))


def enclosing_functions(leaves: DataFrame, functions: DataFrame) -> DataFrame:
    """``id, function_id``: the innermost function whose lines hold those of the leaf: the shortest span, then the later start, then the id. Rows meet by file and by the blocks of 64 lines they touch."""
    block = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 64), F.floor(F.col(b) / 64)))
    f = functions.where("line_start <= line_end").select(F.col("id").alias("function_id"), "file", F.col("line_start").alias("fs"), F.col("line_end").alias("fe"), block("line_start", "line_end").alias("b"))
    x = leaves.select("id", "file", "line_start", "line_end", F.floor(F.col("line_start") / 64).alias("b"))
    met = x.join(f, ["file", "b"]).where("fs <= line_start and line_end <= fe and id <> function_id")
    return met.groupBy("id").agg(F.min_by("function_id", F.struct(F.col("fe") - F.col("fs"), -F.col("fs"), "function_id")).alias("function_id"))


def ranked_children(nodes: DataFrame, k: int, scores: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The first ``k`` children of every node as ``parent, id, rank``, and what is left out as ``parent, kind, n_omitted``.

    Up to ``k`` children keep their sibling order. More are ranked as evidence: README.md first, those with a summary, by kind (:data:`KIND_PRIORITY`), by how many keywords they hold and how often
    (``scores``: ``id, n_distinct, n_total``, such as :func:`~treeloom.operators.evidence.keyword_scores` of their first leaves), by lines, place and id.
    """
    priority = F.coalesce(*[F.when(F.col("kind") == kind, n) for kind, n in KIND_PRIORITY.items()], F.lit(99))
    children = nodes.where("parent is not null")
    if scores is not None:
        children = children.join(scores.select("id", "n_distinct", "n_total"), "id", "left")
    words = [F.coalesce(c, F.lit(0)).desc() for c in ("n_distinct", "n_total")] if scores is not None else []
    natural = [F.col("sibling_order").asc_nulls_last(), F.col("id")]
    order = [F.when(F.col("name") == "README.md", 0).otherwise(1), F.when(F.col("summary").isNull(), 1).otherwise(0), priority, *words, F.coalesce("n_lines", F.lit(0)).desc(), *natural]
    every = children.groupBy("parent", "kind").agg(F.count("*").alias("n"))
    many = children.groupBy("parent").agg(F.count("*").alias("n")).where(F.col("n") > k).select("parent", F.lit(True).alias("many"))
    placed = children.join(many, "parent", "left")
    few = placed.where("many is null").withColumn("rank", F.row_number().over(Window.partitionBy("parent").orderBy(*natural)))
    first = placed.where("many").withColumn("rank", F.row_number().over(Window.partitionBy("parent").orderBy(*order))).where(F.col("rank") <= k)  # the bound is applied before rows are shuffled
    kept = first.groupBy("parent", "kind").agg(F.count("*").alias("n_kept"))
    met = every["parent"].eqNullSafe(kept["parent"]) & every["kind"].eqNullSafe(kept["kind"])
    omitted = every.join(many.select(F.col("parent").alias("full")), every["parent"] == F.col("full"), "left_semi").join(kept, met, "left").select(
        every["parent"], every["kind"], (F.col("n") - F.coalesce("n_kept", F.lit(0))).alias("n_omitted")).where("n_omitted > 0")
    return few.unionByName(first).select("parent", "id", "rank"), omitted


def rolled_up_status(changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, status, has_staged, has_unstaged`` of the changed files' nodes and of everything above them. ``changed``: ``file, status, has_staged, has_unstaged``.

    A file node takes its status, ``modified`` where rows disagree; what is above a changed file is ``modified``; flags are joined by or.
    """
    flags = [F.bool_or("has_staged").alias("has_staged"), F.bool_or("has_unstaged").alias("has_unstaged")]
    merged = changed.groupBy("file").agg(F.when(F.min("status") == F.max("status"), F.min("status")).otherwise("modified").alias("status"), *flags)
    at = nodes.where("kind = 'file'").select("id").join(merged.withColumnRenamed("file", "id"), "id")
    at = written(at, "changed")
    up = climbed(at, nodes).join(at, "id").groupBy(F.col("ancestor").alias("id")).agg(F.lit("modified").alias("status"), *flags)
    return at.unionByName(up)
