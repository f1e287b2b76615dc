"""Hierarchical task tables: checks, progress, next task, roll-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.operators.trees import climbed, subtree_totals

STATUSES = ["pending", "in_progress", "done"]


def problems(tasks: DataFrame) -> DataFrame:
    """``problem, id`` of a task table (``list_id, id, parent, description, status``): duplicate ids, missing parents, unknown states, empty descriptions, several active tasks, active tasks with children."""
    ids = tasks.select("list_id", "id").distinct()
    inner = tasks.where("parent is not null").select("list_id", F.col("parent").alias("id")).distinct()
    active = tasks.where("status = 'in_progress'")
    found = [
        tasks.groupBy("list_id", "id").count().where("count > 1").select(F.lit("duplicate_id").alias("problem"), "list_id", "id"),
        tasks.where("parent is not null").join(ids.select("list_id", F.col("id").alias("parent")), ["list_id", "parent"], "left_anti").select(F.lit("missing_parent").alias("problem"), "list_id", "id"),
        tasks.where(~F.col("status").isin(STATUSES) | F.col("status").isNull()).select(F.lit("unknown_status").alias("problem"), "list_id", "id"),
        tasks.where("description is null or trim(description) = ''").select(F.lit("no_description").alias("problem"), "list_id", "id"),
        active.join(active.groupBy("list_id").count().where("count > 1").select("list_id"), "list_id", "left_semi").select(F.lit("several_active").alias("problem"), "list_id", "id"),
        active.join(inner, ["list_id", "id"], "left_semi").select(F.lit("active_with_children").alias("problem"), "list_id", "id")]
    return reduce(DataFrame.unionByName, found)


def progress(tasks: DataFrame) -> DataFrame:
    """``list_id, done, in_progress, pending``: tasks by state."""
    return tasks.groupBy("list_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def next_pending(tasks: DataFrame, order: str) -> DataFrame:
    """``list_id, id``: the first pending leaf after the active task, else the first of all; ``order`` is the row order of the table."""
    inner = tasks.where("parent is not null").select("list_id", F.col("parent").alias("id")).distinct()
    leaves = tasks.join(inner, ["list_id", "id"], "left_anti").where("status = 'pending'")
    active = tasks.where("status = 'in_progress'").groupBy("list_id").agg(F.max(order).alias("after"))
    ranked = leaves.join(active, "list_id", "left").withColumn("later", F.when(F.col(order) > F.col("after"), 0).otherwise(1))
    first = F.row_number().over(Window.partitionBy("list_id").orderBy("later", order))
    return ranked.withColumn("n", first).where("n = 1").select("list_id", "id")


def closed_parents(tasks: DataFrame) -> DataFrame:
    """``list_id, id`` of tasks all of whose children are done but that aren't."""
    done = tasks.where("parent is not null").groupBy("list_id", F.col("parent").alias("id")).agg(F.bool_and(F.col("status") == "done").alias("all_done"))
    return tasks.where("status <> 'done'").join(done.where("all_done"), ["list_id", "id"], "left_semi").select("list_id", "id")


def folded_states(tasks: DataFrame) -> DataFrame:
    """``id, status`` of the tasks with children, from the leaves up: ``done`` if all leaves below are, else ``pending``; those on or below a cycle have none. ``tasks`` has ``id, parent, kind, depth, sibling_order, status``."""
    inner = tasks.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    leaves = tasks.join(inner.withColumn("inner", F.lit(True)), "id", "left")
    opened = leaves.withColumn("open", F.when(F.col("inner").isNull() & ~F.col("status").eqNullSafe("done"), 1).otherwise(0))
    totals = subtree_totals(opened, "open")
    return totals.join(inner, "id", "left_semi").select("id", F.when(F.col("total") == 0, "done").otherwise("pending").alias("status"))


def subtree_ends(tasks: DataFrame, row_no: str) -> DataFrame:
    """``id, end_row``: the last row of each task's subtree in the row order of its list; a task inserted after it comes next."""
    return subtree_totals(tasks, row_no, [F.max("v").alias("end_row")]).select("id", "end_row")


def insert_rows(tasks: DataFrame, row_no: str) -> DataFrame:
    """``list_id, id, after_row, first_child_row``: the row at which a task enters that is put after ``id`` as its sibling, or below it as its first child."""
    own = tasks.select("list_id", "id", F.col(row_no).alias("own"))
    return own.join(subtree_ends(tasks, row_no), "id").select("list_id", "id", (F.col("end_row") + 1).alias("after_row"), (F.col("own") + 1).alias("first_child_row"))


def started(tasks: DataFrame, chosen: DataFrame) -> DataFrame:
    """``tasks`` with one leaf of each list begun: ``chosen`` (``list_id, id``) is in progress, what was in progress there is pending again, and all tasks above the chosen one are pending.

    A choice that isn't a pending leaf of its list, and lists without one, change nothing. ``tasks`` has ``list_id, id, parent, kind, depth, sibling_order, status``; ids are unique.
    """
    inner = tasks.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    valid = tasks.join(chosen.select("list_id", "id").distinct(), ["list_id", "id"], "left_semi").where("status = 'pending'").join(inner, "id", "left_anti").select("list_id", "id")
    above = climbed(valid, tasks).select(F.col("ancestor").alias("id"), F.lit(True).alias("above")).distinct()
    rows = tasks.join(valid.select("id", F.lit(True).alias("begun")), "id", "left").join(valid.select("list_id", F.lit(True).alias("touched")).distinct(), "list_id", "left").join(above, "id", "left")
    status = F.when(F.col("begun"), "in_progress").when(F.col("touched") & (F.col("status") == "in_progress") | F.col("above"), "pending").otherwise(F.col("status"))
    return rows.withColumn("status", status).select(*tasks.columns)


def focus_paths(tasks: DataFrame, active: DataFrame) -> DataFrame:
    """``list_id, depth, id`` of the way from the root to each list's active task (``list_id, id``), depth from 1; a task on or below a cycle has only itself."""
    up = climbed(active, tasks).unionByName(active.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("up")).distinct())
    deepest = up.groupBy("id").agg(F.max("up").alias("n"))
    return up.join(deepest, "id").join(active.select("list_id", "id").distinct(), "id").select("list_id", (F.col("n") - F.col("up") + 1).alias("depth"), F.col("ancestor").alias("id"))
