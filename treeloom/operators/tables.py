"""Keyed tables: comparison by content hash, replacement by file, status merging, stored versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The letters of a change list and what they stand for; pairs of letters that mean an unmerged path.
STATUS_LETTERS = {"A": "added", "D": "deleted", "M": "modified", "R": "renamed", "C": "copied", "T": "type_changed", "U": "unmerged"}
UNMERGED_PAIRS = ["DD", "AU", "UD", "UA", "DU", "AA", "UU"]


def compared(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """``key, state``: ``new``, ``deleted``, ``changed`` or ``unchanged`` by content; keys are unique on each side."""
    a = old.select(key, F.col(content).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(key, F.col(content).alias("_new"), F.lit(True).alias("_in_new"))
    state = F.when(F.col("_in_old").isNull(), "new").when(F.col("_in_new").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("state"))


def replaced(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``table`` with all rows of the keys in ``fresh`` replaced by those of ``fresh``."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def overlaid(buffer: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of ``stored`` with those of ``buffer`` (the same columns) in place of, and beside, them: a value of the buffer counts where it is not null."""
    rest = [c for c in stored.columns if c != key]
    both = stored.select(key, *[F.col(c).alias(f"_{c}") for c in rest]).join(buffer.select(key, *rest), key, "full")
    return both.select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in rest])


def overridden(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A table of settings with the rows of ``changes`` in place of those with the same key."""
    return replaced(base, changes.select(*base.columns), key)


def merged_status(changes: DataFrame) -> DataFrame:
    """One row per path of several phases: unmerged before untracked before the rest, ``modified`` where those disagree; flags joined by or."""
    rank = F.when(F.col("status") == "unmerged", 0).when(F.col("status") == "untracked", 1).otherwise(2)
    ranked = changes.withColumn("_r", rank)
    best = ranked.groupBy("path").agg(F.min("_r").alias("_best"))
    top = ranked.join(best, "path").where("_r = _best").groupBy("path").agg(F.when(F.min("status") == F.max("status"), F.min("status")).otherwise("modified").alias("status"))
    flags = changes.groupBy("path").agg(F.max("old_path").alias("old_path"), *[F.bool_or(c).alias(c) for c in ("is_binary", "is_indexed", "git_has_staged", "git_has_unstaged")])
    return top.join(flags, "path")


def file_changes(diff: DataFrame, working: DataFrame, binary: DataFrame, indexed: DataFrame, staged: DataFrame, unstaged: DataFrame, phase: str) -> DataFrame:
    """The changed files of a phase (``all``, ``staged`` or ``unstaged``): ``path, old_path, status, is_binary, is_indexed, git_has_staged, git_has_unstaged``.

    diff: ``path, old_path, status`` of the phase; working: ``path, status, has_staged, has_unstaged`` of the working tree, where untracked and unmerged paths are taken from; binary, indexed, staged and
    unstaged: paths. Unmerged comes before untracked (which counts in the phases all and unstaged) before the entry of the diff.
    """
    flag = lambda df, name: df.select("path").distinct().withColumn(name, F.lit(True))
    unstaged = unstaged.select("path").unionByName(working.where("status = 'untracked'").select("path"))
    tree = working.where("status in ('untracked', 'unmerged')").groupBy("path").agg(F.max_by("status", F.when(F.col("status") == "unmerged", 1).otherwise(0)).alias("_tree"), F.bool_or("has_staged").alias("_s"), F.bool_or("has_unstaged").alias("_u"))
    entry = diff.groupBy("path").agg(F.max(F.struct("status", "old_path")).alias("_d"))
    rows = entry.join(tree, "path", "full")
    for df, name in ((binary, "_b"), (indexed, "_i"), (staged, "_st"), (unstaged, "_un")):
        rows = rows.join(flag(df, name), "path", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    unmerged = F.coalesce((F.col("_tree") == "unmerged") & (F.lit(phase == "all") | F.lit(phase == "staged") & has("_s") | F.lit(phase == "unstaged") & has("_u") | F.col("_d").isNotNull()), F.lit(False))
    untracked = F.coalesce((F.col("_tree") == "untracked") & F.lit(phase != "staged"), F.lit(False))
    pick = lambda a, b, c: F.when(unmerged, a).when(untracked, b).otherwise(c)
    return rows.where(unmerged | untracked | F.col("_d").isNotNull()).select(
        "path", pick(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("_d.old_path")).alias("old_path"), pick(F.lit("unmerged"), F.lit("untracked"), F.col("_d.status")).alias("status"),
        pick(F.lit(False), has("_b"), has("_b")).alias("is_binary"), pick(has("_i"), F.lit(False), has("_i")).alias("is_indexed"),
        pick(has("_s") | has("_st"), F.lit(False), has("_st")).alias("git_has_staged"), pick(has("_u") | has("_un"), F.lit(True), has("_un")).alias("git_has_unstaged"))


def save_version(table: DataFrame, folder: str, version: int, token: str) -> None:
    """Writes a version below ``folder`` and then a pointer to it beside the earlier ones; readers see the old version or the new one, never part of it."""
    table.write.mode("overwrite").parquet(f"{folder}/v{version}")
    table.sparkSession.createDataFrame([(version, token)], "version int, token string").coalesce(1).write.mode("append").json(f"{folder}/current")


def load_version(spark: SparkSession, folder: str, token: str) -> DataFrame | None:
    """The current version, or None if there is none or it was written under another compatibility token."""
    try:
        now = spark.read.schema("version int, token string").json(f"{folder}/current").orderBy(F.col("version").desc()).first()
    except Exception as e:  # the folder isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return spark.read.parquet(f"{folder}/v{now['version']}") if now and now["token"] == token else None
