"""Line differences between versions of texts, their hunks, and change lists in their raw form."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.operators.tables import STATUS_LETTERS, UNMERGED_PAIRS

HUNK = r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def _patches(context: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, old, new in zip(batch["path"], batch["old"], batch["new"]):
                a, b = (x.splitlines() if isinstance(x, str) else [] for x in (old, new))
                names = ("/dev/null" if old is None else f"a/{path}", "/dev/null" if new is None else f"b/{path}")
                out.append("\n".join(difflib.unified_diff(a, b, *names, n=context, lineterm="")))
            yield pd.DataFrame({"path": batch["path"], "patch": out})

    return run


def patches(versions: DataFrame, context: int = 3) -> DataFrame:
    """``path, patch`` for rows ``path, old, new`` whose texts differ: unified differences with so many lines around; a null side is a file that isn't there. Each file is compared in one task."""
    changed = versions.where(~F.col("old").eqNullSafe(F.col("new"))).select("path", "old", "new")
    return changed.mapInPandas(_patches(context), "path string, patch string")


def hunks(patch: DataFrame) -> DataFrame:
    """``path, hunk_no, old_start, old_count, new_start, new_count, n_removed, n_added`` of every hunk of ``path, patch``, numbered from 1 in each file."""
    parts = F.split("patch", r"\n(?=@@ -)")
    rows = patch.select("path", F.posexplode(parts)).where(F.col("col").startswith("@@ -"))
    n = lambda k: F.regexp_extract("col", HUNK, k)
    count = lambda k: F.when(n(k) == "", 1).otherwise(n(k).cast("int"))
    body = F.slice(F.split("col", "\n"), F.lit(2), F.size(F.split("col", "\n")))
    marked = lambda sign: F.size(F.filter(body, lambda x: x.startswith(sign)))
    return rows.select("path", F.col("pos").alias("hunk_no"), n(1).cast("int").alias("old_start"), count(2).alias("old_count"), n(3).cast("int").alias("new_start"), count(4).alias("new_count"), marked("-").alias("n_removed"), marked("+").alias("n_added"))


def selected_patch(patch: DataFrame, wanted: DataFrame) -> DataFrame:
    """``path, patch`` with only the wanted hunks (``path, hunk_no``), behind the file's header."""
    parts = patch.select("path", F.posexplode(F.split("patch", r"\n(?=@@ -)")))
    kept = parts.join(wanted.select("path", F.col("hunk_no").alias("pos")).distinct(), ["path", "pos"], "left_semi")
    both = kept.unionByName(parts.where("pos = 0").join(kept.select("path").distinct(), "path", "left_semi"))
    return both.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "col"))), lambda x: x["col"]), "\n").alias("patch"))


def changed_nodes(base: DataFrame, target: DataFrame) -> DataFrame:
    """``file, id, whole_file`` of nodes (``file, id, text``) whose text differs between two versions; where a node of a file is missing on one side the whole file counts, with a null id."""
    a, b = base.select("file", "id", F.col("text").alias("old"), F.lit(True).alias("in_a")), target.select("file", "id", F.col("text").alias("new"), F.lit(True).alias("in_b"))
    both = a.join(b, ["file", "id"], "full").withColumn("lone", F.col("in_a").isNull() | F.col("in_b").isNull())
    whole = both.groupBy("file").agg(F.bool_or("lone").alias("whole"))
    differing = both.where(~F.col("old").eqNullSafe(F.col("new"))).join(whole, "file")
    return differing.select("file", F.when(~F.col("whole"), F.col("id")).alias("id"), F.col("whole").alias("whole_file")).distinct()


def resolved(selectors: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that selectors (``selector``) mean, as ``file, whole_file, ids``, and the selectors that mean nothing. A selector is a node id or a file path; files, modules and the root mean whole files, which win over parts."""
    hit = selectors.distinct().join(nodes.select(F.col("id").alias("selector"), "kind", "file"), "selector", "left")
    unknown = hit.where("kind is null").select("selector")
    parts = hit.where("kind not in ('file', 'module', 'codebase')").select("file", F.col("selector").alias("id"), F.lit(False).alias("whole"))
    files = nodes.where("kind = 'file'").select(F.col("id").alias("file"))
    folders = files.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/"))), lambda k: F.array_join(F.slice(F.split("file", "/"), 1, k), "/"))).alias("selector"))
    whole = folders.join(hit.where("kind in ('file', 'module', 'codebase')").select("selector"), "selector", "left_semi").select("file", F.lit(None).cast("string").alias("id"), F.lit(True).alias("whole"))
    merged = parts.unionByName(whole).groupBy("file").agg(F.bool_or("whole").alias("whole_file"), F.array_sort(F.collect_set("id")).alias("ids"))
    return merged.withColumn("ids", F.when(F.col("whole_file"), F.array().cast("array<string>")).otherwise(F.col("ids"))), unknown


def name_status(raw: DataFrame, column: str) -> DataFrame:
    """``status, path, old_path`` of change lists in zero-terminated form: a letter (with a score for renames and copies), then one path, or the old one and the new."""
    word = F.coalesce(*[F.when(F.left("token", F.lit(1)) == k, v) for k, v in STATUS_LETTERS.items()])
    tokens = F.filter(F.split(column, "\u0000"), lambda x: x != "")
    # walk the tokens: a letter takes the next token, or the next two
    step = lambda acc, t: F.struct(
        F.when(acc["need"] > 0, acc["need"] - 1).when(t.rlike("^[RC]"), 2).otherwise(1).alias("need"),
        F.when(acc["need"] == 0, F.concat(acc["out"], F.array(F.array(t)))).otherwise(F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(F.concat(F.element_at(acc["out"], -1), F.array(t))))).alias("out"))
    start = F.struct(F.lit(0).alias("need"), F.array().cast("array<array<string>>").alias("out"))
    entries = F.aggregate(tokens, start, step)["out"]
    rows = raw.select(F.explode(entries).alias("e")).select(F.col("e")[0].alias("token"), F.element_at("e", -1).alias("path"), F.when(F.size("e") == 3, F.col("e")[1]).alias("old_path"))
    return rows.select(word.alias("status"), "path", "old_path")


def binary_paths(raw: DataFrame, column: str) -> DataFrame:
    """``path`` of the binary files in line counts in zero-terminated form: both counts are dashes; a rename has no path there but the old and the new one in the two items after, of which the new one counts."""
    tokens = F.split(column, "\u0000")
    found = F.transform(tokens, lambda t, k: F.when(t == "-\t-\t", F.get(tokens, k + 2)).when(t.startswith("-\t-\t"), F.substring(t, F.lit(5), F.length(t))))
    return raw.select(F.explode(found).alias("path")).where("path is not null and path <> ''").distinct()


def porcelain(raw: DataFrame, column: str) -> DataFrame:
    """``path, status, has_staged, has_unstaged`` of status lines ``XY path``: untracked for ``??``, unmerged for the pairs that mean it, else the letter of the index, or of the working tree."""
    xy, path = F.left("line", F.lit(2)), F.substring("line", F.lit(4), F.length("line"))
    rows = raw.select(F.explode(F.filter(F.split(column, "\n"), lambda x: F.length(x) > 3)).alias("line")).select(xy.alias("xy"), path.alias("path"))
    letter = F.when(F.left("xy", F.lit(1)).isin(" ", "?"), F.substring("xy", 2, 1)).otherwise(F.left("xy", F.lit(1)))
    word = F.coalesce(*[F.when(letter == k, v) for k, v in STATUS_LETTERS.items()])
    status = F.when(F.col("xy") == "??", "untracked").when(F.col("xy").isin(UNMERGED_PAIRS), "unmerged").otherwise(word)
    return rows.select("path", status.alias("status"), (~F.left("xy", F.lit(1)).isin(" ", "?")).alias("has_staged"), (F.substring("xy", 2, 1) != " ").alias("has_unstaged"))
