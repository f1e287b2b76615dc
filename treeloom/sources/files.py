"""File trees as tables: discovery with ignore files, fingerprints, texts, structural rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.functions.scalars import ignore_rules
from treeloom.functions.text import extension

# Folders that are never listed.
EXCLUDED = [".git", ".hg", ".svn"]


def ignore_files(spark: SparkSession, root: str, name: str = ".gitignore") -> list[tuple[str, list[str]]]:
    """Folder and lines of the ignore files below ``root``, those above first. Only names are listed; ignore files are few and small against what they rule."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base, found, listed = top.toUri().getPath().rstrip("/") + "/", [], fs.listFiles(top, True)
    while listed.hasNext():
        path = listed.next().getPath()
        if path.getName() == name:
            folder = path.getParent().toUri().getPath().removeprefix(base.rstrip("/")).strip("/")
            stream = fs.open(path)
            found.append((folder, jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()))
            stream.close()
    return sorted(found, key=lambda r: (len(r[0]), r[0]))


def file_tree(spark: SparkSession, root: str, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """``path, content, hash, is_binary`` of the files below ``root``, without excluded folders and what ignore files rule out.

    path: relative to the root. rules: folders with the lines of their ignore files, default those found. Rules of nested ignore files hold below their folder and come after those above;
    an ignored folder hides all below it, even if a later rule takes a file in it back. A file with a zero byte in its first 8192 is binary. Spark doesn't list names that begin with a dot or underscore.
    """
    root = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/")
    path = F.expr("substring(p, position(b in p) + length(b))")
    files = raw.select(F.regexp_replace("path", "^[a-z]+:/*(?=/)", "").alias("p"), base.alias("b"), "content").select(path.alias("path"), "content")
    files = files.where(~F.col("path").rlike("(^|/)(" + "|".join(x.replace(".", r"\.") for x in EXCLUDED) + ")/"))
    rules = ignore_files(spark, root) if rules is None else rules
    hidden = F.exists(_folders(F.col("path")), lambda f: _verdict(f, rules)) | _verdict(F.col("path"), rules)
    return files.where(~hidden).select("path", "content", F.sha2("content", 256).alias("hash"), F.expr("position(X'00' in substring(content, 1, 8192)) > 0").alias("is_binary"))


def _folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(F.size(parts) > 1, F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))).otherwise(""))


def _verdict(path: Column, rules: list[tuple[str, list[str]]]) -> Column:
    verdict = F.lit(False)
    for folder, lines in rules:
        prefix = f"{folder}/" if folder else ""
        inner = F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise("")
        for rule, back in ignore_rules(lines):
            verdict = F.when((inner != "") & inner.rlike(rule), F.lit(not back)).otherwise(verdict)
    return verdict


def texts(files: DataFrame, languages: DataFrame) -> DataFrame:
    """``path, hash, language, text`` of the files that aren't binary; the language is that of the extension, null if it has none."""
    known = languages.select(F.lower("extension").alias("_ext"), "language").distinct()
    rows = files.where(~F.col("is_binary")).withColumn("_ext", extension(F.col("path")))
    return rows.join(known, "_ext", "left").select("path", "hash", "language", F.decode("content", "UTF-8").alias("text"))


def structural_rows(paths: DataFrame, root: str) -> DataFrame:
    """``id, parent, kind, name, depth, sibling_order``: the root, a module for every folder that holds files, and the files. Below the root, modules and files are numbered together by name; ids are relative to the root."""
    files = paths.select(F.col("path").alias("id"), F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(root).alias("parent"), F.lit("file").alias("kind"))
    modules = files.where(F.col("parent") != root).select(F.col("parent").alias("id"), F.lit(root).alias("parent"), F.lit("module").alias("kind")).distinct()
    rows = files.unionByName(modules).withColumn("name", F.regexp_extract("id", "([^/]+)$", 1))
    depth = F.when((F.col("kind") == "module") | (F.col("parent") == root), 1).otherwise(2)
    placed = rows.withColumn("depth", depth).withColumn("sibling_order", F.row_number().over(Window.partitionBy("parent").orderBy("name", "id")) - 1)
    top = paths.sparkSession.createDataFrame([(root, None, "codebase", root, 0, 0)], "id string, parent string, kind string, name string, depth int, sibling_order int")
    return top.unionByName(placed)
