"""Identifier uses: clean rows, references, set algebra with declarations, tokens of source text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.functions.text import composed

# Kinds of nodes whose names count as declared.
DECLARING = ["function", "class", "type", "variable", "import"]
# Words that are no names.
RESERVED = (
    "and as assert async auto await begin bool break case catch char class const continue def default del delete do double elif else elseif end enum except export extends false finally float for from function global "
    "if import in int is lambda let local macro module namespace new not nothing null nullptr or pass quote raise return self static struct super switch template this throw true try type typedef typename using var void where while with yield").split()
TOKEN = r"([A-Za-z_][A-Za-z0-9_]*)[ ]*(\(?)"
ASSIGNED = r"([A-Za-z_][A-Za-z0-9_]*)[ ]*=[^=]"
DECLARED = r"(?:def|function|macro|class|struct|module|const|let|var|auto|for)[ ]+([A-Za-z_][A-Za-z0-9_]*)"


def clean_symbols(symbols: DataFrame) -> DataFrame:
    """``node_id, symbol, kind``: without Unicode white space at the ends and in composed form, kinds in lower case, each row once; empty symbols, unknown kinds and rows without node are left out."""
    rows = symbols.select("node_id", composed("symbol").alias("symbol"), F.lower(composed("kind")).alias("kind"))
    return rows.where("symbol <> '' and kind in ('call', 'var_ref') and node_id is not null").distinct()


def known_names(code: DataFrame) -> DataFrame:
    """``name`` of every declaration (:data:`DECLARING`) in a known language other than Markdown; ``code`` has ``kind, name, lang``."""
    return code.where(F.col("kind").isin(DECLARING)).where("name is not null and lang <> 'markdown'").select("name").distinct()


def used_and_declared(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Uses whose symbol is declared somewhere."""
    return symbols.join(names.withColumnRenamed("name", "symbol"), "symbol", "left_semi")


def scopes(code: DataFrame) -> DataFrame:
    """``id, scope``: of every leaf, itself if it is a function or method, else the innermost function whose lines hold it, else itself."""
    from treeloom.operators.trees import enclosing_functions

    leaves = code.where("source is not null and file is not null").select("id", "kind", "file", "line_start", "line_end").distinct()
    functions = code.where("kind in ('function', 'method') and file is not null").select("id", "file", "line_start", "line_end").distinct()
    around = enclosing_functions(leaves.where("kind not in ('function', 'method')"), functions)
    return leaves.select("id").distinct().join(around, "id", "left").select("id", F.coalesce("function_id", "id").alias("scope"))


def text_symbols(code: DataFrame) -> DataFrame:
    """``node_id, symbol, kind`` read from the source of leaves (``id, kind, file, line_start, line_end, source, lang``) in a known language other than Markdown.

    call: a name with a bracket after it; var_ref: a name that is neither called in the leaf nor defined anywhere in its scope (:func:`scopes`). A name is defined by an assignment or a
    declaring word before it. Reserved words are no names; each row comes once.
    """
    leaves = code.where("source is not null and lang <> 'markdown'").select("id", "source").distinct()
    named = lambda pattern: F.regexp_extract_all("source", F.lit(pattern), F.lit(1))
    tokens = leaves.select("id", F.explode(F.regexp_extract_all("source", F.lit(TOKEN), F.lit(0))).alias("t")).select("id", F.regexp_extract("t", "^([A-Za-z0-9_]+)", 1).alias("symbol"), F.col("t").endswith("(").alias("called"))
    tokens = tokens.where(~F.col("symbol").isin(RESERVED)).groupBy("id", "symbol").agg(F.bool_or("called").alias("called"))
    within = scopes(code)
    defined = leaves.select("id", F.explode(F.array_union(named(ASSIGNED), named(DECLARED))).alias("symbol")).join(within, "id").select("scope", "symbol").distinct()
    refs = tokens.where("not called").join(within, "id").join(defined, ["scope", "symbol"], "left_anti")
    calls = tokens.where("called").select(F.col("id").alias("node_id"), "symbol", F.lit("call").alias("kind"))
    return calls.unionByName(refs.select(F.col("id").alias("node_id"), "symbol", F.lit("var_ref").alias("kind")))


def markdown_symbols(code: DataFrame, names: DataFrame, tags: list[str]) -> DataFrame:
    """``node_id, symbol, kind`` of Markdown leaves (``id, source, lang``): from fences with one of the tags as in :func:`text_symbols`, each for itself; from fences without tag and from indented blocks the tokens in ``names``. Other fences and running text give none."""
    leaves = code.where("source is not null and lang = 'markdown'").select("id", "source").distinct()
    fences = leaves.select("id", F.posexplode(F.regexp_extract_all("source", F.lit(r"(?s)```[A-Za-z0-9_+#-]*\n.*?```"), F.lit(0)))).select(
        "id", "pos", F.lower(F.regexp_extract("col", "^```([A-Za-z0-9_+#-]*)", 1)).alias("tag"), F.regexp_extract("col", r"(?s)^```[A-Za-z0-9_+#-]*\n(.*?)```$", 1).alias("text"))
    split = lambda rows, *keys: rows.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("t")).select(*keys, F.regexp_extract("t", "^([A-Za-z0-9_]+)", 1).alias("symbol"), F.col("t").endswith("(").alias("called"))
    tagged = fences.where(F.col("tag").isin(tags))
    own = split(tagged, "id", "pos").where(~F.col("symbol").isin(RESERVED)).groupBy("id", "pos", "symbol").agg(F.bool_or("called").alias("called"))
    named = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    defined = tagged.select("id", "pos", F.explode(F.array_union(named(ASSIGNED), named(DECLARED))).alias("symbol")).distinct()
    own = own.where("called").unionByName(own.where("not called").join(defined, ["id", "pos", "symbol"], "left_anti"))
    indented = leaves.select("id", F.explode(F.split("source", "\n")).alias("text")).where("text like '    %' or text like '\t%'")
    known = split(fences.where("tag = ''").select("id", "text").unionByName(indented), "id").join(names.withColumnRenamed("name", "symbol"), "symbol", "left_semi")
    kind = F.when(F.col("called"), "call").otherwise("var_ref").alias("kind")
    return own.select(F.col("id").alias("node_id"), "symbol", kind).unionByName(known.select(F.col("id").alias("node_id"), "symbol", kind)).distinct()


def scope_definitions(code: DataFrame) -> DataFrame:
    """``node_id, symbol``: names of the nodes that begin within the lines of each leaf's scope (:func:`scopes`)."""
    spans = code.where("file is not null and line_start <= line_end").select(F.col("id").alias("scope"), "file", "line_start", "line_end").distinct()
    blocks = F.explode(F.sequence(F.floor(F.col("line_start") / 64), F.floor(F.col("line_end") / 64)))
    named = code.where("name is not null and file is not null").select("file", F.col("line_start").alias("at"), F.col("name").alias("symbol"), F.floor(F.col("line_start") / 64).alias("b")).distinct()
    found = spans.withColumn("b", blocks).join(named, ["file", "b"]).where("line_start <= at and at <= line_end").select("scope", "symbol").distinct()
    return scopes(code).join(found, "scope").select(F.col("id").alias("node_id"), "symbol").distinct()


def free_references(symbols: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """``node_id, symbol``: names a leaf refers to without calling them and, given the ``definitions`` (``node_id, symbol``) of its scope, without defining them there."""
    refs, calls = (symbols.where(F.col("kind") == k).select("node_id", "symbol").distinct() for k in ("var_ref", "call"))
    free = refs.join(calls, ["node_id", "symbol"], "left_anti")
    return free.join(definitions, ["node_id", "symbol"], "left_anti") if definitions is not None else free


def call_edges(symbols: DataFrame, code: DataFrame) -> DataFrame:
    """``repository, caller, callee, n``: calls between functions by name; a callee is the function or method of that name in the caller's repository, each of them if there are several."""
    repo = lambda c: F.substring_index(c, "/", 1)
    functions = code.where("kind in ('function', 'method')").select("id", "name").distinct().select(F.col("id").alias("callee"), F.col("name").alias("symbol"), repo("id").alias("repository"))
    callers = code.where("kind in ('function', 'method')").select(F.col("id").alias("node_id")).distinct()
    calls = symbols.where("kind = 'call'").join(callers, "node_id", "left_semi").withColumn("repository", repo("node_id"))
    return calls.join(functions, ["repository", "symbol"]).groupBy("repository", F.col("node_id").alias("caller"), "callee").agg(F.count("*").alias("n"))


def text_tokens(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, token, kind``: identifiers of a text, a call where a bracket follows the identifier at once or after blanks; each with how often it occurs."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)[ ]*(\(?)"), F.lit(0))
    rows = texts.select(key, F.explode(found).alias("t"))
    name, call = F.regexp_extract("t", r"^([A-Za-z0-9_]+)", 1), F.when(F.col("t").endswith("("), "call").otherwise("var_ref")
    return rows.select(key, name.alias("token"), call.alias("kind")).groupBy(key, "token", "kind").agg(F.count("*").alias("n"))
