"""Functions paired with their documentation.

Each function or method row is read into a syntax tree (:mod:`treeloom.llm.trees`); the declaration's node, the comments
attached to it and the string that opens its body give the pair with exact ranges; documentation that says something is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.functions.text import extension
from treeloom.llm.trees import Node, syntax_tree

LANGUAGES = ["julia", "cpp", "python", "javascript"]

# What comments are that say nothing about the function.
MARKS = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*(?!\*)|//+[!<]?|#+!?|#=|=#|[-;%]{2,})?[ \t]?|[ \t]*\*+/[ \t]*$|[ \t]*=#[ \t]*$", re.M)
DIRECTIVES = re.compile(
    r"(?i)^(?:\w{1,4}: ?format (?:off|on)\b|format (?:off|on)\b|noqa\b|type:|pylint|flake8|mypy|pyright|ruff|isort|fmt:|yapf|pragma|coverage|nosec|eslint|jshint|jslint|tslint|prettier|ts-|@ts-|istanbul|c8|webpack|sourcemappingurl|#\s*sourcemappingurl|global\b|globals\b|jsx|"
    r"nolint|clang-|clang_|cppcheck|lint:|codespell|cspell|bandit|vim?:|-\*-|format:|juliaformatter|@?(?:inline|noinline)$|[!/]?usr/bin|region\b|endregion\b|@(?:flow|jsx|preserve|license|ts-\w+)\b|exported\b|skip-?ci|language=)")
REMINDERS = re.compile(
    r"(?i)^\W*(?:todo|fixme|xxx|tbd|tba|hack|wip)\b|\b(?:missing|no|add|write|needs?|insert|to be|without) (?:a |an |the |some )?(?:doc\w*|description|summary|comment)s?\b|\b(?:document|describe) (?:me|this|it|here)\b|\breplace this (?:text|comment|line|stub|sentence)\b|"
    r"\b(?:auto-?generated|stub|placeholder)\b.{0,40}\b(?:editor|replace|description|comment|documentation|docstring|method|function)\b|\bdescription (?:goes|here|missing|pending|follows)\b|\b(?:doc\w*|description|summary) (?:goes here|here|missing|pending|to follow|follows|tbd)\b|\bto be (?:documented|written|done|described)\b|\blorem ipsum\b|^\W*(?:placeholder|dummy|n/?a|none|empty|undocumented|description|summary|docstring|documentation)\W*$")
LICENCE = re.compile(r"(?i)\bcopyright\b|\(c\)\s*\d{4}|\blicen[cs]ed?\b|\bspdx\b|\ball rights\b|\breleased under\b|\bpermission (?:is|to)\b|\bwarrant(?:y|ies)\b|\bsee NOTICE\b|\bterms in NOTICE\b|\bredistribut")
TAG = re.compile(r"^(?:[@\\](?:param|arg|argument|tparam|return|returns|throws|raises|exception|type|brief|note|see|since|author|date|version|file|class|fn)\b|:(?:param|type|return|returns|rtype|raises)\b|(?:args|arguments|parameters|params|returns?|raises|throws|yields|notes?|examples?|usage)\s*:?\s*$)", re.I)
CODE = re.compile(r"^(?:(?:return|if|for|while|const|let|var|auto|int|void|bool|else|elif|end|import|from|using|print|del|break|continue|pass|raise|throw|def|function|class)\b.*[\w)\]};:=]|[\w.\[\]\"']+\s*(?:[-+*/|&]?=)\s*\S.*|[\w.]+\(.*\)\s*[;:{]?|[{}()\[\];]+|\}\s*(?:else|catch).*|.*[;{}])$")
FILLER = {"function", "method", "func", "fn", "procedure", "routine", "the", "a", "an", "this", "for", "of", "to", "is", "does", "implementation", "definition", "helper", "name"}


def split_words(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+", name)]


def text_of(raw: str, quoted: bool) -> str:
    """A comment or string without its marks."""
    if quoted:
        raw = re.sub(r"^(?i:[rbfu]{0,2}|raw|doc)(\"\"\"|'''|\"|')|(\"\"\"|'''|\"|')$", "", raw)
        return raw.strip()
    return MARKS.sub("", raw).strip()


def says_something(doc: str, name: str, parameters: set[str]) -> bool:
    """Whether any line of a documentation says more than the name: rules, reminders, directives, disabled code, licence notes and bare tags don't."""
    own = set(split_words(name))
    if LICENCE.search(doc):
        doc = "\n".join(x for x in doc.split("\n") if not LICENCE.search(x))
    lines = [x.strip() for x in doc.split("\n")]
    if any(REMINDERS.search(x) for x in lines[:1] if x) and not any(len(re.findall(r"[^\W\d_]{2,}", x)) >= 5 and not REMINDERS.search(x) for x in lines):
        return False
    for x in lines:
        if not re.search(r"[^\W_]", x) or DIRECTIVES.match(x) or REMINDERS.search(x) or LICENCE.search(x):
            continue
        tag = TAG.match(x)
        if tag:
            x = x[tag.end():].strip(" :-{}")
            first, _, rest = x.partition(" ")
            if first.strip(":,-[]").split("=")[0] in parameters or "param" in tag.group().lower():
                x = rest
        if CODE.match(x) and (len(re.findall(r"[^\W\d_]{2,}", re.sub(r"\(.*?\)|[\w.]*[_.(=]\w*", " ", x))) < 4):
            continue
        words = [w for w in split_words(x) if not w.isdigit()]
        said = [w for w in words if w not in own and w not in FILLER and w not in parameters]
        if said and len(words) >= 2:
            return True
    return False


def declared(tree: Node, language: str) -> tuple[Node | None, list[Node], int]:
    """The node the row is of (its first that is neither a comment, a decorator nor a string), the comments and strings attached to it (directly above, with decorators between but no blank line), and the line at which they begin."""
    nodes = tree.children
    at = next((k for k, x in enumerate(nodes) if x.kind in ("function", "class", "statement")), None)
    if at is None:
        return None, [], 0
    above, reach = [], nodes[at].first_line
    for x in reversed(nodes[:at]):
        if x.last_line < reach - 1 or x.kind == "string" and language == "python":  # there a string is a statement of its own
            break
        if x.kind != "decorator":
            above.append(x)
        reach = x.first_line
    return nodes[at], above[::-1], reach


def documentation(source: str, before: str | None, language: str, name: str) -> tuple | None:
    """The documentation that says something, the declaration with its body, the signature, and the first and last line of the declaration in the source, from 0; None if there is none. ``before`` is a comment that ends on the line before the source."""
    node, above, reach = declared(syntax_tree(source, language), language)
    if node is None:
        return None
    head = source[node.start:node.head_end if node.head_end is not None else (source.find("\n", node.start) + 1 or len(source) + 1) - 1].strip()
    bare = re.sub(r"\$\d+$", "", name)
    parameters = {w for w in re.findall(r"[^\W\d]\w*", head.partition("(")[2])}
    texts = [text_of(source[x.start:x.end], x.kind == "string") for x in above]
    if before and reach == 0 and not before.endswith("\n") and before.rsplit("\n", 1)[-1].strip():
        quoted = re.search(r'"""(?:[^"\\]|\\.|"(?!""))*"""\s*\Z', before)
        tail = re.split(r"\n[ \t]*\n", before.replace("\r\n", "\n"))[-1]
        texts.insert(0, text_of(quoted.group().strip(), True) if quoted else text_of(tail, False))
    groups = ["\n".join(x for x in texts if x)]
    if language == "python" and node.children and node.children[0].kind == "string":
        groups.append(text_of(source[node.children[0].start:node.children[0].end], True))
    said = [g for g in groups if g and says_something(g, bare, parameters)]
    return ("\n".join(said), source[node.start:node.end], head, node.first_line, node.last_line) if said else None


def _pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for id_, name, language, line, source, before in zip(batch["id"], batch["name"], batch["language"], batch["line_start"], batch["source"], batch["before"]):
            found = documentation(source, before if isinstance(before, str) else None, language, name if isinstance(name, str) else "")
            if found:
                rows.append((id_, language, *found[:3], *(int(line) + x if line == line and line is not None else None for x in found[3:])))
        yield pd.DataFrame(rows, columns=["id", "language", "doc", "code", "signature", "first_line", "last_line"]).astype({"first_line": "Int32", "last_line": "Int32"})


def documented_functions(code: DataFrame, languages: DataFrame) -> DataFrame:
    """``id, language, doc, code, signature, first_line, last_line`` of the functions and methods whose documentation says something.

    The language is that of the file's extension. Documentation stands directly above the declaration in the row's own source (decorators between), in that of its first child
    if the row has none, in a comment row that ends on the line before, or is the string that opens the body. ``code`` is the declaration with its body as it stands in that source, on the given lines of the file (null for a row without ``line_start``).
    Exact duplicates count once; rows without id, file or any source have no pair; ``summary`` is not used.
    """
    names = languages.where(F.col("language").isin(LANGUAGES)).select(F.lower("extension").alias("ext"), "language").distinct()
    typed = code.select("id", "parent", "kind", "name", "file", "line_start", "line_end", "sibling_order", "source", extension(F.col("file")).alias("ext")).join(names, "ext")
    rows = typed.where("kind in ('function', 'method') and id is not null")
    first = F.min(F.struct("line_start", "sibling_order", "source")).alias("f")
    children = typed.where("source is not null and parent is not null").join(rows.where("source is null").select(F.col("id").alias("parent")).distinct(), "parent", "left_semi")
    children = children.groupBy("parent").agg(first).select(F.col("parent").alias("id"), F.col("f.source").alias("child_source"))
    comments = typed.where("kind = 'comment' and source is not null").groupBy("file", (F.col("line_end") + 1).alias("line_start")).agg(F.max("source").alias("before"))
    own = rows.where("source is not null").select("id", "name", "language", "file", "line_start", "source")
    lent = rows.where("source is null").join(children, "id").select("id", "name", "language", "file", "line_start", F.col("child_source").alias("source"))
    joined = own.unionByName(lent).join(comments, ["file", "line_start"], "left").select("id", "name", "language", "line_start", "source", "before")
    return joined.mapInPandas(_pair, "id string, language string, doc string, code string, signature string, first_line int, last_line int").distinct()
