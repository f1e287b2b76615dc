"""Syntax trees of source text: statements, declarations with their bodies, comments and decorators with exact ranges.

The tokens are those of :mod:`treeloom.llm.syntax`. A tree holds what a damaged text still shows: a body that isn't closed ends
with the text. Nodes are kept on a stack, so depth is not bounded by recursion.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

from treeloom.llm.syntax import languages

# Words that open a body in Python and Julia, that begin a statement on a new line in JavaScript, and that head a body which is no function's.
PYTHON_BLOCKS = frozenset("def class if for while with try else elif except finally async match case".split())
JULIA_BLOCKS = frozenset("function macro module baremodule struct begin quote let if for while try do abstract primitive".split())
STATEMENTS = frozenset("function class const let var export import return if for while do switch try throw async".split())
CONTROL = frozenset("if for while switch catch else do try with".split())
CLASSES = frozenset("class struct enum union namespace interface module baremodule".split())
PYTHON_TEXTS = r'(?i:[rbfu]{0,2})(?:"""(?:[^\\]|\\.)*?(?:"""|\Z)|\'\'\'(?:[^\\]|\\.)*?(?:\'\'\'|\Z))|'
DECLARED_ON_LINE = re.compile(r"[ \t]*(?:function|macro)\b|[ \t]+\w+\(.*\)\s*=")
SHORT_FUNCTION = re.compile(r"[\w.!]+\(.*?\)[^=\n]*=(?!=)", re.S)


@dataclass(slots=True)
class Node:
    """kind: ``file``, ``function``, ``class``, ``statement``, ``comment``, ``string`` or ``decorator``; ``head_end`` is where the head of a body ends, None if there is none; lines count from 0."""

    kind: str
    start: int
    end: int = -1
    head_end: int | None = None
    first_line: int = 0
    last_line: int = 0
    indent: int = 0
    children: list[Node] = field(default_factory=list)


def visited(node: Node) -> Iterator[Node]:
    """The node and all below it, in the order of the text."""
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed(node.children))


class _Builder:
    def __init__(self, source: str, language: str):
        self.source, self.language = source, language
        self.root = Node("file", 0)
        self.stack, self.now, self.depth, self.words = [self.root], None, 0, []

    def leaf(self, kind: str, start: int, end: int) -> None:
        self.stack[-1].children.append(Node(kind, start, end))

    def begin(self, kind: str, start: int, indent: int = 0) -> None:
        self.now, self.words = Node(kind, start, indent=indent), []
        self.stack[-1].children.append(self.now)

    def finish(self, end: int) -> None:
        if self.now is not None:
            self.now.end = end
        self.now, self.depth = None, 0

    def open(self, head_end: int) -> None:
        """The body of the current statement begins."""
        self.now.head_end = head_end
        self.now.kind = self.kind_of_body()
        self.stack.append(self.now)
        self.now, self.depth = None, 0

    def kind_of_body(self) -> str:
        words = self.words
        if self.language in ("python", "julia"):
            return "function" if {"def", "function", "macro"} & set(words[:2]) else "class" if words and words[0] in CLASSES else "statement"
        if "(" in words and not (words[0] in CONTROL):
            return "function"
        return "class" if CLASSES & set(words) else "statement"

    def close(self, end: int) -> None:
        if len(self.stack) > 1:
            self.stack.pop().end = end

    def done(self) -> Node:
        n = len(self.source)
        breaks = [m.start() for m in re.finditer("\n", self.source)]
        for node in visited(self.root):
            node.end = n if node.end < 0 else node.end
            node.first_line, node.last_line = bisect_right(breaks, node.start - 1), bisect_right(breaks, max(node.start, node.end - 1) - 1)
        return self.root


def _by_braces(b: _Builder, token: re.Pattern) -> None:
    last, at_line = 0, True
    for m in token.finditer(b.source):
        t = m.group()
        if t[0] == "\n" or t.strip() == "":
            if b.now is not None and b.now.kind == "decorator" and b.depth <= 0:
                b.finish(last)
            at_line = True
            continue
        if t[:2] in ("//", "/*"):
            if b.now is None:
                b.leaf("comment", m.start(), m.end())
            continue
        if b.language == "cpp" and t[0] in " \t#":
            continue
        if at_line and b.language == "javascript" and b.now is not None and b.depth <= 0 and t in STATEMENTS and b.words and b.words[-1] not in ("export", "default", "async"):
            b.finish(last)
        at_line, last = False, m.end()
        if b.now is None:
            if t == "}":
                b.close(m.end())
                continue
            if t in ";,)":
                continue
            b.begin("decorator" if t == "@" and b.language == "javascript" else "statement", m.start())
        if t == "{" and b.depth <= 0:
            b.open(m.start())
        elif t == "}" and b.depth <= 0:  # the last statement of a body needs no semicolon
            b.finish(m.start())
            b.close(m.end())
        elif t == ";" and b.depth <= 0:
            b.finish(m.end())
        else:
            b.depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
            b.words.append(t)


def _by_indents(b: _Builder, token: re.Pattern) -> None:
    last, indent, at_line = 0, len(re.match(r"[ \t\f]*", b.source).group()), True
    for m in token.finditer(b.source):
        t = m.group()
        if t[0] == "\n":
            if b.depth <= 0:
                if b.now is not None:
                    b.finish(last)
                at_line, indent = True, len(t) - 1
            continue
        if t.strip() == "" or t[0] == "\\" or len(t) == 1 and not t.isprintable():
            continue
        if t[0] == "#":
            if b.now is None:
                b.leaf("comment", m.start(), m.end())
            continue
        if b.now is None:
            if at_line and t[0] not in "<>=|":  # no statement begins so: marks of a merge don't end a body
                while len(b.stack) > 1 and indent <= b.stack[-1].indent:
                    b.close(last + b.source.startswith("\n", last))
            b.begin("decorator" if t == "@" else "string" if t[-1] in "\"'" or t[:3].lstrip("rbfuRBFU")[:1] in ("'", '"') else "statement", m.start(), indent)
        elif b.now.kind == "string" and t != ";":
            b.now.kind = "statement"
        at_line, last = False, m.end()
        if t == ":" and b.depth <= 0 and b.words and b.words[0] in PYTHON_BLOCKS:
            b.open(m.start())
        elif t == ";" and b.depth <= 0:
            b.finish(m.end())
        else:
            b.depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
            b.words.append(t)
    b.finish(last)
    while len(b.stack) > 1:
        b.close(last + b.source.startswith("\n", last))


def _by_ends(b: _Builder, token: re.Pattern) -> None:
    last, opens = 0, 0
    for m in token.finditer(b.source):
        t = m.group()
        if t[0] == "\n":
            if b.depth <= 0 and b.now is not None:
                if opens:
                    b.open(m.start())
                    opens = 0
                else:
                    if b.now.kind == "statement" and SHORT_FUNCTION.match(b.source, b.now.start, last):
                        b.now.kind, b.now.head_end = "function", last
                    b.finish(last)
            continue
        if t.strip() == "":
            continue
        if t[0] == "#":
            if b.now is None:
                b.leaf("comment", m.start(), m.end())
            continue
        if b.now is not None and b.now.kind == "decorator" and b.depth <= 0 and b.words and DECLARED_ON_LINE.match(b.source, last):
            b.finish(last)
        if b.now is None:
            if t == "end":
                b.close(m.end())
                last = m.end()
                continue
            quoted = t[-1] == '"' and len(t) > 1
            b.begin("decorator" if t[0] == "@" else "string" if quoted else "statement", m.start())
        elif b.now.kind == "string" and t != ";":
            b.now.kind = "statement"
        last = m.end()
        if b.depth <= 0 and t in JULIA_BLOCKS:
            opens += 1
        elif b.depth <= 0 and t == "end" and opens:
            opens -= 1
            if not opens:
                b.now.kind, b.now.head_end = b.kind_of_body(), m.start()
                b.finish(m.end())
                continue
        else:
            b.depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
        b.words.append(t)
    b.finish(last)


def syntax_tree(source: str, language: str) -> Node:
    """The tree of a text in julia, cpp, python or javascript."""
    b, token = _Builder(source, language), languages()[language].token
    if language == "python":
        _by_indents(b, _python_token(token.pattern, token.flags))
    elif language == "julia":
        _by_ends(b, token)
    else:
        _by_braces(b, token)
    return b.done()


_TOKENS: dict[str, re.Pattern] = {}


def _python_token(pattern: str, flags: int) -> re.Pattern:
    if pattern not in _TOKENS:
        _TOKENS[pattern] = re.compile(PYTHON_TEXTS + pattern, flags)
    return _TOKENS[pattern]
