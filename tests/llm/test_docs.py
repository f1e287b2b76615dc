import pytest

from treeloom.llm.docs import documentation, documented_functions

PY = "def f(a):\n    return a\n"


@pytest.mark.parametrize("source, before, language, name, expected", [
    ("# Adds one number to the next.\n" + PY, None, "python", "f", True), ("# Adds one number to the next.\n@deco(1,\n  2)\n" + PY, None, "python", "f", True), ("# Adds one number to the next.\n\n" + PY, None, "python", "f", False),
    ('def f(a):\n    """Adds one number to the next."""\n    return a\n', None, "python", "f", True), ("def f(a):\n    # Adds one number to the next.\n    return a\n", None, "python", "f", False), ("# TODO: document\n" + PY, None, "python", "f", False),
    ("# noqa: E501\n" + PY, None, "python", "f", False), ("# -------\n" + PY, None, "python", "f", False), ("# old = g(a, 1)\n# return g(old)\n" + PY, None, "python", "f", False), ("# Copyright the authors, all rights reserved.\n" + PY, None, "python", "f", False),
    ("def load_all_rows(a):\n    '''Load all rows.'''\n", None, "python", "load_all_rows", False), ("def f(a):\n    ':param a:'\n", None, "python", "f", False), (PY, "# Section\n\n# Adds one number to the next.", "python", "f", True), (PY, "# Adds one number to the next.\n", "python", "f", False),
    ('def f(a):\n    """Adds one number to the next', None, "python", "f", True), ('"""\n    f(a)\n\nAdds one number to the next.\n"""\nfunction f(a)\n    a +\n', None, "julia", "f", True), ('"""\n    f(a)\n"""\nfunction f(a)\nend\n', None, "julia", "f", False),
    ("/**\n * ----\n * Adds one number to the next.\n * @param a\n */\nexport function f(a) { return a; }", None, "javascript", "f", True), ("/** @param a */\nfunction f(a) {}", None, "javascript", "f", False), ("/// Adds one number to the next.\r\ntemplate <class T>\r\nint f(T a) {\r\n", None, "cpp", "f", True),
    ("// NOLINTNEXTLINE\nint f(int a) { return a; }", None, "cpp", "f", False), ("int f(int a) { // Adds one number to the next.\n return a; }", None, "cpp", "f", False), ("", None, "python", "f", False), ("# only a comment that says much\n", None, "python", "f", False)])
def test_documentation(source, before, language, name, expected):
    assert bool(documentation(source, before, language, name)) is expected


def test_rows(spark):
    rows = [
        ("p:f", "p", "function", "f", "a.py", 5, 6, 0, "# Adds one number to the next.\n" + PY), ("p:g", "p", "function", "g", "a.py", 9, 10, 1, None), ("p:g:c", "p:g", "chunk", "chunk", "a.py", 9, 9, 0, "# Takes numbers one by one.\ndef g(a):"), ("p:g:d", "p:g", "chunk", "chunk", "a.py", 10, 10, 1, "    return a"),
        ("p:k", "p", "comment", "comment", "a.py", 19, 20, 2, "# Takes numbers one by one."), ("p:h", "p", "method", "h", "a.py", 21, 22, 3, PY), ("p:i", "p", "function", None, "a.py", None, None, None, PY), (None, "p", "function", "f", "a.py", 5, 6, 0, PY), ("q:f", "q", "function", "f", "b.md", 5, 6, 0, "# Adds one number to the next.\n" + PY), ("r", None, "function", "f", None, 1, 1, 0, PY)]
    df = spark.createDataFrame(rows + rows[:3], "id string, parent string, kind string, name string, file string, line_start int, line_end int, sibling_order int, source string").selectExpr("*", "1 as before", "2 as ext", "3 as language")
    names = spark.createDataFrame([(".py", "python"), (".md", "markdown")], "extension string, language string")
    got = documented_functions(df, names).collect()
    assert sorted(r.id for r in got) == ["p:f", "p:g", "p:h"]
    assert {r.id: r.code for r in got}["p:f"] == PY and {r.id: r.signature for r in got}["p:f"] == "def f(a)"
    assert documented_functions(df.limit(0), names).count() == 0
