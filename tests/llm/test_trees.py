import pytest

from treeloom.llm.trees import syntax_tree, visited

PY = "import a\n\n# above\n@deco(\n  1)\nclass X(Y):\n    '''doc'''\n    def f(self, a: int = {1: 2}[1]):\n        if a: return 1\n        return [\n  2]\n\n    async def g(self): pass\n\nx = 1\n"
JL = '"""\ndoc\n"""\n@inline function f(a)\n  if a[end] > 1\n    g(x for x in a)\n  end\nend\nh(x) = x + 1\nmodule M\n  struct S; a; end\nend\n'
JS = "// above\nexport default class A extends B {\n  /** doc */\n  get x() { return `}`; }\n  async *[k](a = {b: 1}) { for (const y of a) { z(y) } }\n}\nconst f = (a) => { return a }\nfunction g() {\n  return {a: 1}\n}\n"
CPP = "#include <a>\nnamespace n {\n// above\ntemplate <class T>\nint f(T a) const { if (a) { return 1; } return 2; }\nstruct S { int x; };\n}\n"


def shown(source, language, kinds):
    return [(x.kind, source[x.start:x.end].split("\n")[0], x.first_line, x.last_line) for x in visited(syntax_tree(source, language)) if x.kind in kinds]


@pytest.mark.parametrize("source, language, expected", [
    (PY, "python", [("class", "class X(Y):", 5, 12), ("function", "def f(self, a: int = {1: 2}[1]):", 7, 10), ("function", "async def g(self): pass", 12, 12)]),
    (JL, "julia", [("function", "function f(a)", 3, 7), ("function", "h(x) = x + 1", 8, 8), ("class", "module M", 9, 11), ("class", "struct S; a; end", 10, 10)]),
    (JS, "javascript", [("class", "export default class A extends B {", 1, 5), ("function", "get x() { return `}`; }", 3, 3), ("function", "async *[k](a = {b: 1}) { for (const y of a) { z(y) } }", 4, 4), ("function", "const f = (a) => { return a }", 6, 6), ("function", "function g() {", 7, 9)]),
    (CPP, "cpp", [("class", "namespace n {", 1, 6), ("function", "template <class T>", 3, 4), ("class", "struct S { int x; }", 5, 5)])])
def test_functions_and_classes(source, language, expected):
    assert shown(source, language, ("function", "class")) == expected


def test_comments_strings_and_damage():
    assert [x[0] for x in shown(PY, "python", ("comment", "decorator", "string"))] == ["comment", "decorator", "string"]
    assert [x[:2] for x in shown(JL, "julia", ("string", "decorator"))] == [("string", '"""'), ("decorator", "@inline")]
    cut = "def f(a):\n    x = 1\n<<<<<<< ours\n    y = (2\n"
    assert shown(cut, "python", ("function",)) == [("function", "def f(a):", 0, 3)]
    assert shown("int f() { if (a) {", "cpp", ("function",)) == [("function", "int f() { if (a) {", 0, 0)]
    assert shown("} end ) ]", "javascript", ("function",)) == [] and shown("", "julia", ("function",)) == []
    deep = "{" * 20_000 + "}" * 20_000
    assert len(list(visited(syntax_tree(deep, "cpp")))) > 10_000


def test_ranges_hold_each_other():
    for source, language in ((PY, "python"), (JL, "julia"), (JS, "javascript"), (CPP, "cpp")):
        for node in visited(syntax_tree(source, language)):
            assert all(node.start <= x.start <= x.end <= node.end for x in node.children)
            assert all(a.end <= b.start for a, b in zip(node.children, node.children[1:]))
