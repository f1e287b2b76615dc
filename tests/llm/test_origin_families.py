import random

from treeloom.llm import origins
from tests.llm.test_origins import WORDS, written_file

NAMES = [(".js", "javascript"), (".py", "python"), (".cpp", "cpp"), (".jl", "julia")]


def judged(spark, files):
    code = spark.createDataFrame([(f, 1, t) for f, t in files.items()], "file string, line_start int, source string")
    names = spark.createDataFrame(NAMES, "extension string, language string")
    return {r.file: r for r in origins.file_origins(code, names).collect()}


def test_pieces():
    tokens, cuts = origins.cut_by_lines([t for t in origins.HASH_COMMENTS.findall("import a\nclass X:\n    def f(s):\n        return 1\n\n    def g(s): return [\n2]\nif x:\n  y()\nelse:\n  z()\n") if t[0] != "#"])
    assert [tokens[a] for a in cuts] == ["import", "class", "def", "def", "if"]
    tokens = [t for t in origins.SLASH_COMMENTS.findall("namespace a { struct B { int f(int x) { return x; } int g; }; } auto h = [](int y) { return y; }; ")]
    cuts = origins.cut_by_braces(tokens)
    assert [" ".join(tokens[a:b]) for a, b in zip(cuts, [*cuts[1:], len(tokens)])] == ["namespace a {", "struct B {", "int f ( int x ) { return x ; }", "int g ;", "}", ";", "}", "auto h = [ ] ( int y ) { return y ; }", ";"]
    assert origins.cut_by_braces([]) == [] and origins.cut_by_lines([]) == ([], [])


def test_families_within_a_file(spark):
    """Eight linked pieces make a family, seven don't; members of a class count; a table in a written file decides nothing."""
    rng = random.Random(5)
    member = "  get{i}(src, cfg) {{ if (cfg.{f} > {i}) {{ return src.slot[{i}]; }} return null; }}\n"
    files = {f"alpha/{n}.js": "class Made {\n" + "".join(member.format(i=i, f=rng.choice(WORDS)) for i in range(n)) + "}\n" for n in (7, 8, 30)}
    files["alpha/table.py"] = "import os\n\nSTEPS = [" + ", ".join(str(rng.randrange(99)) for _ in range(120)) + "]\n\n\ndef walk(src, cfg):\n    for row in src:\n        if row.size > cfg.limit:\n            yield row.name, STEPS[row.size]\n    return None\n"
    files["alpha/blob.cpp"] = 'const char* blob = "' + "".join(rng.choice("abcdefgh0123456789+/") for _ in range(4000)) + '";\n'
    files["beta/list.jl"] = "names = [\n" + "".join(f'    ("{rng.choice(WORDS)}", {rng.randrange(99)}, 0x{rng.randrange(9999):04x}),\n' for _ in range(60)) + "]\n"
    files["beta/three.jl"] = "sizes = [1, 2, 3]\n"
    got = judged(spark, files)
    assert {f: r.origin for f, r in got.items()} == {
        "alpha/7.js": "own", "alpha/8.js": "generated", "alpha/30.js": "generated", "alpha/table.py": "own", "alpha/blob.cpp": "data", "beta/list.jl": "data", "beta/three.jl": "own"}
    assert got["alpha/8.js"].class_id == got["alpha/30.js"].class_id and got["alpha/30.js"].family_share > 0.9 and got["beta/list.jl"].family_share > 0.9


def test_copies_of_made_files_are_linked(spark):
    rng = random.Random(9)
    made = "".join(f"function get{i}(s) {{\n  return s.{rng.choice(WORDS)}[{rng.randrange(999)}];\n}}\n" for i in range(40))
    got = judged(spark, {"alpha/gen.js": made, "beta/vendor/gen.js": "// notice\n" + made})
    assert [(r.origin, r.n_links) for r in got.values()] == [("generated", 0)] * 2  # equal sets are one
    patched = judged(spark, {"alpha/gen.js": made, "beta/vendor/gen.js": made.replace("[", "[ 7 + ", 1)})
    assert [(r.origin, r.n_links) for r in patched.values()] == [("generated", 1)] * 2


def test_long_files_of_one_style_are_no_family(spark):
    rng = random.Random(3)
    assert {r.origin for r in judged(spark, {f"alpha/long{i}.js": written_file(rng, "alpha", 16 + 3 * i) for i in range(4)}).values()} == {"own"}


def test_recall_of_patched_copies(spark):
    """Every link at 0.8 or more between texts and copies with lines left out, renamed and added, against brute force."""
    import numpy as np

    rng = random.Random(12)
    files = {}
    for k in range(12):
        lines = written_file(rng, f"lib{k}", rng.randrange(4, 20)).split("\n")
        for r in range(5):
            copy = [line.replace("const", "let") if rng.random() < 0.02 * r else line for line in lines if rng.random() > 0.015 * r]
            files[f"repo{r}/vendor/lib{k}.js"] = "\n".join(copy + ["log('patched', src);"] * (r == 4))
    feature = "file string, language string, text string"
    rows = [r.asDict(recursive=True) for r in spark.createDataFrame([(f, "javascript", t) for f, t in files.items()], feature).mapInPandas(origins._features(), origins.FEATURES).select("file", "sets").collect()]
    sets = {s["id"]: (set(s["shingles"]), s["shingles"], s["bands"]) for r in rows for s in r["sets"] if s["masked"]}
    ids = sorted(sets)
    expected = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if len(sets[a][0] & sets[b][0]) >= origins.SIMILAR * len(sets[a][0] | sets[b][0])}
    df = spark.createDataFrame([(i, *sets[i][1:]) for i in ids], "id long, shingles array<int>, bands array<long>")
    found = {(r.a, r.b) for r in origins.near_duplicates(df).collect()}
    assert found <= expected and len(expected) >= 60 and len(found) >= 0.98 * len(expected)
    assert np.all([len(v[2]) == origins.BANDS for v in sets.values()])
