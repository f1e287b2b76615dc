import random

from treeloom.llm.origins import SIMILAR, file_origins, near_duplicates

WORDS = [a + b for a in ("Load", "Fold", "Sort", "Keep", "Move") for b in ("Row", "Cache", "Tree", "Batch", "Line")]


def written_file(rng, prefix, n=14):
    out = []
    for _ in range(n):
        out.append(f"function {prefix}{rng.choice(WORDS)}(src, cfg) {{")
        for _ in range(rng.randrange(3, 7)):
            out.append(rng.choice(["    const {a} = {b}(src, {n});", "    if (src.size > {n}) {{ {b}(cfg); }}", "    log('{a} skipped {n}', src);", "    for (const x of src) {{ {b}(x, {n}); }}"]).format(a=rng.choice(WORDS).lower(), b=rng.choice(WORDS), n=rng.randrange(900)))
        out.append("    return src;\n}\n")
    return "\n".join(out)


def test_kinds(spark):
    rng = random.Random(2)
    lib = written_file(rng, "libx")
    patched = lib.replace("const", "let", 2)
    files = {
        "alpha/src/own.js": written_file(rng, "alpha"), "beta/src/own.js": written_file(rng, "beta"), "alpha/vendor/x.js": lib, "beta/deps/x.js": "// a notice\n" + lib, "gamma/x.js": patched,
        "alpha/gen.js": "\n".join(f"function f{i}(s) {{\n  return s.slot[{i}];\n}}" for i in range(30)), "alpha/min.js": ";".join(f"var a{i}=b(c,{i}),d=e?f:g" for i in range(80)), "beta/table.py": "table = [\n" + ", ".join(str(rng.randrange(9999)) for _ in range(400)) + "]\n",
        "beta/doc.py": '"""' + "plain words about this module and what it is for " * 20 + '"""\n', "beta/empty.py": "", "beta/data.py": "x = '''\n" + "\n".join("%032x" % rng.getrandbits(128) for _ in range(40)) + "'''\n", "beta/conf.json": "{}", "delta/x.js": "const a = 1;"}
    rows = [(f, 1, t) for f, t in files.items()] + [("alpha/src/own.js", 1, files["alpha/src/own.js"]), (None, 1, "x"), ("n.py", 1, None)]
    code = spark.createDataFrame(rows, "file string, line_start int, source string").selectExpr("*", "1 as id", "2 as shingles", "3 as bands")
    names = spark.createDataFrame([(".js", "javascript"), (".py", "python"), (".json", "json")], "extension string, language string")
    got = {r.file: r for r in file_origins(code, names).collect()}
    kinds = {f: r.origin for f, r in got.items()}
    assert kinds == {
        "alpha/src/own.js": "own", "beta/src/own.js": "own", "alpha/vendor/x.js": "vendored", "beta/deps/x.js": "vendored", "gamma/x.js": "vendored", "alpha/gen.js": "generated", "alpha/min.js": "minified", "beta/table.py": "data", "beta/doc.py": "own", "beta/empty.py": "own", "beta/data.py": "data", "delta/x.js": "own"}
    assert got["alpha/vendor/x.js"].class_id == got["gamma/x.js"].class_id == got["beta/deps/x.js"].class_id and got["gamma/x.js"].n_links == 1
    assert file_origins(code.limit(0), names).count() == 0


def test_pairs_against_brute_force(spark):
    from treeloom.llm import origins as o
    import numpy as np

    rng = random.Random(8)
    base = [set(rng.sample(range(10**6), 60)) for _ in range(12)]
    sets = []
    for b in base:
        for drop in (0, 2, 5, 9, 20):
            sets.append((set(rng.sample(sorted(b), 60 - drop)) | set(rng.sample(range(10**6), drop // 2))))
    rows = [(i, sorted(s), o.band_keys(np.array(sorted(s), np.uint64))) for i, s in enumerate(sets)]
    got = {(r.a, r.b) for r in near_duplicates(spark.createDataFrame(rows, "id long, shingles array<long>, bands array<long>")).collect()}
    expected = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= SIMILAR * len(sets[i] | sets[j])}
    assert got <= expected and len(got) >= 0.98 * len(expected)


def test_families_of_several_files(spark):
    rng = random.Random(4)
    short = "class {n} {{\n  constructor(src) {{ this.src = src; this.{f} = {k}; }}\n  read(cfg) {{ if (cfg.{f} > {k}) {{ return this.src.load('{n}'); }} return null; }}\n  static of(x) {{ for (const y of x) {{ new {n}(y).read({k}); }} }}\n}}\n"
    words = "word = {{\n" + "".join(f"    '{{a}} says line {i}': 'the plain text of {{a}} and {i}',\n" for i in range(6)) + "}}\n"
    files = {f"alpha/models/m{i}.js": short.format(n=rng.choice(WORDS), f=rng.choice(WORDS), k=i) for i in range(4)}
    files |= {f"beta/m{i}.js": written_file(rng, "beta") for i in range(2)} | {f"beta/two{i}.js": short.format(n="Pair", f=f"own{i}", k=i).replace("null", "[src, 1, {}]").replace("static of", "get of") for i in range(2)}
    code = spark.createDataFrame([(f, 1, t) for f, t in files.items()], "file string, line_start int, source string")
    names = spark.createDataFrame([(".js", "javascript"), (".py", "python")], "extension string, language string")
    got = {r.file: r.origin for r in file_origins(code, names, with_classes=False).collect()}
    assert got == {f: "generated" if f.startswith("alpha") else "own" for f in files}


def test_originals_and_short_copies(spark):
    rng = random.Random(6)
    lib, mine = written_file(rng, "libx") + "\ndataFrame(dataRow, dataSize);\n", written_file(rng, "gamma")
    short = "export function pick(src, key) { return src.find((x) => x.key === key) || null; }\n"
    files = {"data-tools/deps/x.js": lib, "beta/deps/x.js": lib, "gamma/src/own.js": mine, "beta/deps/g.js": mine, "gamma/pick.js": short, "beta/pick.js": "// a notice\n" + short, "delta/pick.js": short.replace("key", "name"), "beta/a.js": "const a = 1;", "gamma/a.js": "const a = 1;"}
    code = spark.createDataFrame([(f, 1, t) for f, t in files.items()], "file string, line_start int, source string")
    names = spark.createDataFrame([(".js", "javascript")], "extension string, language string")
    got = {r.file: r.origin for r in file_origins(code, names, with_classes=False).collect()}
    own = {"gamma/src/own.js", "delta/pick.js", "beta/a.js", "gamma/a.js"}
    assert got == {f: "own" if f in own else "vendored" for f in files}
