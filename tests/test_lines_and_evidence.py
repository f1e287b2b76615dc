import random

import pytest
from pyspark.sql import functions as F

from treeloom.functions import scalars
from treeloom.operators import evidence, lines, sessions, summaries, tables, tasks
from treeloom.streaming import logs


def feature_rows(spark, text):
    return lines.line_features(lines.numbered_lines(spark.createDataFrame([("f", text)], "file string, text string"), "file", "text"))


def test_block_ends_by_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for f in range(12):
        body = [rng.choice(["", " " * rng.randrange(0, 9) + rng.choice(["a:", "b", "}", ")"])]) for _ in range(40)]
        rows.append((f"f{f}", "\n".join(body)))
    df = lines.line_features(lines.numbered_lines(spark.createDataFrame(rows, "file string, text string"), "file", "text")).cache()
    by_file = {}
    for r in df.collect():
        by_file.setdefault(r.file, []).append(r)
    expected = set()
    for f, rs in by_file.items():
        rs.sort(key=lambda r: r.line_no)
        text = [r for r in rs if not r.blank]
        for k, r in enumerate(text[:-1]):
            if text[k + 1].indent > r.indent and not r.closes:
                stop = next((x for x in text[k + 1:] if x.indent <= r.indent), None)
                end = rs[-1].line_no if stop is None else stop.line_no if stop.closes and stop.indent == r.indent else stop.line_no - 1
                expected.add((f, r.line_no, end))
    assert {tuple(r) for r in lines.block_ends(df, "file").collect()} == expected


def test_indent_tabs_and_line_ends(spark):
    got = feature_rows(spark, "k:\r\n\tx\n  \ty\n\n").orderBy("line_no").collect()
    assert [(r.line, r.indent, r.blank) for r in got] == [("k:", 0, False), ("\tx", 4, False), ("  \ty", 4, False), ("", None, True)]


def test_paragraphs_like_a_config_file(spark):
    text = "\n".join(["a", "b", "c", "", "d", "e", "f", "g", "", "h", "i", "j", "", "", "k", "l"])
    got = lines.paragraphs(feature_rows(spark, text), "file").orderBy("paragraph").collect()
    assert [(r.line_start, r.line_end) for r in got] == [(1, 4), (5, 9), (10, 14), (15, 16)]


def test_markdown(spark):
    text = "# Head `x`\n\ntext\n- one\n- two\n```\n# no head\n```\n| a |\n---\n## Next"
    rows = feature_rows(spark, text)
    blocks = lines.markdown_blocks(rows, "file").orderBy("line_no").collect()
    assert [r.block for r in blocks] == ["heading", "blank", "paragraph", "list", "list", "fence", "fence", "fence", "table", "rule", "heading"]
    assert [(r.title, r.line_start, r.line_end) for r in lines.sections(rows, lines.markdown_blocks(rows, "file"), "file").orderBy("section_no").collect()] == [("Head x", 1, 10), ("Next", 11, 11)]


def test_batches_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(4)}", f"{i:03}", rng.choice([1, 5, 20, 120])) for i in range(200)]
    got = {(r.file, r.id): r.batch_no for r in evidence.batches(spark.createDataFrame(rows, "file string, id string, size int"), "file", ["id"], "size", 50, 4).collect()}
    expected = {}
    for key in {r[0] for r in rows}:
        no = used = n = 0
        for k, (_, i, size) in enumerate(sorted(r for r in rows if r[0] == key)):
            if k and (used + size > 50 or n >= 4):
                no, used, n = no + 1, 0, 0
            used, n = used + size, n + 1
            expected[key, i] = no
    assert got == expected


@pytest.mark.parametrize("source, expected", [
    ("# one\n# two\n#\n# three\n# four", "one two three"), ("// f(x)\n// does it", "does it"), ("/* */", None), ('"""\nfoo\n"""', "foo"), ("/// a\r\n/// b", "a b"), ("", None)])
def test_comment_summary(spark, source, expected):
    assert spark.createDataFrame([(source,)], "s string").select(summaries.comment_summary(F.col("s"))).first()[0] == expected


def test_scalars(spark):
    df = spark.createDataFrame([("2025-01-01T00:00:00Z", "2025-01-01T00:03:20Z", "  a\n\n    b", "x")], "a string, b string, t string, p string")
    r = df.select(scalars.duration(F.col("a"), F.col("b")).alias("d"), scalars.duration(F.col("b"), F.col("a")).alias("e"), scalars.dedented(F.col("t")).alias("t"), scalars.padded(F.col("p"), 4).alias("p"), scalars.padded(F.col("a"), 4).alias("q")).first()
    assert (r.d, r.e, r.t, r.p, r.q) == ("3m 20s", "", "a\n\n  b", "x   ", "2025-01-01T00:00:00Z ")


def test_ignore_rules(spark):
    paths = ["r/build/a.o", "r/src/x.o", "r/src/keep.o", "r/.env", "r/a/b/.env", "r/dist/x", "r/sub/dist/x", "r/#x", "r/doc/a.txt"]
    rules = ["# c", "", "*.o", "!keep.o", "**/.env", "build/", "/dist/", "\\#x", "doc/*.txt"]
    got = {r.path: r.ignored for r in scalars.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), "path", rules).collect()}
    assert got == {"r/build/a.o": True, "r/src/x.o": True, "r/src/keep.o": False, "r/.env": True, "r/a/b/.env": True, "r/dist/x": True, "r/sub/dist/x": False, "r/#x": True, "r/doc/a.txt": True}


def test_budget_blocks(spark):
    def blocks(sizes, initial, final):
        df = spark.createDataFrame([("s", i, t) for i, t in enumerate(sizes)], "session string, seq int, tokens int")
        got = [r.block for r in sessions.budget_blocks(df, "session", "seq", "tokens", initial, final).orderBy("seq").collect()]
        return tuple(got.count(b) for b in ("initial", "middle", "final"))

    assert blocks([5000] * 6, 18_000, 10_000) == (3, 1, 2)
    assert blocks([5000] * 6, 10_000, 12_000) == (2, 2, 2)
    assert blocks([1000] * 6, 2_500, 1_500) == (2, 3, 1)
    assert blocks([100_000] * 2, 200_000, 200_000) == (2, 0, 0)


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "k string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", None), ("d", "4")], "k string, h string")
    assert {tuple(r) for r in tables.compared(old, new, "k", "h").collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "unchanged"), ("d", "new")}
    assert {tuple(r) for r in tables.replaced(old, new.where("k = 'b'"), "k").collect()} == {("a", "1"), ("b", "3"), ("c", None)}
    folder = str(tmp_path / "t")
    assert tables.load_version(spark, folder, "5") is None
    tables.save_version(old, folder, 1, "5")
    tables.save_version(new, folder, 2, "5")
    assert tables.load_version(spark, folder, "5").count() == 4 and tables.load_version(spark, folder, "6") is None


def test_tasks(spark):
    df = spark.createDataFrame([(1, 1, None, "a", "pending"), (1, 2, 1, "b", "done"), (1, 2, 1, "b2", "done"), (1, 3, 9, " ", "in_progress"), (1, 4, 3, "d", "in_progress"), (1, 5, 1, "e", "odd"), (1, 6, 1, "f", "pending")], "list_id int, id int, parent int, description string, status string")
    assert {(r.problem, r.id) for r in tasks.problems(df).collect()} == {("duplicate_id", 2), ("missing_parent", 3), ("unknown_status", 5), ("no_description", 3), ("several_active", 3), ("several_active", 4), ("active_with_children", 3)}
    assert tasks.next_pending(df, "id").first().id == 6


def test_events(spark):
    text = '{"type": "tool_result", "tool_call_id": "c2", "output": "x"} rest\nnoise\n{"type": "tool_call", "tool": "t", "tool_call_id": "c1", "input": "i"}\n{"type": "tool_result", "tool_call_id": "c1", "output": "o", "origin": "user"}\n{"type": "llm_response"}'
    events = sessions.json_events(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), "doc_id", "text")
    rows = events.withColumn("ok", sessions.valid_event()).orderBy("line_no").collect()
    assert [(r.type, r.origin, r.ok) for r in rows] == [("tool_result", "model", True), ("tool_call", "model", True), ("tool_result", "user", True)]
    pairs, orphans = sessions.call_pairs(events, "doc_id")
    assert [(r.tool_call_id, r.call_no, r.result_no) for r in pairs.collect()] == [("c1", 3, 4)] and [r.tool_call_id for r in orphans.collect()] == ["c2"]
    assert '"type":"tool_call"' in sessions.event_line(events.where("type = 'tool_call'")).first().line


def test_events_of_any_form(spark):
    lines = [
        '{"type":"token_usage","timestamp":"t","input_tokens":5,"output_tokens":2}', '{"type": "user_message", "content": "u", "source": null}', '{"type":"compaction","timestamp":"t","summary":"S","initial_message_count":0,"compacted_message_count":1,"final_message_count":0,"total_tokens_before":9}',
        '{"type": "tool_call", "tool": "t", "tool_call_id": "c", "input": "{\\"a\\": {\\"b\\": \\"}\\"}}", "origin": "model"} rest "}', 'note {x} 7: { "timestamp" : "t", "type" : "sigint" }', '{"type": "tool_result", "output": {"k": "v"}, "tool_call_id": "c"}',
        '{"type": "tool_call", "input": "cut', '{"type": "tool_call", "input": {"type": "inner", "a": "b"}', '{"other": {"type": "inner", "a": "b"}}', '{"type": "x y", "a": "b"}', '[{"type": 4}]']
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    events = sessions.json_events(df, "doc_id", "text")
    rows = events.orderBy("line_no").collect()
    assert [(r.line_no, r.type) for r in rows] == [(1, "token_usage"), (2, "user_message"), (3, "compaction"), (4, "tool_call"), (5, "sigint"), (6, "tool_result")]
    assert (rows[0].input_tokens, rows[0].output_tokens, rows[2].summary, rows[3].input, rows[5].output) == (5, 2, "S", '{"a": {"b": "}"}}', '{"k":"v"}')
    again = sessions.json_events(sessions.event_line(events.drop("doc_id", "line_no")).select(F.lit(1).alias("doc_id"), F.col("line").alias("text")), "doc_id", "text")
    assert sorted(r.type for r in again.collect()) == sorted(r.type for r in rows)
    assert [(r.role, r.content) for r in logs.histories(events, "doc_id", "line_no").orderBy("message_no").collect()] == [("user", "S"), ("assistant", ""), ("tool", '{"k":"v"}')]


def test_cells_of_whole_texts(spark, tmp_path):
    from treeloom.queries.reference import f14_whole_cells

    source, signature = "a|b\r\n\t" * 100, "f(é)" * 30
    spark.createDataFrame([("1", source, signature), ("1", source, signature), ("2", None, None), (None, "x", "y")], "id string, source string, signature string").write.parquet(str(tmp_path / "code.parquet"))
    got = {r.id: (r.cell, r.packed) for r in f14_whole_cells(spark, str(tmp_path)).collect()}
    assert got == {"1": ("a\\|b \\n " * 100, signature.encode().hex().upper()), "2": ("missing", None)}
