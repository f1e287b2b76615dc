import json

from pyspark.sql import functions as F

from treeloom.streaming import logs


def write(folder, session, events):
    (folder / session).mkdir(parents=True, exist_ok=True)
    path = folder / session / f"log{len(list((folder / session).iterdir()))}.jsonl"
    path.write_text("".join(json.dumps(e) + "\n" for e in events))


def test_running_totals(spark, tmp_path):
    write(tmp_path / "in", "s1", [{"type": "session_start", "id": 1}, {"type": "token_usage", "input_tokens": 5, "output_tokens": 2}])
    write(tmp_path / "in", "s2", [{"type": "session_start", "id": 2}])

    seen = {}

    def run():
        totals = logs.session_totals(logs.read_log(spark, str(tmp_path / "in")))
        q = totals.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.update({r.session: (r.n_events, r.input_tokens, r.output_tokens) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return seen

    assert run() == {"s1": (2, 5, 2), "s2": (1, 0, 0)}
    write(tmp_path / "in", "s1", [{"type": "token_usage", "input_tokens": 10, "output_tokens": 1}])
    assert run()["s1"] == (3, 15, 3)


def test_changed_only(spark, tmp_path):
    held = {"t": spark.createDataFrame([("a", "1", "old"), ("b", "2", "old")], "path string, hash string, body string")}
    seen = []

    def index(rows):
        seen.extend(r.path for r in rows.collect())
        return rows

    run = logs.changed_only(lambda: held["t"], lambda t: held.update(t=spark.createDataFrame(t.collect(), t.schema)), index)
    run(spark.createDataFrame([("a", "1", "new"), ("b", "3", "new"), ("c", "4", "new")], "path string, hash string, body string"), 0)
    assert sorted(seen) == ["b", "c"]
    assert {tuple(r) for r in held["t"].collect()} == {("a", "1", "old"), ("b", "3", "new"), ("c", "4", "new")}


def fold(spark, events):
    fields = ["type", "content", "tool_call_id", "output", "summary", "initial_message_count", "final_message_count"]
    rows = [("s", i, *[e.get(f) for f in fields]) for i, e in enumerate(events)]
    df = spark.createDataFrame(rows, "sid string, no int, type string, content string, tool_call_id string, output string, summary string, initial_message_count int, final_message_count int")
    return [(r.role, r.content, r.tool_call_id) for r in logs.histories(df.orderBy(F.rand(3)), "sid", "no").orderBy("message_no").collect()]


def test_history(spark):
    u, a = (lambda t: {"type": "user_message", "content": t}), (lambda t: {"type": "llm_response", "content": t})
    call, result = (lambda c: {"type": "tool_call", "tool_call_id": c}), (lambda c: {"type": "tool_result", "tool_call_id": c, "output": f"r{c}"})
    assert fold(spark, [{"type": "system_prompt", "content": "s"}, u("1"), a("2"), call("x"), result("x"), a("3")]) == [("user", "1", None), ("assistant", "2", None), ("tool", "rx", "x"), ("assistant", "3", None)]
    assert fold(spark, [u("1"), result("x"), a("2"), call("x"), result("orphan")]) == [("user", "1", None), ("assistant", "2", None), ("tool", "rx", "x")]
    assert fold(spark, [u("1"), call("x"), result("x")]) == [("user", "1", None), ("assistant", "", None), ("tool", "rx", "x")]
    five = [u(str(i)) for i in range(5)]
    assert fold(spark, [{"type": "system_prompt", "content": "s"}, *five, {"type": "compaction", "summary": "S", "initial_message_count": 2, "final_message_count": 1}, u("9")]) == [("user", "0", None), ("user", "S", None), ("user", "4", None), ("user", "9", None)]
    assert fold(spark, []) == []


def test_log_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("user_message", "x\ny")], "type string, content string")
    logs.append_log(df, str(tmp_path / "l"), "7")
    logs.append_log(df, str(tmp_path / "l"), "7")
    got = spark.read.json(str(tmp_path / "l" / "7")).collect()
    assert [(r.type, r.content) for r in got] == [("user_message", "x\ny")] * 2
