"""Session logs and listings as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from treeloom.operators.sessions import EVENT
from treeloom.operators.tables import compared, replaced, without

HISTORY = "session string, message_no int, role string, content string, tool_call_id string"
TOTALS = "session string, n_events long, input_tokens long, output_tokens long, last_type string"


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The events of all JSON-lines files below a folder as they are appended, with ``session`` from the folder of each file."""
    rows = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").json(folder)
    return rows.withColumn("session", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1)).withColumn("origin", F.coalesce("origin", F.lit("model")))


def append_log(events: DataFrame, folder: str, session: str) -> None:
    """Appends events to a session's log, one JSON object a line."""
    events.write.mode("append").json(f"{folder}/{session}")


def _add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, taken, given, last = state.get if state.exists else (0, 0, 0, "")
    for batch in batches:
        usage = batch[batch["type"] == "token_usage"]
        n, taken, given = n + len(batch), taken + int(usage["input_tokens"].fillna(0).sum()), given + int(usage["output_tokens"].fillna(0).sum())
        last = batch["type"].iloc[-1] if len(batch) else last
    state.update((n, taken, given, last))
    yield pd.DataFrame([(key[0], n, taken, given, last)], columns=["session", "n_events", "input_tokens", "output_tokens", "last_type"])


def session_totals(events: DataFrame) -> DataFrame:
    """Running totals of each session with an event in a batch; the state of a session is four values."""
    rows = events.select("session", "type", "input_tokens", "output_tokens")
    return rows.groupBy("session").applyInPandasWithState(_add, TOTALS, "n long, taken long, given long, last string", "update", GroupStateTimeout.NoTimeout)


def changed_only(current: Callable[[], DataFrame], store: Callable[[DataFrame], None], index: Callable[[DataFrame], DataFrame], order: str | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` on a stream of ``path, hash`` and whatever ``index`` needs: rows whose hash is new or changed against the current table are indexed and replace those of their path.

    Of several rows for a path the one with the greatest ``order`` holds (without it, and among equals, the greatest row). Where that one's column ``deleted`` is true, the path's rows go.
    """

    def run(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in ("path", order)]
        newest = batch.groupBy("path").agg(F.max(F.struct(*([order] if order else []), *rest)).alias("_r")).select("path", "_r.*")
        gone = newest.where("deleted") if "deleted" in batch.columns else None
        if gone is not None:
            newest = newest.where("not coalesce(deleted, false)")
        states = compared(current().select("path", "hash"), newest.select("path", "hash"), "path", "hash").where("state in ('new', 'changed')")
        fresh = index(newest.join(states.select("path"), "path", "left_semi"))
        kept = current() if gone is None else without(current(), gone, "path")
        store(replaced(kept, fresh, "path"))

    return run


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Events in order, one session after the other; only the history of the present session is held."""
    session, system, done, open_, late = None, False, [], None, {}

    def flush() -> None:
        nonlocal open_
        if open_ is not None:
            content, calls = open_
            done.append(("assistant", content, None))
            done.extend(("tool", late.pop(c), c) for c in calls if c in late)
            open_ = None

    def ended() -> Iterator[tuple]:
        flush()
        yield from ((session, k + 1, role, content, call) for k, (role, content, call) in enumerate(done))

    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.session != session:
                if session is not None:
                    out.extend(ended())
                session, system, done, open_, late = row.session, False, [], None, {}
            if row.type == "system_prompt":
                system = True
            elif row.type == "user_message":
                flush()
                done.append(("user", row.content, None))
            elif row.type == "llm_response":
                flush()
                open_ = (row.content, [])
            elif row.type == "tool_call":
                open_ = open_ or ("", [])
                open_[1].append(row.tool_call_id)
            elif row.type == "tool_result":
                late[row.tool_call_id] = row.output
            elif row.type == "compaction":
                flush()
                first, last = max(0, int(row.initial_message_count) - system), int(row.final_message_count)
                done = [*done[:first], ("user", row.summary, None), *(done[max(first, len(done) - last):] if last else [])]
        yield pd.DataFrame(out, columns=["session", "message_no", "role", "content", "tool_call_id"])
    if session is not None:
        yield pd.DataFrame(list(ended()), columns=["session", "message_no", "role", "content", "tool_call_id"])


def histories(events: DataFrame, session: str, order: str) -> DataFrame:
    """The conversation each session's events make: messages in order, calls with their results also where a result came first, results without a call left out, compactions applied. The system prompt isn't a message."""
    fields = ["type", "content", "tool_call_id", "output", "summary", "initial_message_count", "final_message_count"]
    rows = events.select(F.col(session).cast("string").alias("session"), F.col(order).alias("_at"), *fields).where("session is not null")
    return rows.repartition("session").sortWithinPartitions("session", "_at").drop("_at").mapInPandas(_fold, HISTORY)
