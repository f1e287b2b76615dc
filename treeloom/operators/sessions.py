"""Session logs: events as rows, running totals, pairing, budgets over ordered rows, reconstruction."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.operators.prefix import prefix_sums

EVENT = (
    "type string, timestamp string, id int, workspace string, model string, resumed_from int, content string, raw_content string, source string, origin string, purpose string, input string, tool string, tool_call_id string, "
    "output string, truncated boolean, input_tokens int, cached_input_tokens int, output_tokens int, summary string, initial_message_count int, compacted_message_count int, final_message_count int, reason string")
# The fields an event of each type must have.
REQUIRED = {
    "session_start": ["id", "workspace", "model"], "system_prompt": ["content"], "user_message": ["content"], "llm_response": ["content"], "tool_call": ["tool", "tool_call_id", "input"],
    "tool_result": ["tool_call_id", "output"], "token_usage": ["input_tokens", "output_tokens"], "compaction": ["summary", "initial_message_count", "final_message_count"], "session_end": ["reason"]}


OBJECT = re.compile(r'\{\s*"')
TYPED = re.compile(r'\{\s*"type"\s*:')
DECODER = json.JSONDecoder()


def event_object(line: str) -> str | None:
    """The first JSON object of a line that has a type, up to its matching brace; none where an object that begins with its type is cut or malformed, and none of a type alone, since every event has more."""
    at = 0
    while start := OBJECT.search(line, at):
        try:
            value, end = DECODER.raw_decode(line, start.start())
        except (ValueError, RecursionError):
            if TYPED.match(line, start.start()):
                return None
            at = start.start() + 1
            continue
        if isinstance(value.get("type"), str) and re.fullmatch("[a-z_]+", value["type"]) and len(value) > 1:
            return line[start.start():end]
        at = end
    return None


def _event_objects(lines: pd.Series) -> pd.Series:
    return lines.map(event_object)


def json_events(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no`` and the fields of :data:`EVENT` of every line of a text that holds a JSON object with a type, whatever its spacing, order of keys and last value (:func:`event_object`); ``origin`` defaults to model. What stands around the object is ignored."""
    lines = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n"))).where(F.contains("col", F.lit("{")))
    rows = lines.select(key, (F.col("pos") + 1).alias("line_no"), F.pandas_udf(_event_objects, "string")("col").alias("raw")).where("raw is not null")
    parsed = rows.select(key, "line_no", F.from_json("raw", EVENT).alias("e")).select(key, "line_no", "e.*").where("type is not null")
    return parsed.withColumn("origin", F.coalesce("origin", F.lit("model")))


def valid_event() -> Column:
    """Whether an event has the fields its type needs; an unknown type is not valid."""
    return F.coalesce(*[F.when(F.col("type") == t, F.forall(F.array(*[F.col(c).isNotNull() for c in need]), lambda x: x)) for t, need in REQUIRED.items()], F.lit(False))


def event_line(event: DataFrame) -> DataFrame:
    """``line``: each event as one JSON object, keys without a value left out."""
    return event.select(F.to_json(F.struct(*event.columns)).alias("line"))


def running_totals(events: DataFrame, session: str, order: list[str], measure: str, slot: Column | None = None) -> DataFrame:
    """``events`` with ``total_so_far``: the sum of ``measure`` over the session up to each event. slot: see :func:`prefix_sums`; needed where one session is very long."""
    return prefix_sums(events, [session], slot if slot is not None else F.lit(0), order, {"total_so_far": measure}).drop("total_so_far_all")


def budget_blocks(messages: DataFrame, session: str, seq: str, tokens: str, initial: int, final: int, slot: Column | None = None) -> DataFrame:
    """``messages`` with ``block``: ``initial`` for the longest prefix within its budget but always the first two, ``final`` for the longest suffix within its budget, ``middle`` for what remains. Where they overlap the prefix has precedence. slot as in :func:`running_totals`."""
    rows = prefix_sums(messages.withColumn("_one", F.lit(1)), [session], slot if slot is not None else F.lit(0), [seq], {"_n": "_one", "_front": tokens})
    back = F.col("_front_all") - F.col("_front") + F.col(tokens)
    block = F.when((F.col("_n") <= 2) | (F.col("_front") <= initial), "initial").when(back <= final, "final").otherwise("middle")
    return rows.withColumn("block", block).select(*messages.columns, "block")


def sessions_by_gap(events: DataFrame, user: str, time: str, gap_seconds: int) -> DataFrame:
    """``events`` with ``session_no`` from 1 per user: a new session begins after more than the gap without an event.

    Events are compared within a day of a user; the first of a day is compared with the last of the user's day before, so a user with very many events spreads over the days.
    """
    day = F.date_trunc("day", time)
    days = events.groupBy(user, day.alias("_day")).agg(F.max(time).alias("_last"))
    before = days.select(F.col(user).alias("_user"), F.col("_day").alias("_on"), F.lag("_last").over(Window.partitionBy(user).orderBy("_day")).alias("_earlier"))
    dated = events.withColumn("_day", day)
    dated = dated.join(before, F.col(user).eqNullSafe(F.col("_user")) & F.col("_day").eqNullSafe(F.col("_on"))).drop("_user", "_on")
    last = F.coalesce(F.lag(time).over(Window.partitionBy(user, "_day").orderBy(time, "event_id")), F.col("_earlier"))
    new = dated.withColumn("_new", F.coalesce((F.col(time) - last > F.make_dt_interval(secs=F.lit(gap_seconds))).cast("int"), F.lit(1))).drop("_earlier")
    return prefix_sums(new, [user], F.col("_day"), [time, "event_id"], {"session_no": "_new"}).drop("session_no_all", "_new", "_day")


def call_pairs(events: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    """Tool calls with their results (first result by line, also one that came before its call), and the results that no call asked for."""
    calls = events.where("type = 'tool_call'").select(session, "tool_call_id", F.col("line_no").alias("call_no"), "tool")
    results = events.where("type = 'tool_result'").groupBy(session, "tool_call_id").agg(F.min("line_no").alias("result_no"))
    return calls.join(results, [session, "tool_call_id"], "left"), results.join(calls, [session, "tool_call_id"], "left_anti")


def token_estimate(text: Column) -> Column:
    """A fourth of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4))


def retry_delay(status: Column, attempt: Column, most: int) -> Column:
    """Milliseconds to wait: 1000 times two to the attempt for 429 and server errors below ``most`` attempts, else null."""
    return F.when((attempt < most) & ((status == 429) | (status >= 500)), (F.lit(1000) * F.pow(F.lit(2), attempt)).cast("bigint"))


def listing(events: DataFrame, session: str, order: str) -> DataFrame:
    """``session, id, started, duration, description`` of every session with a start: the first start's number and time to the minute, how long until the first end (empty without one), and the raw text, else the text, of the first message that is not a reflection, cut to 120 characters."""
    from treeloom.functions.scalars import duration, shortened

    first = lambda kind, value, more=F.lit(True): F.min_by(value, F.when((F.col("type") == kind) & more, F.col(order)))
    met = events.groupBy(session).agg(
        F.count_if(F.col("type") == "session_start").alias("starts"), first("session_start", F.col("id")).alias("id"), first("session_start", F.col("timestamp")).alias("began"), first("session_end", F.col("timestamp")).alias("ended"),
        first("user_message", F.coalesce("raw_content", "content"), ~F.col("source").eqNullSafe("reflection")).alias("said"))
    said = F.regexp_replace(F.coalesce("said", F.lit("(no description)")), r"\s*\n\s*", " ")
    return met.where("starts > 0").select(session, "id", F.left("began", F.lit(16)).alias("started"), F.when(F.col("ended").isNull(), "").otherwise(duration(F.col("began"), F.col("ended"))).alias("duration"), shortened(said, 120).alias("description"))


def final_messages(events: DataFrame, session: str, order: str) -> DataFrame:
    """``session, content``: the last answer of each session that has one; logs that keep an answer's text as ``output`` count too."""
    answers = events.where("type = 'llm_response'")
    return answers.groupBy(session).agg(F.max_by(F.coalesce("content", "output"), F.col(order)).alias("content"))


def steering(usage: DataFrame, template: Column, limits: dict[str, int]) -> DataFrame:
    """``usage`` (``baseline, last_call, turn_index, auto_turns, state``) with ``message``: the filled template of a turn after its first call, null for that call or where the template asks for something unknown."""
    from treeloom.functions.scalars import filled

    values = {"julia_state": F.col("state"), "turn_tokens": F.greatest(F.lit(0), F.col("last_call") - F.col("baseline")).cast("string"), "turn_index": F.col("turn_index").cast("string"), "auto_turns_taken": F.col("auto_turns").cast("string")}
    values |= {name: F.lit(str(n)) for name, n in limits.items()}
    return usage.withColumn("message", F.when(F.col("baseline") != 0, filled(template, values)))
