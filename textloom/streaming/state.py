"""Conversation state and event windows, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.functions import classify as C
from textloom.functions import text as T

MAX_OPEN, FIELD = 3, 70

# What sets a goal, closes a topic, or asks for something, in folded text.
GOALS = ("a celom", "azon dolgozom", "szeretnek elerni", "kovetkezo lepesem", "az a tervem")
CLOSURES = ("rendben", "ertem", "koszonom", "oke", "szuper", "az jo volt", "megvan", "kesz vagyunk")
TASKS = ("irj", "keress ra", "keresd meg", "nezz utana", "jegyezd meg", "keszits", "csinald meg", "mutasd meg", "magyarazd el", "sorolj fel", "hasonlitsd ossze")

STATE = "struct<topic:string,goal:string,questions:array<string>,tasks:array<string>,decision:string>"
STREAM = "conv_id bigint, turn bigint, topic string, goal string, questions string, tasks string, decision string"


def classified(messages: DataFrame) -> DataFrame:
    """Messages with what each does to the state of its conversation."""
    f, s = T.fold(F.col("text")), T.strip(F.coalesce(F.col("text"), F.lit("")))
    user = F.col("role") == "user"
    return messages.select(
        "conv_id",
        "turn",
        "role",
        T.trim_to(F.col("text"), FIELD).alias("field"),
        (user & C.follow_up(F.col("text"), C.CONTEXT_REFERENCES).isNull() & (s != "")).alias("new_topic"),
        (user & T.contains_any(f, GOALS)).alias("goal"),
        (user & T.contains_any(f, CLOSURES)).alias("closes"),
        (user & s.endswith("?")).alias("asks"),
        (user & T.contains_any(f, TASKS)).alias("task"),
        ((F.col("role") == "assistant") & (s != "")).alias("decides"),
    )


def _pushed(old: Column, value: Column, when: Column) -> Column:
    """``old`` with a new value at its end, the last three kept; a known value changes nothing."""
    longer = F.concat(old, F.array(value))
    last = F.slice(longer, F.greatest(F.size(longer) - MAX_OPEN + 1, F.lit(1)), F.lit(MAX_OPEN))
    return F.when(when & ~F.array_contains(old, value), last).otherwise(old)


def conversation_state(messages: DataFrame) -> DataFrame:
    """State of each conversation after its last message: a fold over its messages in order."""
    m = F.sort_array(F.collect_list(F.struct("turn", "field", "new_topic", "goal", "closes", "asks", "task", "decides")))
    empty = F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    start = F.struct(empty.alias("topic"), empty.alias("goal"), none.alias("questions"), none.alias("tasks"), empty.alias("decision"))

    def step(s: Column, x: Column) -> Column:
        return F.struct(
            F.when(x["new_topic"], x["field"]).otherwise(s["topic"]).alias("topic"),
            F.when(x["goal"], x["field"]).otherwise(s["goal"]).alias("goal"),
            F.when(x["closes"], none).otherwise(_pushed(s["questions"], x["field"], x["asks"])).alias("questions"),
            F.when(x["closes"], none).otherwise(_pushed(s["tasks"], x["field"], x["task"])).alias("tasks"),
            F.when(x["decides"], x["field"]).otherwise(s["decision"]).alias("decision"),
        )

    out = classified(messages).groupBy("conv_id").agg(F.aggregate(m, start, step).alias("s"), F.max("turn").alias("turn"))
    join = lambda c: F.array_join(c, " | ")
    return out.select("conv_id", "turn", "s.topic", "s.goal", join("s.questions").alias("questions"), join("s.tasks").alias("tasks"), "s.decision")


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    topic, goal, questions, tasks, decision = state.get if state.exists else (None, None, [], [], None)
    questions, tasks, turn = list(questions), list(tasks), None
    for x in pd.concat(batches).sort_values("turn").itertuples():
        turn = x.turn
        topic = x.field if x.new_topic else topic
        goal = x.field if x.goal else goal
        if x.closes:
            questions, tasks = [], []
        else:
            if x.asks and x.field not in questions:
                questions = [*questions, x.field][-MAX_OPEN:]
            if x.task and x.field not in tasks:
                tasks = [*tasks, x.field][-MAX_OPEN:]
        decision = x.field if x.decides else decision
    state.update((topic, goal, questions, tasks, decision))
    yield pd.DataFrame([[key[0], turn, topic, goal, " | ".join(questions), " | ".join(tasks), decision]], columns=[c.split()[0] for c in STREAM.split(", ")])


def stream_conversation_state(messages: DataFrame) -> DataFrame:
    """The same fold over a stream of messages: one row for each conversation that a batch touches."""
    state = "topic string, goal string, questions array<string>, tasks array<string>, decision string"
    return classified(messages).groupBy("conv_id").applyInPandasWithState(_fold, STREAM, state, "update", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) of event-time windows; ``late`` is the watermark of a stream."""
    e = events.withWatermark("ts", late) if late else events
    out = e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", every: str = "1 hour", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width, every)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, session_start, n) of runs of events that are less than ``gap`` apart."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Events of a stream without those that repeat an id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only log of JSON lines as a stream."""
    return spark.readStream.schema(schema).json(path)


MAX_FILES, MAX_EXCHANGES = 5, 2


def recent(rows: DataFrame, owner: str, order: list[str], most: int = MAX_FILES) -> DataFrame:
    """The last ``most`` rows of each owner, the oldest being put out. Spark keeps no more than ``most`` of an owner before the shuffle."""
    place = F.row_number().over(Window.partitionBy(owner).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def stream_recent(rows: DataFrame, owner: str, value: str, most: int = MAX_EXCHANGES) -> DataFrame:
    """A stream's last ``most`` values of each owner, in order of arrival: (owner, recent)."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        held = [*held, *(v for b in batches for v in b[value])][-most:]
        state.update((held,))
        yield pd.DataFrame({owner: [key[0]], "recent": [held]})

    kind = rows.schema[owner].dataType.simpleString()
    return rows.groupBy(owner).applyInPandasWithState(keep, f"{owner} {kind}, recent array<string>", "recent array<string>", "update", GroupStateTimeout.NoTimeout)
