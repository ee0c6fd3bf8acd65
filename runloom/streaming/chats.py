"""What a chat remembers before each message, and sessions that never complete, in batch and on streams."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators.blocks import place, scan
from runloom.shipping import by_value
from runloom.streaming.in_order import keyed

by_value(sys.modules[__name__])

_SCHEMA = "chat_id string, seq long, remembered int, failed boolean"
_COLUMNS = ["chat_id", "seq", "remembered", "failed"]


def memory(events: DataFrame, keep: int) -> DataFrame:
    """(chat_id, seq, remembered, failed) of chat events (chat_id, seq from 1, content): how many messages, ``keep`` at most, each is answered
    with. A message without content fails: it is passed over and not remembered, and the chat goes on."""
    if events.isStreaming:

        def step(state: dict, event: dict) -> tuple[dict, list[dict]]:
            held, failed = state.get("held", 0), not (event["content"] or "").strip()
            return {"held": held if failed else min(keep, held + 1)}, [{"seq": event["seq"], "remembered": held, "failed": failed}]

        return keyed(events.select("chat_id", "seq", "content"), "chat_id", "seq", step, {}, _SCHEMA, _COLUMNS)
    good = F.trim(F.coalesce("content", F.lit(""))) != ""
    x = scan(place(events.select("chat_id", F.col("seq").cast("long").alias("seq"), good.alias("good")), ["chat_id"], "seq"), ["seq"], sums={"n": F.col("good").cast("int")})
    return x.select("chat_id", "seq", F.least(F.col("n") - F.col("good").cast("int"), F.lit(keep)).cast("int").alias("remembered"), (~F.col("good")).alias("failed"))


def completion_times(events: DataFrame, limit_s: float) -> DataFrame:
    """(session_id, waited_s, timed_out) of session events (session_id, at, event): seconds from the first event to the first
    completion, and whether they are more than ``limit_s`` or there is none."""
    at = F.col("at").cast("timestamp")
    first = events.groupBy("session_id").agg(F.min(at).alias("begun"), F.min(F.when(F.col("event") == "complete", at)).alias("done"))
    waited = (F.unix_micros("done") - F.unix_micros("begun")) / 1e6
    return first.select("session_id", F.round(waited, 6).alias("waited_s"), (F.coalesce(waited, F.lit(float("inf"))) > limit_s).alias("timed_out"))


def waiting(events: DataFrame, limit_ms: int) -> DataFrame:
    """(session_id, outcome) on a stream of session events (session_id, seq from 1, event): completed once a session completes,
    timed_out if nothing comes for ``limit_ms`` of processing time before."""

    return keyed(events.select("session_id", "seq", "event"), "session_id", "seq", wait_step, {}, "session_id string, outcome string", ["session_id", "outcome"], timeout_ms=limit_ms, late=wait_over)


def wait_step(state: dict, event: dict) -> tuple[dict, list[dict]]:
    if state.get("done") or event["event"] != "complete":
        return state, []
    return {"done": True}, [{"outcome": "completed"}]


def wait_over(state: dict, _: dict) -> tuple[dict, list[dict]]:
    return state, [] if state.get("done") else [{"outcome": "timed_out"}]
