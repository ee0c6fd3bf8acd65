"""Keyed session state: requests, completion, finalization and abortion of sessions, in batch and on streams."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators.blocks import place, scan
from runloom.shipping import by_value
from runloom.streaming.in_order import keyed

by_value(sys.modules[__name__])

#: What an event does in a phase: (phase, event) -> next phase; anything else is refused and changes nothing.
MOVES = {
    ("active", "request"): "active",
    ("active", "complete"): "completed",
    ("completed", "complete"): "completed",
    ("active", "finalize"): "finalized",
    ("completed", "finalize"): "finalized",
    ("active", "abort"): "aborted",
    ("completed", "abort"): "aborted",
    ("aborted", "abort"): "aborted",
}
_OUT = "session_id string, seq long, event string, phase string, accepted boolean"


def fold(phase: str, events: list[tuple[int, str]]) -> tuple[str, list[tuple[int, str, str, bool]]]:
    """The phase after events in order, and per event (seq, event, phase after it, accepted)."""
    rows = []
    for seq, event in sorted(events):
        to = MOVES.get((phase, event))
        phase = to or phase
        rows.append((seq, event, phase, to is not None))
    return phase, rows


def states(events: DataFrame) -> DataFrame:
    """(session_id, seq, event, phase, accepted) on a stream or in batch; events have session_id, seq, event, numbered from 1 in their session.

    State is one word per session, and on a stream the events that wait for one before them."""
    if events.isStreaming:

        def step(state: dict, event: dict) -> tuple[dict, list[dict]]:
            phase, rows = fold(state["phase"], [(event["seq"], event["event"])])
            return {"phase": phase}, [dict(zip(("seq", "event", "phase", "accepted"), r)) for r in rows]

        rows = events.select("session_id", F.col("seq").cast("long").alias("seq"), "event")
        return keyed(rows, "session_id", "seq", step, {"phase": "active"}, _OUT, ["session_id", "seq", "event", "phase", "accepted"])
    # in batch the first terminal event by order decides, and before it whether there was a completion
    ends = F.col("event").isin("finalize", "abort")
    x = place(events.select("session_id", F.col("seq").cast("long").alias("seq"), "event"), ["session_id"], "seq")
    x = scan(x, ["seq"], sums={"ended": ends.cast("int"), "done": (F.col("event") == "complete").cast("int")}, totals={"first_end": ("min", F.when(ends, F.struct("seq", "event")))})
    x = x.withColumn("ended", F.col("ended") - F.coalesce(ends.cast("int"), F.lit(0))).withColumn("done", F.col("done") - F.coalesce((F.col("event") == "complete").cast("int"), F.lit(0))).withColumn("final", F.col("first_end.event"))
    before = F.when(F.col("ended") > 0, F.when(F.col("final") == "finalize", "finalized").otherwise("aborted")).when(F.col("done") > 0, "completed").otherwise("active")
    out = x.select("session_id", "seq", "event", before.alias("before"))
    moves = F.create_map(*[x for k, v in MOVES.items() for x in (F.lit(f"{k[0]}/{k[1]}"), F.lit(v))])
    to = F.try_element_at(moves, F.concat_ws("/", "before", "event"))
    return out.select("session_id", "seq", "event", F.coalesce(to, F.col("before")).alias("phase"), to.isNotNull().alias("accepted"))
