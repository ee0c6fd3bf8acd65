"""Runs of equal or nearly equal consecutive tool calls, collapsed into one event each."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.llm import run_kernel as kernel
from runloom.llm._ship import by_value
from runloom.session import checkpoint

by_value(kernel, sys.modules[__name__])

_NAMES = ["run_id", "first_call_id", "last_call_id", "tool_name", "action", "status", "calls", "first_step", "last_step", "started_us", "ended_us"]
_NODE = pa.schema([(n, t) for n, t in zip(_NAMES, [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()])])
_DDL = "run_id string, first_call_id long, last_call_id long, tool_name string, action string, status string, calls long, first_step int, last_step int, started_us long, ended_us long"
#: A node of the linked list is a list in the order of _NAMES: a call, or a run of calls merged into its first.
RUN, FIRST, LAST, TOOL, ACTION, STATUS, CALLS, FIRST_STEP, LAST_STEP, START, END = range(len(_NAMES))


def _absorb(into: list, other: list) -> None:
    into[LAST], into[LAST_STEP] = other[LAST], other[LAST_STEP]
    into[CALLS] += other[CALLS]
    for c, of in ((START, min), (END, max)):
        if other[c] is not None:
            into[c] = other[c] if into[c] is None else of(into[c], other[c])


def _merge(nodes: list[list], least: float, max_gap_us: int | None) -> list[list]:
    """The runs of one stretch: nodes of one run of the agent, tool and status, in one linked list with one heap."""
    if len(nodes) < 2:
        return nodes
    actions = [(kernel.canonical(n[ACTION]), n[ACTION] or "") for n in nodes]
    out = []
    for a, b in kernel.agglomerate([0] * len(nodes), actions, [n[START] for n in nodes], [n[END] for n in nodes], least, max_gap_us):
        for n in nodes[a + 1 : b + 1]:
            _absorb(nodes[a], n)
        out.append(nodes[a])
    return out


def _wall(node: list, least: float) -> tuple:
    """What neighbours have to share to be merged ever, however others merge. From SAME on, equal canonical words are part of it."""
    return (node[RUN], node[TOOL], node[STATUS], kernel.canonical(node[ACTION]) if least >= kernel.SAME else None)


def _apart(a: list, b: list, max_gap_us: int | None) -> bool:
    return max_gap_us is not None and a[END] is not None and b[START] is not None and b[START] - a[END] > max_gap_us


def _stretches(least: float, max_gap_us: int | None):
    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over one sorted partition: the runs of every stretch between two walls. The partition's first and last stretch may go on
        beyond its border; their nodes are given as they are, with the place (1 first, 2 last, 3 both) they stand at, and their wall."""
        schema = _NODE.append(pa.field("part", pa.int32())).append(pa.field("place", pa.int32())).append(pa.field("wall", pa.string())).append(pa.field("at", pa.int64()))
        rows: list[tuple] = []
        open_: list[list] = []  # the stretch that is being read
        wall = None
        first, part, at = True, 0, 0

        def given(nodes: list[list], place: int) -> None:
            nonlocal at
            key = "\x01".join(repr(x) for x in wall) if place else None
            for n in nodes:
                rows.append((*n, part, place, key, at))
                at += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for b in batches:
            for run, step, call, tool, action, status, start, end, part in zip(*(c.to_pylist() for c in b.columns)):
                node = [run, call, call, tool, action, status, 1, step, step, start, end]
                key = _wall(node, least)
                if open_ and key == wall and not _apart(open_[-1], node, max_gap_us):
                    if (open_[-1][ACTION] or "") == (action or ""):
                        _absorb(open_[-1], node)  # nothing is more similar, so nothing could be merged before
                    else:
                        open_.append(node)
                    continue
                if open_:
                    given(open_ if first else _merge(open_, least, max_gap_us), int(first))
                    first = False
                open_, wall = [node], key
            if rows:
                yield batch()
        if open_:
            given(open_, 3 if first else 2)
        if rows:
            yield batch()

    return stretches


def collapse(tool_results: DataFrame, min_similarity: float = kernel.SAME, max_gap_s: float | None = None) -> DataFrame:
    """One row per run of neighbouring calls: run_id, first/last_call_id, tool_name, action, status, calls, first/last_step, started_at, duration_s.

    Order in a run of the agent is (step_idx, call_idx, call_id), nulls first; copies of a call_id at one place count once, the
    earliest started. Neighbours with equal tool_name and status merge by adjacent agglomeration, the most similar first,
    while the similarity of their first actions is at least ``min_similarity`` and the time between them at most
    ``max_gap_s`` (None: any; a missing time is no gap). At SAME they differ at most in how they are written and in values
    made afresh, at 1 not at all. Null and blank actions are equal, as are null tools or states. duration_s is from the
    first start to the last start plus execution_time (null: 0). Rows without run_id belong to no run and have no event.
    An empty table gives an empty result.

    Calls are range-partitioned by their place, so one agent run of any length spreads over many tasks. Nothing ever merges
    across a wall: a change of run, tool or status, a gap, and from SAME on another action. Stretches between walls are
    therefore merged each for itself, with the result of one linked list over the whole run; those that lie across a
    partition's border meet in one task, equal neighbours merged before. Below SAME such a stretch is as long as a tool is
    called in a row with one status.
    """
    start = F.unix_micros(F.col("started_at").cast("timestamp"))
    place = ["run_id", "step_idx", "call_idx", "call_id"]
    calls = tool_results.where("run_id is not null").select(
        "run_id", F.col("step_idx").cast("int").alias("step_idx"), F.col("call_idx").cast("int").alias("call_idx"), F.col("call_id").cast("long").alias("call_id"), "tool_name", "action", "status",
        start.alias("s"), (start + F.coalesce(F.col("execution_time") * 1e6, F.lit(0.0)).cast("long")).alias("e"),
    )
    # copies of a call go before anything moves: each task passes on one
    own = F.when(F.col("call_id").isNull(), F.monotonically_increasing_id())
    copy = F.row_number().over(W.partitionBy(*place, "own").orderBy("s", "e", "action"))
    calls = calls.withColumn("own", own).withColumn("copy", copy).where("copy = 1").drop("own", "copy")
    n = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = calls.repartitionByRange(n, *place).sortWithinPartitions(*place, "s")
    placed = placed.select("run_id", "step_idx", "call_id", "tool_name", "action", "status", "s", "e", F.spark_partition_id().alias("part"))
    gap = None if max_gap_s is None else int(max_gap_s * 1e6)
    found = checkpoint(placed.mapInArrow(_stretches(min_similarity, gap), f"{_DDL}, part int, place int, wall string, at long"))

    # what stands at a border: one row per partition and place, at most two a partition
    edges = found.where("place > 0").groupBy("part", "place").agg(F.min("wall").alias("wall"), F.min("at").alias("at"), F.max("ended_us").alias("e"), F.min("started_us").alias("s"))
    w = W.orderBy("part", "at")
    goes_on = F.col("place").isin(1, 3) & F.lag("place").over(w).isin(2, 3) & (F.col("wall") == F.lag("wall").over(w))
    if gap is not None:
        goes_on = goes_on & F.coalesce(F.col("s") - F.lag("e").over(w) <= gap, F.lit(True))
    # a first stretch that is not the last is followed by the last one, which begins anew
    numbered = edges.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("stretch", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).select("part", "place", "stretch")
    across = found.where("place > 0").join(F.broadcast(numbered), ["part", "place"])

    def whole(stretch: pa.Table) -> pa.Table:
        nodes = [list(r) for r in zip(*(c.to_pylist() for c in stretch.sort_by([("part", "ascending"), ("at", "ascending")]).select(_NAMES).columns))]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*_merge(nodes, min_similarity, gap)), _NODE)], schema=_NODE)

    out = found.where("place = 0").select(_NAMES).unionByName(across.groupBy("stretch").applyInArrow(whole, _DDL))
    return out.select(*_NAMES[:-2], F.timestamp_micros("started_us").alias("started_at"), F.round((F.col("ended_us") - F.col("started_us")) / 1e6, 6).alias("duration_s"))
