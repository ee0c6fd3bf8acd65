"""Items of varying length into containers of fixed capacity, by pattern packing."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.llm import pack_kernel as kernel
from runloom.llm._ship import by_value
from runloom.session import checkpoint

by_value(kernel, sys.modules[__name__])

#: Parts in which items of one length are ranked; copies of one item that are written out at a time.
SALTS, COPIES = 64, 1 << 16
#: Lengths that the driver plans for at most, and rows of a plan (56 bytes each) that are sent at a time.
LENGTHS, PLAN_ROWS = 1 << 22, 1 << 20


def items_of_segments(segments: DataFrame) -> DataFrame:
    """(run_id, segment_index, tokens) of each row; a null array has no tokens."""
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return segments.select("run_id", "segment_index", (n("prompt_ids") + n("response_ids")).cast("long").alias("tokens"))


def pack(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Every item in a container of each kind: container, capacity, run_id, segment_index, piece, tokens, container_no, used, pattern_items, fill.

    ``items`` has run_id, segment_index, tokens; ``limits`` container, capacity. An item longer than a capacity is divided into
    pieces of that capacity and a rest; no other is. Every row of ``items`` has its own row or rows, copies included. Items
    of no or null length have tokens 0 and go to container 0. Limits without a positive capacity hold nothing and have no
    rows. Empty items or limits give an empty result.

    pattern_items is how many items of the container were placed by patterns.

    Only the histogram of lengths is gathered: per kind one row per length that occurs, at most LENGTHS (more is an error, as is
    a capacity that makes them). What the executors get has a few rows per length and pattern, for containers alike are one row; where it has
    more than PLAN_ROWS, it is sent in slices by length, one pass each. Items of a length are ranked in SALTS parts and
    copies are counted before, so a length or an item that a third of all rows share is no bottleneck.
    """
    spark = items.sparkSession
    kinds = {r[0]: int(r[1]) for r in limits.select("container", "capacity").distinct().collect() if r[1] and r[1] > 0}  # a handful of settings
    # copies counted before anything else moves
    grouped = items.select("run_id", "segment_index", F.greatest(F.coalesce(F.col("tokens").cast("long"), F.lit(0)), F.lit(0)).alias("size")).groupBy("run_id", "segment_index", "size").agg(F.count("*").alias("copies"))
    grouped = checkpoint(grouped)
    each = F.array(*[F.struct(F.lit(k).alias("container"), F.lit(c).cast("long").alias("capacity")) for k, c in sorted(kinds.items())])
    by_kind = grouped.select("*", F.explode(each).alias("kind")) if kinds else grouped.limit(0).withColumn("kind", F.struct(F.lit("").alias("container"), F.lit(1).cast("long").alias("capacity")))
    by_kind = by_kind.select("run_id", "segment_index", "size", "copies", "kind.container", "kind.capacity")
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / F.col("capacity")), F.lit(1)).cast("int") - 1)
    split = by_kind.select("*", F.explode(pieces).alias("piece")).withColumn("tokens", F.least(F.col("capacity"), F.col("size") - F.col("piece") * F.col("capacity"))).drop("size")
    lengths = split.groupBy("container", "tokens").agg(F.sum("copies").alias("n")).limit(LENGTHS + 1).collect()
    if len(lengths) > LENGTHS:
        raise ValueError(f"more than {LENGTHS} lengths to plan for; use smaller capacities")
    hist: dict[str, dict[int, int]] = {k: {} for k in kinds}
    for container, tokens, n in lengths:
        if tokens > 0:
            hist[container][tokens] = n
    plans = {k: kernel.places(kernel.pack(hist[k], c)) for k, c in kinds.items()}

    salted = split.withColumn("salt", F.pmod(F.xxhash64("run_id", "segment_index", "piece"), F.lit(SALTS)))
    cell = W.partitionBy("container", "tokens", "salt")
    counts = salted.groupBy("container", "tokens", "salt").agg(F.sum("copies").alias("n"))
    offsets = counts.withColumn("before", F.sum("n").over(W.partitionBy("container", "tokens").orderBy("salt")) - F.col("n")).drop("n")
    within = F.sum("copies").over(cell.orderBy("run_id", "segment_index", "piece").rowsBetween(W.unboundedPreceding, 0)) - F.col("copies")
    ranked = salted.withColumn("within", within).join(offsets, ["container", "tokens", "salt"]).withColumn("rank", F.col("before") + F.col("within"))
    parts = ranked.select("container", "capacity", "run_id", "segment_index", "piece", "tokens", "rank", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))).alias("part"))
    copy = F.explode(F.sequence(F.col("part") * COPIES, F.least((F.col("part") + 1) * COPIES, F.col("copies")) - 1))
    one = parts.select("container", "capacity", "run_id", "segment_index", "piece", "tokens", "rank", copy.alias("copy")).withColumn("rank", F.col("rank") + F.col("copy")).drop("copy")

    def placing(sent):
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plan = sent.value
            for b in batches:
                kind = np.asarray(b.column("container").to_pylist(), object)
                tokens, rank = b.column("tokens").to_numpy(), b.column("rank").to_numpy()
                no, used, made = (np.zeros(len(tokens), np.int64) for _ in range(3))
                for k in set(kind.tolist()):
                    at = np.flatnonzero((kind == k) & (tokens > 0))
                    lengths, starts, keys, rows = plan[k]
                    which = np.searchsorted(lengths, tokens[at])
                    # rows of one length are in order of rank: a search on (length's number, rank)
                    j = np.searchsorted(keys, (which << RANK_BITS) + rank[at], "right") - 1
                    no[at] = rows[j, 2] + (rank[at] - rows[j, 1]) // rows[j, 3]
                    used[at], made[at] = rows[j, 4], rows[j, 5]
                yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(no), pa.array(used), pa.array(made)], names=[*b.schema.names[:6], "container_no", "used", "pattern_items"])

        return place

    schema = f"container string, capacity long, run_id {items.schema['run_id'].dataType.simpleString()}, segment_index {items.schema['segment_index'].dataType.simpleString()}, piece int, tokens long, container_no long, used long, pattern_items long"
    out = None
    for low, high, part in _slices(plans):
        some = one if low is None else one.where((F.col("tokens") >= low) & (F.col("tokens") < high))
        placed = some.mapInArrow(placing(spark.sparkContext.broadcast(part)), schema)
        out = placed if out is None else out.unionByName(placed)
    return out.withColumn("fill", F.round(F.col("used") / F.col("capacity"), 6))


#: Bits of a key that hold an item's rank among those of its length; the others number the length.
RANK_BITS = 40


def _keyed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lengths, starts = np.unique(rows[:, 0], return_index=True)
    return lengths, starts, (np.searchsorted(lengths, rows[:, 0]) << RANK_BITS) + rows[:, 1], rows


def _slices(plans: dict[str, np.ndarray]):
    """(from length, to length, {kind: plan}) of at most about PLAN_ROWS rows each; (None, None, all) where one will do."""
    if sum(map(len, plans.values())) <= PLAN_ROWS:
        return [(None, None, {k: _keyed(a) for k, a in plans.items()})]
    lengths, n = np.unique(np.concatenate([a[:, 0] for a in plans.values()]), return_counts=True)
    cuts, held = [0], 0
    for length, m in zip(lengths.tolist(), n.tolist()):
        if held and held + m > PLAN_ROWS:
            cuts.append(length)
            held = 0
        held += m
    return [(a, b, {k: _keyed(x[(x[:, 0] >= a) & (x[:, 0] < b)]) for k, x in plans.items()}) for a, b in zip(cuts, [*cuts[1:], 1 << 62])]


def fill_report(packed: DataFrame) -> DataFrame:
    """Per container kind: capacity, items, pattern_share (of items placed by patterns), containers, tokens, fill (tokens over the capacity of all containers used)."""
    once = packed.groupBy("container", "capacity", "container_no").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"), F.max("pattern_items").alias("made"))
    out = once.groupBy("container", "capacity").agg(F.sum("items").alias("items"), F.round(F.sum("made") / F.sum("items"), 6).alias("pattern_share"), F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return out.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
