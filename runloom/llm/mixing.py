"""Sources mixed to target shares of all tokens, by Poisson replication."""

from __future__ import annotations

import base64
import math
import sys
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm._ship import by_value
from runloom.session import checkpoint

by_value(sys.modules[__name__])

#: Levels of the quantile at which a source's rate is calibrated, and rows of that histogram that are gathered at most.
LEVELS, GATHERED = 4096, 1 << 21
#: Bytes of a tokenizer's rank file, which is sent to the executors, at most.
RANK_BYTES = 1 << 26
# Fixed value: how byte-level BPE splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoding(ranks: bytes):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}, special_tokens={})


def count_tokens(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, n_tokens) with a public tokenizer; null and empty texts have 0 tokens.

    ``tokenizer`` is the path of a rank file on the driver, of at most RANK_BYTES; executors get its contents."""
    ranks = Path(tokenizer).read_bytes()
    if len(ranks) > RANK_BYTES:
        raise ValueError(f"{tokenizer} is larger than a rank file is expected to be")
    sent = documents.sparkSession.sparkContext.broadcast(ranks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(sent.value)
        for b in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "source", "text").mapInArrow(count, f"doc_id {kind}, source string, n_tokens long")


def thresholds(rate: float, cap: int) -> list[float]:
    """Poisson probabilities of at most 0, 1, ... cap - 1: a quantile u is repeated as often as thresholds lie at or below it."""
    if math.isinf(rate):
        return [0.0] * cap
    if rate <= 0:
        return [1.0] * cap
    out, total = [], 0.0
    for k in range(cap):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(min(1.0, total))
    return out


def solve(want: float, u: np.ndarray, tokens: np.ndarray, cap: int) -> float:
    """The Poisson rate at which documents with quantiles ``u`` give the ``want``-ed tokens, each taken at most ``cap`` times."""
    if want <= 0 or cap <= 0:
        return 0.0
    if want >= cap * tokens.sum() * (1 - 1e-9):
        return math.inf

    def drawn(rate: float) -> float:
        return float((tokens * np.searchsorted(np.asarray(thresholds(rate, cap)), u, "right")).sum())

    low, high = 0.0, 1.0
    while drawn(high) < want:
        high *= 2
        if high > 4.0 * cap + 100:  # all but every document is taken as often as it may be
            return math.inf
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if drawn(mid) < want else (low, mid)
    return low if want - drawn(low) < drawn(high) - want else high


def _quantile(seed: int):
    """A document's place in (0, 1), from all bits that a double holds of its hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + 0.5) / float(1 << 53)


def plan(counted: DataFrame, targets: DataFrame, seed: int = 0) -> list[dict]:
    """Per target source: available tokens, wanted tokens, Poisson rate and thresholds.

    The total is the largest at which every source that has tokens reaches its share within its max_repeats. Rates are
    calibrated on the tokens of all documents by quantile, of which sources x LEVELS sums are gathered. With so many sources
    that these are more than GATHERED, rates are calibrated on fewer levels; what a document draws does not depend on that."""
    goals = {r["source"]: (float(r["target_share"] or 0.0), max(0, int(r["max_repeats"] or 0))) for r in targets.where("source is not null").collect()}  # settings
    levels = max(16, min(LEVELS, GATHERED // max(1, len(goals))))
    wanted = F.broadcast(targets.where("source is not null").select("source").distinct())
    rows = counted.join(wanted, "source").groupBy("source", F.least(F.floor(_quantile(seed) * levels), F.lit(levels - 1)).alias("level")).agg(F.sum("n_tokens").alias("t")).collect()
    by: dict[str, list[tuple[float, int]]] = {s: [] for s in goals}
    for s, level, t in rows:
        by[s].append(((level + 0.5) / levels, t))
    data = {s: (np.array([x[0] for x in v]), np.array([x[1] for x in v], float)) for s, v in by.items()}
    reach = [cap * data[s][1].sum() / share for s, (share, cap) in goals.items() if share > 0 and cap > 0 and data[s][1].sum() > 0]
    total = min(reach, default=0.0)
    out = []
    for s, (share, cap) in sorted(goals.items()):
        u, t = data[s]
        rate = solve(total * share, u, t, cap)
        out.append({"source": s, "target_share": share, "max_repeats": cap, "available_tokens": int(t.sum()), "wanted_tokens": total * share, "rate": rate, "thresholds": thresholds(rate, cap) if rate else [2.0] * cap})
    return out


def _drawn(df: DataFrame, made: list[dict], seed: int) -> DataFrame:
    """``df`` (doc_id, source, ...) with repeats; sources without a target are left out."""
    spark = df.sparkSession
    t = spark.createDataFrame([(p["source"], [float(x) for x in p["thresholds"]]) for p in made], "source string, thresholds array<double>")
    out = df.join(F.broadcast(t), "source").withColumn("u", _quantile(seed))
    return out.withColumn("repeats", F.size(F.filter("thresholds", lambda x: x <= F.col("u")))).drop("thresholds", "u")


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str, seed: int = 0) -> DataFrame:
    """The mixture: doc_id, source, copy (0, 1, ...), position_key, text, globally shuffled (sorted by position_key).

    How often a document is taken is the inverse of a Poisson distribution at a quantile that a hash of doc_id and seed gives,
    cut at the source's max_repeats; the rate is the one that reaches the source's share. Sources without a target (null
    among them) take no part; targets without documents get nothing. Null and empty texts count no tokens and are
    taken like others. Equal doc_ids are taken equally often. Empty tables give an empty result.
    """
    made = plan(checkpoint(count_tokens(_with_target(documents, targets), tokenizer)), targets, seed)
    drawn = _drawn(documents.select("doc_id", "source", "text"), made, seed).where("repeats > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    keyed = copies.select("doc_id", "source", "copy", F.xxhash64(F.lit(seed + 1), "doc_id", "copy").alias("position_key"), "text")
    return keyed.orderBy("position_key", "doc_id", "copy")


def _with_target(documents: DataFrame, targets: DataFrame) -> DataFrame:
    return documents.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")


def shares(documents: DataFrame, targets: DataFrame, tokenizer: str, seed: int = 0) -> DataFrame:
    """What ``mix`` reaches: source, target_share, max_repeats, available_tokens, documents, copies, tokens, actual_share, for every target."""
    counted = checkpoint(count_tokens(_with_target(documents, targets), tokenizer))
    made = plan(counted, targets, seed)
    got = _drawn(counted, made, seed).groupBy("source").agg(F.sum(F.when(F.col("repeats") > 0, 1).otherwise(0)).cast("long").alias("documents"), F.sum("repeats").cast("long").alias("copies"), F.sum(F.col("repeats") * F.col("n_tokens")).cast("long").alias("tokens"))
    rows = documents.sparkSession.createDataFrame([(p["source"], p["target_share"], p["max_repeats"], p["available_tokens"]) for p in made], "source string, target_share double, max_repeats int, available_tokens long")
    out = rows.join(got, "source", "left").na.fill(0, ["documents", "copies", "tokens"])
    total = out.agg(F.sum("tokens").alias("all"))
    return out.join(F.broadcast(total)).withColumn("actual_share", F.round(F.when(F.col("all") > 0, F.col("tokens") / F.col("all")).otherwise(0.0), 6)).drop("all")
