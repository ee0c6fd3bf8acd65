"""Ordered passes over groups of any size: running sums, last values and rows before, block by block.

A group's rows are put into blocks by the number that orders them, so a group that holds a third of all rows spreads over
many tasks. Inside a block plain windows run; one summary row per block carries sums, last values and last rows on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions of the ordering number in a block.
SIZE = 1024
#: Block of rows without a number, before all others.
NO_PLACE = -(1 << 62)


def once(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the least ``order``; rows without a key are all kept. Each task passes on one row a key."""
    own = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    nth = F.row_number().over(W.partitionBy(key, "_own").orderBy(order))
    return df.withColumn("_own", own).withColumn("_nth", nth).where("_nth = 1").drop("_own", "_nth")


def _group(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [f"_k{i}" for i in range(len(keys))] + ["_block"]


def place(df: DataFrame, keys: Sequence[str], at: str, size: int | None = None) -> DataFrame:
    """``df`` with the columns that ``scan`` groups by; several scans of the same keys then share one shuffle. Null keys are a group of their own."""
    for i, k in enumerate(keys):
        df = df.withColumn(f"_k{i}", F.coalesce(F.col(k).cast("string"), F.lit("\x00")))
    return df.withColumn("_block", F.coalesce(F.floor(F.col(at) / (size or SIZE)), F.lit(NO_PLACE)).cast("long"))


def unplace(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c == "_block" or c.startswith("_k") and c[2:].isdigit()])


def scan(
    df: DataFrame,
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    totals: dict[str, tuple[str, Column]] | None = None,
    before: tuple[str, Column, int] | None = None,
    reverse: bool = False,
) -> DataFrame:
    """``df`` (from ``place``), with for each row of a group, in ``order``: ``sums``, running sums with the row's own; ``lasts``,
    the last value that is not null, up to the row; ``totals``, (sum or max) over the group; ``before`` = (name, value, n),
    an array of the values of the n rows before. ``reverse`` goes from the end. ``order`` has to tell rows apart."""
    sums, lasts, totals = sums or {}, lasts or {}, totals or {}
    group = _group(df, [c for c in df.columns if c.startswith("_k") and c[2:].isdigit()])
    way = (lambda c: F.desc(c)) if reverse else (lambda c: F.asc(c))
    cell = W.partitionBy(*group).orderBy(*[way(c) for c in order])
    up_to = cell.rowsBetween(W.unboundedPreceding, 0)
    x = df
    for n, v in totals.items():
        x = x.withColumn(f"_t_{n}", v[1])
    for n, v in sums.items():
        x = x.withColumn(f"_v_{n}", v)
    for n, v in lasts.items():
        x = x.withColumn(f"_w_{n}", v)
    if before:
        x = x.withColumn("_x", before[1])
    x = x.withColumn("_n", F.row_number().over(cell))
    for n in sums:
        x = x.withColumn(f"_s_{n}", F.sum(f"_v_{n}").over(up_to))
    for n in lasts:
        x = x.withColumn(f"_l_{n}", F.last(f"_w_{n}", ignorenulls=True).over(up_to))
    if before:
        x = x.withColumn("_seen", F.collect_list(F.struct(F.col("_x").alias("x"))).over(cell.rowsBetween(-before[2], 0)))

    # one row per block
    agg = [F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums] + [getattr(F, f)(f"_t_{n}").alias(f"_t_{n}") for n, (f, _) in totals.items()]
    agg += [F.max_by(f"_l_{n}", "_n").alias(f"_l_{n}") for n in lasts] + ([F.max_by("_seen", "_n").alias("_seen")] if before else [])
    b = x.groupBy(*group).agg(*agg)
    by_group = W.partitionBy(*group[:-1])
    along = by_group.orderBy(way("_block"))
    earlier = along.rowsBetween(W.unboundedPreceding, -1)
    carry = [F.sum(f"_s_{n}").over(earlier).alias(f"_cs_{n}") for n in sums] + [F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_cl_{n}") for n in lasts]
    carry += [getattr(F, f)(f"_t_{n}").over(by_group).alias(f"_ct_{n}") for n, (f, _) in totals.items()]
    if before:
        carry.append(F.flatten(F.collect_list("_seen").over(along.rowsBetween(-before[2], -1))).alias("_cx"))
    y = x.join(b.select(*group, *carry), group)

    out = {n: F.coalesce(f"_s_{n}", F.lit(0)) + F.coalesce(f"_cs_{n}", F.lit(0)) for n in sums}
    out |= {n: F.coalesce(f"_l_{n}", f"_cl_{n}") for n in lasts} | {n: F.col(f"_ct_{n}") for n in totals}
    if before:
        m = before[2]
        inside = F.slice("_seen", F.lit(1), F.size("_seen") - 1)
        seen = F.concat("_cx", inside)
        out[before[0]] = F.transform(F.when(F.size(seen) > m, F.slice(seen, -m, m)).otherwise(seen), lambda s: s["x"])
    keep = [c for c in df.columns if c not in out]
    return y.select(*keep, *[v.alias(n) for n, v in out.items()])
