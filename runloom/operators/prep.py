"""Task samples: projections, filters, splits and repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.operators.order import with_index


def targets(ground_truth: Column) -> Column:
    """Targets of a JSON ground truth as text array: its ``target`` field if it is an object, else itself; null is none, a scalar one."""
    is_object = ground_truth.rlike(r"^\s*\{")
    inner = F.when(is_object, F.get_json_object(ground_truth, "$.target")).otherwise(ground_truth)
    listed = F.from_json(inner, "array<string>")
    return F.when(inner.isNull() | (F.trim(inner) == "null"), F.array().cast("array<string>")).when(inner.rlike(r"^\s*\["), listed).otherwise(F.array(F.regexp_replace(inner, '^"|"$', "")))


def samples(df: DataFrame, id_col: str, question: str, answer: str, source: str, default_source: str = "unknown") -> DataFrame:
    """(data_source, prompt, style, target, index) rows, indexed by id order."""
    return with_index(df, id_col).select(F.coalesce(source, F.lit(default_source)).alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), F.col(question).alias("content"))).alias("prompt"), F.lit("rule").alias("style"), targets(F.to_json(F.array(answer))).alias("target"), "index")


def language_filter(df: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Rows in one of the languages; all rows if none is wanted."""
    return df.where(F.lower(F.coalesce(column, F.lit(""))).isin([w.lower() for w in wanted])) if wanted else df


def positional_split(df: DataFrame, order: str, train: int, test: int) -> DataFrame:
    """``df`` with split: the first ``train`` rows by order, then ``test`` rows; others are left out. Too few rows are an error."""
    rows = with_index(df, order, name="_n")
    if df.count() < train + test:
        raise ValueError("too few rows for the split")
    return rows.where(F.col("_n") < train + test).withColumn("split", F.when(F.col("_n") < train, "train").otherwise("test")).drop("_n")


def deal(df: DataFrame, order: str, workers: int) -> DataFrame:
    """``df`` with worker (in turn) and chunk (in equal stretches)."""
    size = (df.count() - 1) // workers + 1
    return with_index(df, order, name="_i").withColumn("worker", F.pmod("_i", F.lit(workers)).cast("int")).withColumn("chunk", F.floor(F.col("_i") / max(1, size)).cast("int")).drop("_i")


def repeat(df: DataFrame, n: int) -> DataFrame:
    """Every row n times, numbered from 1."""
    return df.withColumn("rollout", F.explode(F.sequence(F.lit(1), F.lit(n)))) if n > 0 else df.withColumn("rollout", F.lit(1)).limit(0)


def image_name(instance: Column) -> Column:
    return F.lower(F.replace(instance, F.lit("__"), F.lit("_1776_")))


def recent(df: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    """Rows without a time, or of the last ``days`` days (at least one)."""
    return df.where(F.col(column).isNull() | (F.col(column) >= now - F.expr(f"interval {max(days, 1)} days")))
