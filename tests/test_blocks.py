"""Passes in blocks give what plain windows give, with one run that holds most rows, null keys and null places."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.operators import blocks, sequence


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(blocks, "SIZE", 3)


def rows(spark, n=400):
    rng = random.Random(1)
    data = [(("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])), rng.choice([None, *range(60)]), i, rng.choice([None, 1, 2, 5]), rng.choice("xy")) for i in range(n)]
    return spark.createDataFrame(data, "run_id string, step_idx int, turn_id long, tokens int, source string")


@pytest.mark.parametrize("reverse", [False, True])
def test_scan_equals_windows(spark, small, reverse):
    df = rows(spark)
    order = ["step_idx", "turn_id"]
    got = blocks.unplace(blocks.scan(blocks.place(df, ["run_id"], "step_idx"), order, sums={"s": F.coalesce("tokens", F.lit(0))}, lasts={"l": F.when(F.col("source") == "x", F.col("turn_id"))}, totals={"t": ("sum", F.col("tokens")), "m": ("max", F.col("turn_id"))}, before=("b", F.col("turn_id"), 2), reverse=reverse))
    way = F.desc if reverse else F.asc
    w = W.partitionBy("run_id").orderBy(*[way(c) for c in order])
    up = w.rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("run_id")
    want = df.select("*", F.sum(F.coalesce("tokens", F.lit(0))).over(up).alias("s"), F.last(F.when(F.col("source") == "x", F.col("turn_id")), ignorenulls=True).over(up).alias("l"), F.sum("tokens").over(whole).alias("t"), F.max("turn_id").over(whole).alias("m"), F.collect_list("turn_id").over(w.rowsBetween(-2, -1)).alias("b"))
    key = lambda r: r["turn_id"]
    assert sorted(got.select(want.columns).collect(), key=key) == sorted(want.collect(), key=key)


def test_once_keeps_the_first_and_all_without_a_key(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 3, "b"), (None, 1, "c"), (None, 1, "d"), (2, None, "e")], "id int, at int, t string")
    assert {tuple(r) for r in blocks.once(df, "id", "at").collect()} == {(1, 3, "b"), (None, 1, "c"), (None, 1, "d"), (2, None, "e")}


def test_nothing_sorts_all_texts_of_one_run_in_one_task(spark, small):
    """The blocks of the hot run are spread by the shuffle."""
    x = blocks.place(rows(spark), ["run_id"], "step_idx").where("run_id = 'hot'")
    sizes = [r["count"] for r in x.groupBy("_block").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 60


def test_the_third_step_of_condensing_masks_arguments(spark):
    call = lambda t: f"<function=edit><parameter=old_str>{t}</parameter><parameter=path>p</parameter></function>"
    data = [("c", 0, "system", "s"), ("c", 1, "user", "u")]
    for i in range(2, 20):
        data.append(("c", i, *(("assistant", call("x" * 100)) if i % 2 == 0 else ("tool", "y" * 50))))
    m = spark.createDataFrame(data, "conv_id string, idx int, role string, content string")
    out = {r["idx"]: r for r in sequence.condense(m, 4 * 50 + 150, keep_last=10).collect()}
    assert [i for i in sorted(out) if out[i]["masked"]] == [3, 5, 7, 9]
    assert [i for i in sorted(out) if "<MASKED>" in out[i]["content"]] == [2, 4]  # 92 characters each
    assert not out[2]["unmet"] and sequence.condense(m, 10_000).first()["unmet"]
