"""Exactly one delivery of each message, by the definition and on random repeats."""

import datetime as dt
import random

from runloom.operators import dedup

T0 = dt.datetime(2026, 2, 2)
SCHEMA = "delivery_id long, batch_id long, received_at timestamp_ntz, message_id string"


def brute(rows):
    kept = {}
    for r in rows:
        m = (r[3] or "").strip()
        if m:
            key = (r[2] is None, r[2] or T0, r[0])
            kept[m] = min(kept.get(m, key), key)
    return {r[0] for r in rows if (r[3] or "").strip() and kept[(r[3] or "").strip()][2] != r[0]}


def test_random_repeats(spark):
    rng = random.Random(3)
    rows = [(i, i // 40, T0 + dt.timedelta(minutes=rng.randrange(9000)), rng.choice([f"om_{rng.randrange(150)}", " om_1\n", "om_HOT", "OM_hot", "", None])) for i in range(900)]
    got = {r[0] for r in dedup.found(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_ties_and_missing_times(spark):
    rows = [(5, 0, T0, "a"), (3, 0, T0, "a"), (9, 0, None, "b"), (8, 1, T0, "b\t"), (1, 0, None, "c"), (2, 0, None, " c")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r[0] for r in dedup.found(df).collect()} == {5, 9, 2}
    assert {r[0] for r in dedup.deduplicate(df).collect()} == {3, 8, 1}


def test_across_buckets(spark):
    rows = [(i, i, T0 + dt.timedelta(days=i), "same") for i in range(30)]
    assert dedup.found(spark.createDataFrame(rows, SCHEMA)).count() == 29


def test_filters_that_are_mistaken_do_no_harm(spark, monkeypatch):
    """With hardly any bits every id looks repeated, and is verified bucket after bucket."""
    monkeypatch.setattr(dedup, "IDS_PER_WORD", 1000)
    rng = random.Random(8)
    rows = [(i, i // 40, T0 + dt.timedelta(minutes=rng.randrange(20000)), f"om_{rng.randrange(500)}") for i in range(1500)]
    assert {r[0] for r in dedup.found(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)
