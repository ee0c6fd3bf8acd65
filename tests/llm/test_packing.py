import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runloom.llm import pack_kernel, packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 256), st.integers(1, 3000), max_size=60))
def test_packing_holds_every_item_once(hist):
    p = pack_kernel.pack(hist, 256)
    got = Counter()
    for lengths, n, by in p:
        assert n > 0 and sum(x * c for x, c in lengths.items()) <= 256 and by <= sum(lengths.values())
        for x, c in lengths.items():
            got[x] += n * c
    assert got == Counter(hist)
    rows = pack_kernel.places(p)
    for length, n in hist.items():
        own = rows[rows[:, 0] == length]
        assert own[0, 1] == 0 and (own[1:, 1] > own[:-1, 1]).all() and own[-1, 1] < n


def test_fill_of_dense_histogram():
    hist = {k: 1000 for k in range(80, 1200)}
    p = pack_kernel.pack(hist, 4096)
    used, n = sum(k * v for k, v in hist.items()), sum(n for _, n, _ in p)
    assert used / (n * 4096) > 0.995
    assert sum(n * by for _, n, by in p) > 0.8 * sum(hist.values())


@pytest.mark.parametrize("capacity", [8192, 8191, 2048])
def test_patterns_place_most_items_whatever_the_parity(capacity):
    rng = random.Random(capacity)
    hist = Counter(min(capacity, max(1, int(rng.lognormvariate(6, 0.8)))) for _ in range(6000))
    p = pack_kernel.pack(hist, capacity)
    n = sum(n for _, n, _ in p)
    assert n <= 1.005 * -(-sum(k * v for k, v in hist.items()) // capacity)
    assert sum(n * by for _, n, by in p) > 0.8 * sum(hist.values())
    more = pack_kernel.places(pack_kernel.pack({k: 1000 * v for k, v in hist.items()}, capacity))
    assert len(more) < 4 * len(pack_kernel.places(p))  # with a thousand times the items


@pytest.mark.parametrize("rows", [1 << 20, 5])
def test_large_capacity_and_plans_sent_in_slices(spark, monkeypatch, rows):
    monkeypatch.setattr(packing, "PLAN_ROWS", rows)
    sizes = [9_000_000 + 17 * i for i in range(20)] + [(1 << 24) - 9_000_000 - 17 * i for i in range(20)] + [3 << 24]
    items = spark.createDataFrame([("r", i, n) for i, n in enumerate(sizes)], "run_id string, segment_index int, tokens long")
    out = packing.pack(items, spark.createDataFrame([("a", 1 << 24)], "container string, capacity int")).collect()
    fill = Counter()
    for r in out:
        fill[r["container_no"]] += r["tokens"]
    assert len(out) == 43 and len(fill) == 23 and set(fill.values()) == {1 << 24} and all(fill[r["container_no"]] == r["used"] for r in out)


def test_items_with_copies_and_long_ones(spark):
    rows = [("r", i % 50, (i % 50) * 7) for i in range(2000)] + [("long", 0, 700)] * 3
    items = spark.createDataFrame(rows, "run_id string, segment_index int, tokens long")
    out = packing.pack(items, spark.createDataFrame([("a", 300), ("b", 512)], "container string, capacity int")).collect()
    for kind, cap in (("a", 300), ("b", 512)):
        own = [r for r in out if r["container"] == kind]
        assert sum(r["tokens"] for r in own) == sum(r[2] for r in rows)
        fill = Counter()
        for r in own:
            fill[r["container_no"]] += r["tokens"]
        assert all(v <= cap for v in fill.values()) and all(fill[r["container_no"]] == r["used"] for r in own if r["tokens"])
        pieces = Counter((r["run_id"], r["segment_index"], r["piece"]) for r in own)
        assert pieces["r", 3, 0] == 40 and pieces["long", 0, 0] == 3
        assert max(r["piece"] for r in own if r["run_id"] == "r") == (1 if cap == 300 else 0)


def test_report_counts_items_that_patterns_placed(spark):
    rng = random.Random(3)
    sizes = [min(2048, max(1, int(rng.lognormvariate(6, 0.8)))) for _ in range(3000)]
    items = spark.createDataFrame([("r", i, n) for i, n in enumerate(sizes)], "run_id string, segment_index int, tokens long")
    report = packing.fill_report(packing.pack(items, spark.createDataFrame([("a", 2048)], "container string, capacity int"))).first()
    made = sum(n * by for _, n, by in pack_kernel.pack(Counter(sizes), 2048))
    assert report["items"] == 3000 and report["pattern_share"] == round(made / 3000, 6) > 0.8
