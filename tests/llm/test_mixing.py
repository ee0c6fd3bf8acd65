import math
import random

import numpy as np
import pytest

from runloom.llm import mixing
from runloom.llm.queries import TOKENIZER


def test_thresholds_invert_the_distribution():
    u = (np.arange(100_000) + 0.5) / 100_000
    n = np.searchsorted(np.asarray(mixing.thresholds(1.7, 50)), u, "right")
    assert abs(n.mean() - 1.7) < 0.01 and abs(n.var() - 1.7) < 0.02
    assert mixing.thresholds(math.inf, 3) == [0.0] * 3


def test_large_rates_and_caps():
    u = (np.arange(4096) + 0.5) / 4096
    tokens = np.ones(4096)
    for want, cap in ((900.0, 2000), (1500.0, 1600), (5.5, 6)):
        rate = mixing.solve(want * 4096, u, tokens, cap)
        n = np.searchsorted(np.asarray(mixing.thresholds(rate, cap)), u, "right")
        assert n.max() <= cap and n.mean() == pytest.approx(want, rel=0.01)


def test_draws_do_not_depend_on_the_number_of_targets(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 9), "ab"[i % 2]) for i in range(3000)], "doc_id long, text string, source string")
    few = [("a", 0.3, 2), ("b", 0.3, 2)]
    many = few + [(f"t{i}", 0.4 / 4000, 2) for i in range(4000)]
    drawn = []
    for goals in (few, many):
        made = mixing.plan(mixing.count_tokens(docs, TOKENIZER), spark.createDataFrame(goals, "source string, target_share double, max_repeats int"))
        for p in made:
            p["thresholds"] = mixing.thresholds(0.8, 2)
        drawn.append({(r[0], r[1]) for r in mixing._drawn(docs, made, 0).where("source in ('a', 'b')").select("doc_id", "repeats").collect()})
    assert drawn[0] == drawn[1]


def test_shares_and_caps(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(["word"] * rng.randrange(5, 60)), rng.choice("aaaaabbc")) for i in range(4000)] + [(9000, None, "a"), (9001, "x", None), (9002, "x", "other")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 2), ("c", 0.3, 3), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r for r in mixing.shares(d, t, TOKENIZER).collect()}
    for s, share in (("a", 0.5), ("b", 0.2), ("c", 0.3)):
        assert got[s]["actual_share"] == pytest.approx(share, abs=0.003)
    rows = mixing.mix(d, t, TOKENIZER).select("doc_id", "source", "copy").collect()
    assert len(rows) == sum(r["copies"] for r in got.values()) and len({(r[0], r[2]) for r in rows}) == len(rows)
    assert max(r["copy"] for r in rows if r["source"] == "c") == 2 and max(r["copy"] for r in rows if r["source"] == "a") == 0
    assert {r["source"] for r in rows} == {"a", "b", "c"}
    assert [r[0] for r in rows] != sorted(r[0] for r in rows)
