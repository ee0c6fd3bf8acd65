import itertools
import random

import pytest

from runloom.llm import event_runs
from runloom.llm.run_kernel import agglomerate, canonical, similarity

SAME = [
    ("sed  -n '1,2p' a.py", 'sed -n "1,2p" a.py\n'), ("git diff -- a  # attempt 2", "git diff -- a"), ("find x ;", "find x"), ("", None), ("  ", "\n"),
    ("search --query 'a b' --topk 3", 'search --topk 3 --query "a b"'), ("curl -s 'http://h/x?ts=1770600781'", "curl -s 'http://h/x?ts=1774307371'"), ("cat ./a", "cat a"),
    ("t > /tmp/out_4e6f75.txt 2>&1; tail /tmp/out_4e6f75.txt", "t > /tmp/out_092971.txt 2>&1; tail /tmp/out_092971.txt"), ("p --started-at 2026-04-21T16:52:25Z", "p --started-at 2026-02-22T17:24:41Z  # 06:43:24"),
]
OTHER = [("cat a1.py", "cat a2.py"), ("sed -n '1,2p' a", "sed -n '3,4p' a"), ("head -n 5", "head -n 10"), ("v --view_range '[1, 2]'", "v --view_range '[3, 4]'"), ("a | b", "a ; b"), ("grep 'a b'", "grep a b"), ("echo '# x'", "echo")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other(a, b):
    assert canonical(a) != canonical(b)


def test_most_similar_first():
    actions = [(canonical(a), a) for a in ("a b c", "a b d", "a b d", "x y z")]
    assert agglomerate([0] * 4, actions, [0] * 4, [0] * 4, 0.6, None) == [(0, 2), (3, 3)]
    assert agglomerate([0, 0, 1, 0], actions, [0] * 4, [0] * 4, 0.6, None) == [(0, 1), (2, 2), (3, 3)]
    assert agglomerate([0] * 3, [actions[0]] * 3, [0, 10, 100], [1, 11, 101], 1.0, 20) == [(0, 1), (2, 2)]
    # the closest pair goes first: then the third is compared with the second's action no more
    chain = [(canonical(a), a) for a in ("p q r s", "p q r t", "p q u t")]
    assert agglomerate([0] * 3, chain, [0] * 3, [0] * 3, 0.7, None) == [(0, 1), (2, 2)]


def test_similarity_ranks_equal_spelled_otherwise_and_other():
    of = lambda a: (canonical(a), a or "")
    assert similarity(of(""), of(None)) == 1.0 == similarity(of("a b"), of("a b"))
    for a, b in SAME:
        assert event_runs.kernel.SAME <= similarity(of(a), of(b)) <= 1.0
    for a, b in OTHER:
        assert similarity(of(a), of(b)) < event_runs.kernel.SAME
    assert similarity(of("cat 'a' b c"), of('cat "a" b c')) > similarity(of("cat 'a' 'b' c"), of('cat "a" "b" c'))


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_any_partitioning_gives_the_plain_grouping(spark, parts):
    rng = random.Random(int(parts))
    rows, n = [], 0
    for run in ["hot"] * 6 + ["a", "b", None]:
        for _ in range(60):
            action, status = rng.choice(["x", "x ", "y"]), rng.choice(["ok", "ok", "ok", "timeout"])
            rows += [(n, run, n // 3, n % 3, "t", action, status)] * rng.choice([1, 1, 1, 2])
            n += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "call_id long, run_id string, step_idx int, call_idx int, tool_name string, action string, status string").selectExpr("*", "cast(null as timestamp_ntz) as started_at", "cast(null as double) as execution_time")
    want = set()
    once = sorted({r for r in rows if r[1]}, key=lambda r: (r[1], r[2], r[3]))
    for _, g in itertools.groupby(once, key=lambda r: (r[1], r[5].strip(), r[6])):
        g = list(g)
        want.add((g[0][1], g[0][0], g[-1][0], len(g)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(r["run_id"], r["first_call_id"], r["last_call_id"], r["calls"]) for r in event_runs.collapse(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("batch", [2, 10_000])
def test_nearly_equal_calls_merge_whatever_the_batches_and_partitions(spark, partitions, batch):
    rows = [("r", i, 0, i, "sh", f"grep -n word file{i % 3 if i < 60 else 0} dir", "ok" if i != 90 else "bad", None, 0.5) for i in range(120)]
    df = spark.createDataFrame([*rows, rows[5]], "run_id string, step_idx int, call_idx int, call_id long, tool_name string, action string, status string, started_at timestamp, execution_time double")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = sorted((r["first_call_id"], r["last_call_id"], r["calls"]) for r in event_runs.collapse(df, 0.7).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == [(0, 89, 90), (90, 90, 1), (91, 119, 29)]


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_any_partitioning_gives_the_list_over_the_whole_run(spark, partitions):
    """Similarities below the same action, gaps, and one run that holds nearly all rows."""
    rng = random.Random(11)
    rows = []
    for i in range(900):
        action = " ".join(rng.choice("ab") for _ in range(4))
        rows.append(("hot" if i < 800 else f"r{i % 7}", i, 0, i, "t", action, "ok" if rng.random() < 0.97 else "bad", 10 * i + rng.choice([0, 0, 0, 500]), 1.0))
    names = "run_id string, step_idx int, call_idx int, call_id long, tool_name string, action string, status string, t long, execution_time double"
    df = spark.createDataFrame(rows, names).selectExpr("*", "cast(timestamp_seconds(t) as timestamp_ntz) as started_at")
    want = set()
    for run, g in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1])), key=lambda r: r[0]):
        g = list(g)
        found = agglomerate([(r[4], r[6]) for r in g], [(canonical(r[5]), r[5]) for r in g], [r[7] for r in g], [r[7] + 1 for r in g], 0.7, 300)
        want |= {(run, g[a][3], g[b][3], b - a + 1) for a, b in found}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {(r["run_id"], r["first_call_id"], r["last_call_id"], r["calls"]) for r in event_runs.collapse(df, 0.7, 300.0).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want
