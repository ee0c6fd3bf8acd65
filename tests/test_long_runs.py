"""Results and bytes moved where one run, or the number of runs, is large."""

from pyspark.sql import functions as F

from runloom.operators import sequence
from runloom.plans import reflection_queries


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_split_logged_compares_messages(spark):
    requests = [
        ("s", 1, "t", 0, 1, "b", True),  # a, then b
        ("s", 2, "t", 0, 3, "d", True),  # a b c: goes on
        ("s", 3, "t", 7, 5, "f", True),  # another log with a b c d e: goes on
        ("s", 4, "t", 9, 7, "h", True),  # a log that differs in its second message: new
        ("s", 5, "t", 9, 8, "i", False),  # failed
        ("s", 6, "t", 9, 8, "j", True),  # goes on from 4
        ("s", 7, "u", 9, 9, "k", True),  # other tools: new
        ("s", 8, "u", 9, 10, "l", True),  # its log has another reply than k: new
        ("s", 9, "u", 9, 0, "a", True),  # nothing: new
        ("s", 10, "u", 0, 1, None, True),  # a: goes on
        ("s", 11, "u", 5, 2, "x", True),  # a and a null: goes on
        ("s", 12, "u", 0, 99, "x", True),  # more than the log has: new
        ("s", 13, "u", 0, 3, "x", True),  # and none goes on with that
        (None, 1, None, 0, 0, "a", True),
        (None, 2, None, 0, 3, "d", True),  # goes on
    ]
    logs = {("s", 0): "abc", ("s", 7): "abcde", ("s", 9): "aXcdefgh" + "jz", (None, 0): "abc"}
    messages = [(s, log, i + 1, c) for (s, log), text in logs.items() for i, c in enumerate(text)] + [("s", 5, 1, "a"), ("s", 5, 2, None)]
    r = spark.createDataFrame(requests, "session_id string, seq long, tools string, log int, depth long, reply string, ok boolean")
    m = spark.createDataFrame(messages, "session_id string, log int, idx long, message string")
    got = {(x["session_id"], x["seq"]): x["trajectory"] for x in sequence.split_logged(r, m).collect()}
    assert [got[None, k] for k in (1, 2)] == [1, 1] and ("s", 5) not in got
    assert [got["s", k] for k in (1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13)] == [1, 1, 1, 2, 2, 3, 4, 5, 5, 5, 6, 7]

    # the same from histories in full
    text = {(s, log): [c for x, y, _, c in sorted(messages, key=lambda z: z[2]) if (x, y) == (s, log)] for s, log in {(x[0], x[1]) for x in messages}}
    whole = [(s, q, t, text[s, log][:n], reply, ok) for s, q, t, log, n, reply, ok in requests if n < 99]
    w = spark.createDataFrame(whole, "session_id string, seq long, tools string, history array<string>, reply string, ok boolean")
    full = {(x["session_id"], x["seq"]): x["trajectory"] for x in sequence.split_trajectories(w).collect()}
    assert all(full[k] == v for k, v in got.items() if k[0] is None or k[1] < 12)


def test_trajectories_of_a_long_run(spark, tmp_path):
    n = 6000
    t = spark.range(1, n + 1).select(F.col("id").alias("turn_id"), F.lit("r").alias("run_id"), F.col("id").cast("int").alias("step_idx"), F.when(F.col("id") <= n // 2, "a").otherwise("b").alias("source"), F.lit(0).alias("ingested_at"))
    t.write.parquet(f"{tmp_path}/turns.parquet")
    before = shuffled(spark)
    got = [x["trajectory"] for x in reflection_queries.trajectories(spark, str(tmp_path)).orderBy("seq").collect()]
    moved = shuffled(spark) - before
    want, last, k = [], None, 0
    for i in range(1, n + 1):
        depth, source = 0 if i % 5 == 0 else i, "a" if i <= n // 2 else "b"
        if i % 7 != 3:
            k += not (last and last[1] == source and depth >= last[0] + 1)
            want.append(k)
            last = (depth, source)
    assert got == want
    assert moved < 600 * n, moved  # a history in full has 3,000 messages on average
