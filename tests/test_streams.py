"""Streams give what their batch twins give, for late rows, rotated files and any cut into batches."""

import json
import random
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from runloom.operators import evaluation, monitor
from runloom.streaming import chats, files, in_order, sessions


def run_stream(spark, tmp_path, rows, schema, build, batches=4):
    """All rows of a stream over ``rows`` in ``batches`` files."""
    source = tmp_path / "in"
    for k in range(batches):
        part = rows[k::batches]
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(source / f"part={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(source))
    q = build(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.read.parquet(str(tmp_path / "out")).collect()


LISTINGS = {  # run: one dict {path: (size, mtime)} per scan
    "a": [{"run.log": (10, 1), "x.json": (5, 1)}, {"run.log": (25, 2), "x.json": (5, 1)}, {"run.log": (4, 3), "x.json": (6, 2)}, {"run.log": (4, 3), "new.txt": (1, 1)}],
    "b": [{}, {"verify.log": (7, 1)}, {}, {"verify.log": (9, 1)}],
    "c": [{"x": (1, 1)}, {"x": (1, 2)}],
}
WANT = {
    ("a", 0, "log_append", "run.log", 10, 0), ("a", 0, "created", "x.json", 5, None), ("a", 1, "log_append", "run.log", 25, 10), ("a", 2, "log_append", "run.log", 4, 0), ("a", 2, "modified", "x.json", 6, None),
    ("a", 3, "deleted", "x.json", 0, None), ("a", 3, "created", "new.txt", 1, None), ("b", 1, "log_append", "verify.log", 7, 0), ("b", 2, "deleted", "verify.log", 0, None), ("b", 3, "log_append", "verify.log", 9, 0),
    ("c", 0, "created", "x", 1, None), ("c", 1, "modified", "x", 1, None),
}


def test_file_events_in_batch(spark):
    rows = [(r, k, p, s, m) for r, scans in LISTINGS.items() for k, one in enumerate(scans) for p, (s, m) in one.items()]
    got = {tuple(r) for r in monitor.file_events(spark.createDataFrame(rows, "run_id string, scan int, path string, size long, mtime long")).collect()}
    assert got == WANT | {("c", 2, "run_removed", None, 0, None)}


@pytest.mark.parametrize("seed", [1, 2])
def test_file_events_on_a_stream_with_late_scans(spark, tmp_path, seed):
    rows = [(r, k, json.dumps(one)) for r, scans in LISTINGS.items() for k, one in enumerate(scans)]
    random.Random(seed).shuffle(rows)
    got = run_stream(spark, tmp_path, rows, "run_id string, scan long, files string", files.file_events)
    assert {tuple(r) for r in got} == WANT and len(got) == len(WANT)


def test_status_changes_on_a_stream(spark, tmp_path):
    states = {"a": ["queued", "running", "running", "verify"], "b": ["running", "completed"]}
    rows = [(r, k, s) for r, some in states.items() for k, s in enumerate(some)]
    want = {tuple(r) for r in monitor.status_changes(spark.createDataFrame(rows, "run_id string, scan int, status string")).collect()}
    assert want == {("a", 1, "running"), ("a", 3, "verify"), ("b", 0, "running"), ("b", 1, "completed")}
    got = run_stream(spark, tmp_path, rows[::-1], "run_id string, scan long, status string", files.status_changes)
    assert {tuple(r) for r in got} == want


def test_sessions_on_a_stream_with_late_events(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"s{i % 5}", i // 5 + 1, rng.choice(["request", "request", "complete", "abort", "finalize"])) for i in range(60)]
    want = {tuple(r) for r in sessions.states(spark.createDataFrame(rows, "session_id string, seq long, event string")).collect()}
    late = rows[:]
    rng.shuffle(late)
    got = run_stream(spark, tmp_path, late, "session_id string, seq long, event string", sessions.states)
    assert {tuple(r) for r in got} == want and len(got) == 60


def test_chat_memory_on_a_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"c{i % 3}", i // 3 + 1, rng.choice(["hi", "", None, "x"])) for i in range(45)]
    want = {tuple(r) for r in chats.memory(spark.createDataFrame(rows, "chat_id string, seq long, content string"), 4).collect()}
    rng.shuffle(rows)
    got = run_stream(spark, tmp_path, rows, "chat_id string, seq long, content string", lambda s: chats.memory(s, 4))
    assert {tuple(r) for r in got} == want and len(got) == 45


class State:
    """A key's state as Spark hands it to a worker."""

    def __init__(self):
        self.value, self.timer, self.hasTimedOut = None, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timer = ms


def test_a_session_that_waits_too_long():
    work = in_order.worker("session_id", "seq", chats.wait_step, {}, ["session_id", "outcome"], 1, 500, chats.wait_over)
    told = lambda state, *rows: [r for out in work(("s",), iter([pd.DataFrame(rows, columns=["session_id", "seq", "event"])] if rows else []), state) for r in out["outcome"]]
    stuck, done = State(), State()
    assert told(stuck, ("s", 1, "request"), ("s", 3, "complete")) == [] and stuck.timer == 500  # the third waits for the second
    assert told(done, ("s", 2, "complete")) == [] and told(done, ("s", 1, "request")) == ["completed"]
    stuck.hasTimedOut = done.hasTimedOut = True
    assert told(stuck) == ["timed_out"] and told(done) == [] and not stuck.exists and not done.exists


def test_seeds_are_those_of_zlib(spark):
    df = spark.createDataFrame([("r1", 3), ("r2", None)], "i string, s int")
    got = [r[0] for r in df.select(evaluation.seed(F.col("i"), F.col("s"))).collect()]
    assert got == [zlib.crc32(b"r1:3"), zlib.crc32(b"r2:0")]
