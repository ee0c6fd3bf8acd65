"""Literal cases of the reference's operators."""

import pytest
from pyspark.sql import functions as F

from runloom.functions import text as T
from runloom.operators import grading, messages, monitor, retrieval, sequence
from runloom.operators.order import with_index
from runloom.plans import registry
from runloom.streaming import sessions


def one(spark, column, value=None, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(column).first()[0]


@pytest.mark.parametrize("f,x,want", [
    (T.xml_escape, "<a & 'b'>", "&lt;a &amp; &apos;b&apos;&gt;"), (T.shell_quote, "a'b c", "'a'\"'\"'b c'"), (T.shell_quote, "", "''"), (T.shell_quote, "a/b", "a/b"),
    (T.file_name, "__a b__", "a_b"), (T.file_name, "é", "default"), (T.normal_answer, "The Eiffel  Tower.", "eiffel tower"), (T.normal_answer, "a.m.", "m"),
    (T.number_lines, "a\nb", "     1\ta\n     2\tb"), (T.current_step, "STEP 1\nSTEP  7", 7), (T.current_step, "none", None), (lambda c: T.clip(c, 2), "abc", "ab..."),
    (lambda c: T.clip_middle(c, 4), "abcdef", "ab\n[... 2 characters elided ...]\nef"), (lambda c: T.shift_indent(c, -4), "    a()\n    b()", "a()\nb()"), (T.finish_reason, None, "stop"), (T.finish_reason, "max_tokens", "length"),
    (lambda c: T.count_matches(c, "AA"), "aaaaa", 2), (T.strip_ansi, "\x1b[31mx\x1b[0m\r", "x"), (lambda c: T.action_mask(c, ["old"]), "<parameter=old>\nx\n</parameter>", "<parameter=old><MASKED></parameter>"),
])
def test_text(spark, f, x, want):
    assert one(spark, f(F.col("x")), x) == want


LOG = "PASSED a::t1\nFAILED a::t2 - boom\nPASSED\nFAILED a::t1\nSKIPPED a::t4\na::t3 PASSED"


def test_log_parsers(spark):
    df = spark.createDataFrame([("r", 1, LOG)], "run_id string, o int, log string")
    v1 = {r["test"]: (r["first_status"], r["status"]) for r in grading.test_states(df, ["run_id"], "log", ["o"]).collect()}
    assert v1 == {"a::t1": ("PASSED", "FAILED"), "a::t2": ("FAILED", "FAILED"), "a::t4": ("SKIPPED", "SKIPPED")}
    v2 = {r["test"] for r in grading.test_states(df, ["run_id"], "log", ["o"], "v2").collect()}
    assert v2 == {*v1, "a::t3"}
    with pytest.raises(KeyError):
        grading.log_parser("none")


def test_graders_differ_on_missing_tests(spark):
    e = spark.createDataFrame([("r", "F2P", "a"), ("r", "F2P", "a"), ("r", "F2P", "gone"), ("r", "P2P", "b")], "run_id string, kind string, test string")
    o = spark.createDataFrame([("r", "a", "PASSED"), ("r", "b", "PASSED")], "run_id string, test string, status string")
    assert not grading.grade_strict(e, o).first()["resolved"]
    assert grading.grade_lenient(e, o).first()["resolved"]
    assert not grading.grade_exact(e.withColumn("status", F.lit("PASSED")), o).first()["equal"]


def test_section_and_diff(spark):
    log = f"x{grading.START}in{grading.END}y"
    assert one(spark, grading.section(F.col("x")), log) == "in"
    assert one(spark, grading.section(F.col("x")), "no") is None
    assert one(spark, grading.diff_files(F.col("x")), "+++ b/x\n+++ /dev/null\n+++ b/y\tdate\n+++ b/x") == ["x", "y"]


def test_exact_match(spark):
    df = spark.createDataFrame([("The Eiffel Tower.", ["eiffel tower"]), ("x", []), (None, ["x"])], "p string, g array<string>")
    assert [r[0] for r in df.select(grading.exact_match(F.col("p"), F.col("g"))).collect()] == [1.0, 0.0, 0.0]


def calls(spark, rows):
    return spark.createDataFrame([(r[0], r[1], 0, i, r[2], r[3], r[4] if len(r) > 4 else "ok") for i, r in enumerate(rows)], "run_id string, step_idx int, call_idx int, call_id long, tool_name string, action string, status string")


def test_loops(spark):
    df = calls(spark, [("r", 0, "slow", "a"), ("r", 1, "f", "b  c"), ("r", 2, "slow", "a"), ("r", 3, "f", "b\nc"), ("r", 4, "f", "b c"), ("r", 6, "slow", "a"), ("q", 1, "f", "x")])
    assert [tuple(r) for r in sequence.first_loop(df).collect()] == [("r", "f b c", 1, 4)]


def test_stuck(spark):
    rows = [("r", i, "t", a) for i, a in enumerate(["x", "", "x", None, "x", "y"])]
    assert [tuple(r) for r in sequence.stuck(calls(spark, rows), "action", 3).collect()] == [("r", 3)]
    assert sequence.stuck(calls(spark, rows), "action", 0).count() == 0


def test_condense(spark):
    rows = [("c", 0, "system", "s"), ("c", 1, "user", "task"), ("c", 2, "tool", "a" * 100), ("c", 3, "assistant", "b"), ("c", 4, "tool", "c" * 100), ("c", 5, "tool", "d" * 100)]
    m = spark.createDataFrame(rows, "conv_id string, idx long, role string, content string")
    out = {r["idx"]: r for r in sequence.condense(m, 40, 5000, 2, 2).collect()}
    assert out[2]["masked"] and not out[4]["masked"] and not out[2]["unmet"]
    assert all(r["unmet"] for r in sequence.condense(m, 10**6, 5000, 2, 0).collect())
    short = {r["idx"]: r["content"] for r in sequence.condense(m, 0, 20, 2, 0).collect()}
    assert short[4].startswith("c" * 10) and sequence.CLIP_MARK in short[4] and short[1] == "task"


def test_compact(spark):
    rows = [("c", i, r, "x" * 40) for i, r in enumerate(["system", "assistant", "user", "assistant", "user", "assistant"])] + [("n", 0, "assistant", "y" * 400)]
    m = spark.createDataFrame(rows, "conv_id string, idx long, role string, content string")
    kept = {(r["conv_id"], r["idx"]) for r in sequence.compact(m, 20, 30).collect()}
    assert kept == {("c", 0), ("c", 4), ("c", 5), ("n", 0)}


def test_split_trajectories(spark):
    rows = [("s", 1, "t", ["a"], "b", True), ("s", 2, "t", ["a", "b", "c"], "d", True), ("s", 3, "t", ["x"], "y", False), ("s", 4, "u", ["a", "b", "c", "d"], "e", True), ("s", 5, "u", ["z"], "y", True)]
    df = spark.createDataFrame(rows, "session_id string, seq long, tools string, history array<string>, reply string, ok boolean")
    assert [r["trajectory"] for r in sequence.split_trajectories(df).orderBy("seq").collect()] == [1, 1, 2, 3]


def test_topk_and_order(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i in range(6)] + [(9, None)], "id long, v array<float>")
    got = [(r["vec_id"], r["rank"]) for r in retrieval.exact_topk(v.where("id = 4"), v, 2).orderBy("rank").collect()]
    assert got == [(3, 1), (4, 2)]
    ix = with_index(spark.range(1000).withColumn("k", -F.col("id")), "k").orderBy("k").collect()
    assert [r["index"] for r in ix] == list(range(1000))


def test_canonical_json(spark):
    f = lambda x: one(spark, messages.canonical(F.col("x")), x)
    assert f('{"b":2,"a":1}') == f('{"a": 1, "b": 2}')
    assert f("{b: 2, a: 1}") != f("{a: 1, b: 2}")


def test_changes(spark):
    s = "run_id string, path string, size long, mtime_ns long"
    a = spark.createDataFrame([("r", "x", 1, 1), ("r", "y", 1, 1), ("r", "z", 1, 1)], s)
    b = spark.createDataFrame([("r", "x", 1, 1), ("r", "y", 2, 1), ("r", "n", 1, 1)], s)
    assert {(r["path"], r["change"]) for r in monitor.changes(a, b).collect()} == {("y", "modified"), ("z", "deleted"), ("n", "created")}


EVENTS = [("a", 1, "request"), ("a", 2, "complete"), ("a", 3, "request"), ("a", 4, "complete"), ("a", 5, "finalize"), ("a", 6, "finalize"), ("b", 1, "abort"), ("b", 2, "abort"), ("b", 3, "complete")]


def test_session_states_batch_and_stream(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, "session_id string, seq long, event string")
    want = {(s, *r) for s in "ab" for r in sessions.fold("active", [(q, e) for k, q, e in EVENTS if k == s])[1]}
    assert {tuple(r) for r in sessions.states(df).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sessions.states(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("phases").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("phases").collect()} == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_kmeans_index_recall(spark, sf):
    found, want = ({(r["query_id"], r["vec_id"]) for r in registry()[0][name](spark, f"/root/testdata/{sf}").collect()} for name in ("ivf_kmeans", "exact_topk"))
    assert len(found & want) >= 0.9 * len(want)


def test_every_titled_document_is_scored(spark):
    d = "/root/testdata/sf0.01"
    titled = {r[0] for r in spark.read.parquet(f"{d}/documents.parquet").where("title is not null").select("doc_id").collect()}
    got = {r["doc_id"]: r["score"] for r in registry()[0]["exact_match"](spark, d).collect()}
    assert got.keys() == titled
