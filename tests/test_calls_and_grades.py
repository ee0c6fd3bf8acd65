"""Tool calls, tracebacks, rewards, stages and registries in cases that the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from runloom import registries
from runloom.functions import udf
from runloom.operators import evaluation, reflection, toolcalls

TOOLS = {"run": {"n": "integer", "x": "number", "on": "boolean", "o": "object", "s": "string"}, "any": {}}


def xml(*params, name="run"):
    return f"a<tool_call><function={name}>" + "".join(f"<parameter={k}>{v}</parameter>" for k, v in params) + "</function></tool_call>"


@pytest.mark.parametrize(
    "text,want",
    [
        (xml(("n", "\n7\n")), [("run", '{"n":7}', None)]), (xml(("n", "7.5")), [("run", None, "invalid_value")]), (xml(("x", "2.0"), ("on", "TRUE")), [("run", '{"x":2,"on":true}', None)]),
        (xml(("x", "1.5"), ("o", '{"b": [1]}')), [("run", '{"x":1.5,"o":{"b":[1]}}', None)]), (xml(("o", "{x")), [("run", None, "invalid_value")]), (xml(("on", "yes")), [("run", None, "invalid_value")]),
        (xml(("s", 'a "q"\nb'), ("s", "last")), [("run", '{"s":"last"}', None)]), (xml(("n", "NULL")), [("run", '{"n":null}', None)]), (xml(("zz", "1")), [("run", None, "unknown_parameter")]),
        (xml(("zz", "1"), name="any"), [("any", '{"zz":"1"}', None)]), (xml(name="no"), [("no", None, "unknown_function")]), ("<tool_call><function=run><parameter=n>3", [("run", '{"n":3}', None)]),
        ("<tool_call><function=run</tool_call>", [("run", None, "no_name")]), (xml(("n", "1")) + xml(("n", "2")), [("run", '{"n":1}', None), ("run", '{"n":2}', None)]), ("<tool_call></tool_call>", []), ("none", []), (None, []),
    ],
)
def test_xml_calls(spark, text, want):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    got = toolcalls.xml_calls(df, "id", "t", TOOLS).orderBy("call_no").collect()
    assert [(r["name"], r["arguments"], r["error"]) for r in got] == want


@pytest.mark.parametrize(
    "text,want",
    [
        ('<tool_call>{"name": "run", "arguments": "{\\"b\\": 1, \\"a\\": 2}"}</tool_call>', [("run", '{"a":2,"b":1}', None)]), ('<tool_call>{"name": "run"', [(None, None, "unclosed")]), ("<tool_call> </tool_call>", []),
        ("<tool_call>[1]</tool_call>", [(None, None, "not_object")]), ("<tool_call>{x}</tool_call>", [(None, None, "invalid_json")]), ('<tool_call>{"arguments": {}}</tool_call>', [(None, None, "no_name")]),
        ('<tool_call>{"name": 3}</tool_call>', [(None, None, "name_not_text")]), ('<tool_call>{"name": "no"}</tool_call>', [("no", None, "unknown_function")]), ('<tool_call>{"name": "any", "arguments": null}</tool_call>', [("any", "{}", None)]),
        ('<tool_call>{"name": "any", "arguments": "{"}</tool_call>', [("any", None, "invalid_arguments")]), ('<tool_call>{"name": "any", "arguments": [1]}</tool_call>', [("any", None, "arguments_not_object")]),
    ],
)
def test_hermes_calls(spark, text, want):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    got = toolcalls.hermes_calls(df, "id", "t", TOOLS).collect()
    assert [(r["name"], r["arguments"], r["error"]) for r in got] == want


def test_tracebacks():
    body = "==== FAILURES ====\n____ test_a ____\nE a\n\n____ test_b[1] ____\nE b\n==== short test summary info ====\n"
    summary = "FAILED t.py::test_a - x\nFAILED t.py::test_b[1] - y\n"
    assert evaluation.pair_tracebacks(body + summary) == {"t.py::test_a": "E a", "t.py::test_b[1]": "E b"}
    progress = "t.py::test_a FAILED   [ 50%]\nt.py::test_b[1] FAILED [100%]\n"
    assert evaluation.pair_tracebacks(progress + body) == {"t.py::test_a": "E a", "t.py::test_b[1]": "E b"}
    assert evaluation.pair_tracebacks(body + "FAILED t.py::test_a - x\n") is None
    assert evaluation.pair_tracebacks("all fine") == {} and evaluation.pair_tracebacks("") is None


def test_workdir_and_rewards(spark):
    df = spark.createDataFrame([("WORKDIR a\nWORKDIR b",), ("WORKDIR /x\nworkdir y/",), ("RUN x",), (None,)], "t string")
    assert [r[0] for r in df.select(evaluation.workdir(F.col("t"))).collect()] == ["/a/b", "/x/y", None, None]
    r = spark.createDataFrame([('{"reward": 0.5}', None), ('{"n": 1}', "1"), ("[1]", "1"), (None, "0.25"), (None, "x"), (None, None)], "j string, p string")
    got = [tuple(x[0]) for x in r.select(evaluation.reward(F.col("j"), F.col("p"))).collect()]
    assert got == [(0.5, None), (0.0, None), (0.0, "not_an_object"), (0.25, None), (0.0, "not_a_number"), (0.0, "no_file")]


def test_stages():
    last = {"id": "b", "user": "{prev} {turn}", "per": "turn", "parse": "hints"}
    reflection.check_stages([{"id": "a", "user": "{task}", "parse": "turns"}, last], {"task"}, {"turn"})
    for bad in ([], [{"id": "a", "user": "{task}", "parse": "text"}], [{"id": "a", "user": "{prev}", "parse": "hints"}], [{"id": "a", "user": "", "parse": "turns", "per": "turn"}, last], [{"id": "a", "user": "", "parse": "text", "edit": "delete_only"}, last]):
        with pytest.raises(ValueError):
            reflection.check_stages(bad, {"task"}, {"turn"})


def test_registries():
    g = registries.graders()
    assert g.get("strict") is g.register("strict", g.get("strict"))
    with pytest.raises(ValueError, match="taken"):
        g.register("strict", print)
    for some in (registries.tool_parsers(), registries.log_parsers(), registries.condensers(), registries.reflectors(), g):
        with pytest.raises(KeyError, match="there are"):
            some.get("nothing")


def test_closest_windows_and_corrections():
    assert udf.closest_window("one\n too", "zero\none\n  two\nx")[0] == "one\n  two"
    assert udf.closest_window("entirely other", "zero\none") is None
    assert udf.explain_edit("a\nb", "a", "a") == "same" and udf.explain_edit("a a", "a", "b") == "multiple" and udf.explain_edit("  a\n  b", "a\nb", "c") == "indent"
    assert udf.rebased("a\n  b", "a\nn\n  b", "  a\n    b") == "  a\n  n\n    b" and udf.rebased("a", "b", "a\nb") is None
    assert udf.hints_of('x {"1": "a"} END {"2": " b "}', "END") == {2: "b"} and udf.hints_of(None, "END") == {} and udf.steps_of("[1] [2, 3]", "T:") == [2, 3]
    assert udf.laid_over({"a": {"x": 1}, "b": 1}, {"a": {"y": 2}, "b": None}) == {"a": {"x": 1, "y": 2}, "b": None}
