"""Test logs into states, states graded against expected sets, and what is reported of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.functions.text import normal_answer, strip_ansi
from runloom.operators.blocks import place, scan, unplace
from runloom.operators.order import with_index

# States and section markers of logs.
STATES = ("PASSED", "FAILED", "ERROR", "SKIPPED", "XFAIL")
START, END = ">>>>> Start Test Output", ">>>>> End Test Output"


def section(log: Column, lenient: bool = False) -> Column:
    """The text between the markers; without both of them null, or the whole log if lenient."""
    a, b = F.locate(START, log), F.locate(END, log)
    inner = F.substring(log, a + len(START), b - a - len(START))
    return F.when((a > 0) & (b > a), inner).otherwise(log if lenient else F.lit(None))


def lines_v1(line: Column) -> Column:
    """struct(test, status) of a line that begins with a state, else null; FAILED lines lose ' - ' between words."""
    x = F.when(line.startswith("FAILED"), F.replace(line, F.lit(" - "), F.lit(" "))).otherwise(line)
    parts = F.split(F.trim(x), r"\s+")
    begins = line.rlike("^(?:" + "|".join(STATES) + ")")
    return F.when(begins & (F.size(parts) >= 2), F.struct(F.get(parts, F.lit(1)).alias("test"), F.get(parts, F.lit(0)).alias("status")))


def lines_v2(line: Column) -> Column:
    """As v1 after control characters are gone, and lines that end with a state, behind the test's name."""
    x = F.regexp_replace(F.regexp_replace(line, r"\[(\d+)m", ""), "[\u0001-\u001f]", "")
    parts = F.split(F.trim(x), r"\s+")
    ends = x.rlike("(?:" + "|".join(STATES) + ")$")
    return F.coalesce(lines_v1(x), F.when(ends & (F.size(parts) >= 2), F.struct(F.get(parts, F.lit(0)).alias("test"), F.get(parts, F.lit(1)).alias("status"))))


LOG_PARSERS: dict[str, Callable[[Column], Column]] = {"v1": lines_v1, "v2": lines_v2}


def log_parser(name: str) -> Callable[[Column], Column]:
    if name not in LOG_PARSERS:
        raise KeyError(f"no log parser {name!r}; there are {sorted(LOG_PARSERS)}")
    return LOG_PARSERS[name]


def test_states(logs: DataFrame, keys: list[str], text: str, order: list[str], parser: str = "v1") -> DataFrame:
    """(keys, test, first_status, status): of each test in the logs of a key, by ``order`` and line. The last state wins."""
    rows = logs.select(*keys, *order, F.posexplode(F.split(strip_ansi(F.coalesce(F.col(text), F.lit(""))), "\n", -1)).alias("line_no", "line"))
    rows = rows.withColumn("s", log_parser(parser)(F.col("line"))).where("s is not null")
    at = F.struct(*order, "line_no")
    return rows.groupBy(*keys, F.col("s.test").alias("test")).agg(F.min_by("s.status", at).alias("first_status"), F.max_by("s.status", at).alias("status"))


def fold_status(x: Column) -> Column:
    return F.when(F.lower(x).contains("pass"), "pass").when(F.lower(x).contains("skip"), "skip").otherwise("fail")


def grade_strict(expected: DataFrame, observed: DataFrame, key: str = "run_id") -> DataFrame:
    """Per key: passes and failures of both kinds (F2P, P2P). A missing test fails; resolved if there is a F2P test and none fails."""
    e = expected.select(key, "kind", "test").distinct().join(observed.select(key, "test", "status"), [key, "test"], "left")
    ok = F.coalesce(F.col("status") == "PASSED", F.lit(False))
    n = lambda kind, good: F.count_if((F.col("kind") == kind) & (ok if good else ~ok))
    out = e.groupBy(key).agg(n("F2P", True).alias("f2p_passed"), n("F2P", False).alias("f2p_failed"), n("P2P", True).alias("p2p_passed"), n("P2P", False).alias("p2p_failed"))
    return out.withColumn("resolved", (F.col("f2p_passed") > 0) & (F.col("f2p_failed") == 0) & (F.col("p2p_failed") == 0))


def grade_lenient(expected: DataFrame, observed: DataFrame, key: str = "run_id") -> DataFrame:
    """As strict, but a test that was not observed counts on neither side."""
    seen = expected.select(key, "kind", "test").distinct().join(observed.select(key, "test", "status"), [key, "test"], "inner")
    ok = fold_status(F.col("status")) == "pass"
    bad = fold_status(F.col("status")) == "fail"
    n = lambda kind, x: F.count_if((F.col("kind") == kind) & x)
    out = seen.groupBy(key).agg(n("F2P", ok).alias("f2p_passed"), n("F2P", bad).alias("f2p_failed"), n("P2P", ok).alias("p2p_passed"), n("P2P", bad).alias("p2p_failed"))
    return out.withColumn("resolved", (F.col("f2p_passed") > 0) & (F.col("f2p_failed") == 0) & (F.col("p2p_failed") == 0))


def grade_exact(wanted: DataFrame, observed: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, tests, equal): whether both sides hold the same tests with the same states. Keys of either side count."""
    w = wanted.select(key, "test", F.col("status").alias("want"))
    o = observed.select(key, "test", F.col("status").alias("got"))
    return w.join(o, [key, "test"], "full_outer").groupBy(key).agg(F.count("*").alias("tests"), F.every(F.coalesce(F.col("want") == F.col("got"), F.lit(False))).alias("equal"))


GRADERS = {"strict": grade_strict, "lenient": grade_lenient, "exact": grade_exact}


def grader(name: str):
    if name not in GRADERS:
        raise KeyError(f"no grader {name!r}; there are {sorted(GRADERS)}")
    return GRADERS[name]


def register(registry: dict, name: str, f: Callable) -> None:
    """Add a parser or grader; another one under the same name is an error."""
    if registry.get(name, f) is not f:
        raise ValueError(f"{name!r} is taken")
    registry[name] = f


def verify_summary(results: DataFrame) -> DataFrame:
    """One row of results (resolved, completed, seconds): totals, wrong answers, time-outs, rate in percent, mean seconds."""
    r = F.coalesce("resolved", F.lit(False))
    done = F.coalesce("completed", F.lit(False))
    out = results.agg(F.count("*").alias("total"), F.count_if(r).alias("resolved"), F.count_if(~r & done).alias("wrong_answer"), F.count_if(~r & ~done).alias("time_limit"), F.round(F.coalesce(F.avg("seconds"), F.lit(0.0)), 6).alias("mean_seconds"))
    return out.withColumn("rate", F.round(F.when(F.col("total") > 0, 100.0 * F.col("resolved") / F.col("total")).otherwise(0.0), 6))


def clip_failures(states: DataFrame, key: str = "run_id", most: int = 5) -> DataFrame:
    """(key, failing, shown, omitted): the first failing tests by name and how many more there are."""
    f = states.where("status in ('FAILED', 'ERROR')")
    first = f.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy("test"))).where(F.col("rn") <= most)
    named = first.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("test")), ",").alias("shown"))
    n = f.groupBy(key).agg(F.count("*").alias("failing"))
    return n.join(named, key).select(key, "failing", "shown", F.greatest(F.col("failing") - most, F.lit(0)).cast("long").alias("omitted"))


def diff_files(text: Column) -> Column:
    """Files that a diff writes, in order, once each: '+++ ' lines up to a tab, without b/ and /dev/null."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.startswith("+++ "))
    names = F.transform(lines, lambda x: F.regexp_replace(F.substring_index(F.substring(x, F.lit(5), F.length(x)), "\t", 1), "^b/", ""))
    return F.array_distinct(F.filter(names, lambda x: x != "/dev/null"))


def exact_match(prediction: Column, targets: Column) -> Column:
    """1.0 if any target equals the prediction after normalization; 0.0 for null, or without targets."""
    return F.when(F.coalesce(F.exists(targets, lambda g: normal_answer(g) == normal_answer(prediction)), F.lit(False)), 1.0).otherwise(0.0)


def round_robin(df: DataFrame, group: str, order: str) -> DataFrame:
    """``df`` with pick: its place when groups are asked in turn, each for its next row. ``order`` is a number."""
    rn = unplace(scan(place(df, [group], order, 1 << 16), [order], sums={"rn": F.lit(1).cast("long")}))
    return with_index(rn, "rn", group, name="pick").drop("rn")


def greedy_budget(blocks: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Blocks of each key in order, a number, up to the first that does not fit the budget."""
    so_far = unplace(scan(place(blocks, [key], order, 1 << 16), [order], sums={"used": F.col(size).cast("long")}))
    return so_far.where(F.col("used") <= budget)


def search_score(prediction: Column, targets: Column) -> Column:
    return F.when(prediction.isNull() | (F.coalesce(F.size(targets), F.lit(0)) <= 0), 0.0).otherwise(exact_match(prediction, targets))


def reward_value(json_text: Column, plain: Column) -> Column:
    """A reward from a JSON object's field, else from a plain number, else 0."""
    return F.coalesce(F.get_json_object(json_text, "$.reward").try_cast("double"), F.trim(plain).try_cast("double"), F.lit(0.0))


def answers(turns: DataFrame, calls: DataFrame, argument: str = "answer", finishing: tuple[str, ...] = ("finish", "submit"), key: str = "run_id") -> DataFrame:
    """(run_id, answer) of runs that answered: over finished steps from the last, the argument of the response's first JSON call,
    else what the step's last good finishing call showed, blanks at its ends apart; steps that give neither are passed over.

    A call's arguments may stand under arguments or parameters, and be JSON text themselves."""
    done = turns.where("exit_reason = 'finished'")
    block = F.trim(F.regexp_extract("response", r"(?s)<tool_call>(.*?)</tool_call>", 1))
    v = F.try_parse_json(block)
    given = F.coalesce(F.try_variant_get(v, "$.arguments", "variant"), F.try_variant_get(v, "$.parameters", "variant"))
    text = F.try_parse_json(F.try_variant_get(given, "$", "string"))
    said = F.coalesce(F.try_variant_get(given, f"$.{argument}", "string"), F.try_variant_get(text, f"$.{argument}", "string"))
    shown = calls.where(F.col("tool_name").isin(*finishing) & (F.col("status") == "ok")).groupBy(key, "step_idx").agg(F.max_by(F.trim("observation"), F.struct("call_idx", "call_id")).alias("shown"))
    a = done.select(key, "step_idx", "turn_id", said.alias("said")).join(shown, [key, "step_idx"], "left")
    a = a.select(key, "step_idx", "turn_id", F.coalesce("said", F.nullif("shown", F.lit(""))).alias("answer")).where("answer is not null")
    return a.groupBy(key).agg(F.max_by("answer", F.struct("step_idx", "turn_id")).alias("answer"))
