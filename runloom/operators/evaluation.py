"""Evaluation runs: sections of logs, rewards, tracebacks, what is told of failures, summaries."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.functions.text import NOTES, clip_middle, fill
from runloom.operators import grading
from runloom.operators.blocks import place, scan
from runloom.operators.grading import END, START
from runloom.shipping import by_value

by_value(sys.modules[__name__])

# What a log says when collection broke off, and lines that name a broken file.
ABORTED = r"Interrupted:\s*\d+\s*errors?\s+during collection"
BROKEN_FILE = r"(?m)^ERROR\s+(\S+)\s+-\s+(.+)$"
ABORT_DEFAULT = "a module failed to import during collection"


def collection_abort(log: Column, most: int = 3) -> Column:
    """Why no test ran: the first broken files as ``file (reason)``, joined by '; '; a default text without any; null if tests ran."""
    files, reasons = (F.regexp_extract_all(log, F.lit(BROKEN_FILE), F.lit(g)) for g in (1, 2))
    told = F.slice(F.zip_with(files, reasons, lambda f, r: F.concat(f, F.lit(" ("), F.trim(r), F.lit(")"))), F.lit(1), F.lit(most))
    return F.when(F.coalesce(log, F.lit("")).rlike(ABORTED), F.when(F.size(told) > 0, F.array_join(told, "; ")).otherwise(ABORT_DEFAULT))


def lenient_states(logs: DataFrame, key: str, text: str, parser: str = "v1") -> DataFrame:
    """(key, test, status) of each log's section between the markers, of the whole log where there are no markers or nothing
    between them. Logs without any state have no row."""
    inner = grading.test_states(logs.select(key, grading.section(F.col(text), True).alias("t")), [key], "t", [key], parser)
    rest = logs.select(key, text).join(inner.select(key).distinct(), key, "left_anti")
    whole = grading.test_states(rest, [key], text, [key], parser)
    return inner.unionByName(whole).select(key, "test", "status")


def grade_exact_names(wanted: DataFrame, observed: DataFrame, key: str = "run_id") -> DataFrame:
    """As ``grade_exact`` over names cut at ' - '; where several become one, the last by its whole name counts. A blank name has to be there, whatever its state."""
    cut = F.substring_index("test", " - ", 1)
    short = lambda df, name: df.groupBy(key, cut.alias("test_name")).agg(F.max_by("status", "test").alias(name), F.lit(1).alias(f"has_{name}"))
    both = short(wanted, "want").join(short(observed, "got"), [key, "test_name"], "full_outer")
    same = (F.col("want") == F.col("got")) | ((F.col("test_name") == "") & F.col("has_want").isNotNull() & F.col("has_got").isNotNull())
    n = lambda c: F.count(F.col(f"has_{c}"))
    return both.groupBy(key).agg(n("want").alias("wanted"), n("got").alias("observed"), F.every(F.coalesce(same, F.lit(False))).alias("equal"))


def grade_listed(tasks: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """``grade_strict`` of tasks (key, f2p, p2p) whose expected tests are JSON lists; a test that was not observed fails."""
    listed = lambda c, kind: tasks.select(key, F.lit(kind).alias("kind"), F.explode(F.from_json(c, "array<string>")).alias("test"))
    return grading.grade_strict(listed("f2p", "F2P").unionByName(listed("p2p", "P2P")), observed, key)


def reward(json_text: Column, plain: Column) -> Column:
    """struct(reward, error): of a JSON file, if there is one, the field reward (none: 0); else of a plain number. A JSON file that
    holds no object, a text that is no number and no file at all give 0 and an error."""
    v = F.try_parse_json(json_text)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    from_json, from_text = F.coalesce(F.try_variant_get(v, "$.reward", "double"), F.lit(0.0)), F.trim(plain).try_cast("double")
    error = F.when(json_text.isNotNull() & ~is_object, "not_an_object").when(json_text.isNull() & plain.isNotNull() & from_text.isNull(), "not_a_number").when(json_text.isNull() & plain.isNull(), "no_file")
    return F.struct(F.when(error.isNotNull(), 0.0).when(json_text.isNotNull(), from_json).otherwise(from_text).alias("reward"), error.alias("error"))


def workdir(dockerfile: Column) -> Column:
    """The last working folder of a Dockerfile: absolute ones replace, relative ones go below the one before (first: below /). Null without any."""
    lines = F.transform(F.split(dockerfile, r"\r?\n", -1), lambda x: F.trim(x))
    said = F.transform(F.filter(lines, lambda x: x.rlike(r"(?i)^workdir ")), lambda x: F.regexp_replace(x, r"(?i)^workdir\s+", ""))
    below = lambda a: F.when(F.coalesce(a, F.lit("/")).endswith("/"), F.coalesce(a, F.lit("/"))).otherwise(F.concat(a, F.lit("/")))
    folded = F.aggregate(said, F.lit(None).cast("string"), lambda a, x: F.when(x.startswith("/"), x).otherwise(F.concat(below(a), x)))
    return F.when(F.length(folded) > 1, F.regexp_replace(folded, "/+$", "")).otherwise(folded)


def seed(instance: Column, step: Column) -> Column:
    """The number that a task's shuffles start from: crc32 of ``instance:step``, step 0 if missing."""
    return F.crc32(F.concat(instance, F.lit(":"), F.coalesce(step, F.lit(0)).cast("string")).cast("binary"))


# The rules, heads, progress lines and summary lines of a test runner's log.
_RULE = re.compile(r"=+ .+ =+\s*$")
_HEAD = re.compile(r"_{4,} (.+?) _{4,}$")
_PROGRESS = re.compile(r"(\S.*?::.+?)[ \t]+(PASSED|FAILED|ERROR|SKIPPED|XFAIL|XPASS)\b.*\[\s*\d+%\][ \t]*$")
_SUMMARY = re.compile(r"(FAILED|ERROR) (.+?)(?: - .*)?$")


def pair_tracebacks(log: str | None) -> dict[str, str] | None:
    """{test: traceback} of a log, in order: bodies below ``____ name ____`` heads of the ERRORS and FAILURES parts, paired by
    place with the tests that progress lines name, or with those of the summary if that is how many there are. None if
    neither fits, or for an empty log."""
    if not log:
        return None
    begins = log.find(START)
    ends = log.find(END, begins + len(START)) if begins >= 0 else -1
    lines = (log[begins + len(START) : ends] if ends >= 0 else log).split("\n")
    out: dict[str, str] = {}
    for banner, state in (("ERRORS", "ERROR"), ("FAILURES", "FAILED")):
        bodies: list[list[str]] = []
        begin = next((i for i, x in enumerate(lines) if re.fullmatch(rf"=+ {banner} =+\s*", x)), None)
        if begin is not None:
            for x in lines[begin + 1 :]:
                if _RULE.match(x):
                    break
                if _HEAD.fullmatch(x):
                    bodies.append([])
                elif bodies:
                    bodies[-1].append(x)
        progress = [m[1] for x in lines if (m := _PROGRESS.fullmatch(x)) and m[2] == state]
        named = progress if len(progress) == len(bodies) else [m[2] for x in lines if (m := _SUMMARY.fullmatch(x)) and m[1] == state]
        if len(named) != len(bodies):
            return None
        out |= {n: "\n".join(body).strip() for n, body in zip(named, bodies)}
    return out


def tracebacks(logs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, test, traceback) of every log whose bodies and tests pair; one row with test null where they don't; none for logs without bodies."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for at, log in enumerate(b.column(1).to_pylist()):
                found = pair_tracebacks(log)
                for no, (test, body) in enumerate([(None, None)] if found is None else found.items()):
                    for column, v in zip(rows, (at, no, test, body)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.string())], names=[key, "no", "test", "traceback"])

    return logs.select(key, text).mapInArrow(pairs, f"{key} {logs.schema[key].dataType.simpleString()}, no int, test string, traceback string")


def share_budget(blocks: DataFrame, key: str, part: str, order: str, size: str, budget: int, weights: dict[str, int]) -> DataFrame:
    """(key, part, order, size, clipped) of the blocks shown for each key: parts, in order of ``weights``, first fill their share of the
    budget with whole blocks, as they come, up to the first that does not fit; what is left over goes to the parts in turn, each from
    where it stopped. Where nothing fits at all, the first part that has any shows its first block, clipped to the budget.

    Parts without a weight show nothing. Blocks of a key may be any number; they are summed up block by block."""
    names, total = list(weights), sum(weights.values())
    share = F.coalesce(*[F.when(F.col(part) == n, budget * w // total) for n, w in weights.items()])
    rank = F.coalesce(*[F.when(F.col(part) == n, i) for i, n in enumerate(names)])
    rows = blocks.where(F.col(part).isin(names)).select(key, part, order, F.col(size).cast("long").alias("size"), rank.alias("rank"), share.cast("long").alias("share"))
    rows = scan(place(rows, [key, part], order, 1 << 20), [order], sums={"so_far": F.col("size")}).select(key, part, order, "size", "rank", "share", "so_far")
    # sizes are not negative, so the blocks before the first that does not fit are those whose running sum fits
    first = rows.groupBy(key, "rank").agg(F.coalesce(F.max(F.when(F.col("so_far") <= F.col("share"), F.col("so_far"))), F.lit(0)).alias("used"), F.max("so_far").alias("all"))
    per = first.groupBy(key).agg(*[F.coalesce(F.max(F.when(F.col("rank") == i, F.col("used"))), F.lit(0)).alias(f"u{i}") for i in range(len(names))], F.min("rank").alias("first_rank"))
    left = F.lit(budget) - sum((F.col(f"u{i}") for i in range(len(names))), F.lit(0))
    out, placed = None, rows.join(per, key)
    taken: list[DataFrame] = []
    for i in range(len(names)):
        mine = placed.where(F.col("rank") == i).withColumn("left", left)
        for j, more in enumerate(taken):
            mine = mine.join(more, key, "left").withColumn("left", F.col("left") - F.coalesce(f"m{j}", F.lit(0)))
        mine = mine.where(F.col("so_far") <= F.col(f"u{i}") + F.col("left"))
        taken.append(mine.groupBy(key).agg((F.max("so_far") - F.max(f"u{i}")).alias(f"m{i}")))
        mine = mine.select(key, part, order, "size", F.lit(False).alias("clipped"))
        out = mine if out is None else out.unionByName(mine)
    shown = out.groupBy(key).agg(F.sum("size").alias("shown"))
    bare = placed.join(shown, key, "left").where((F.coalesce("shown", F.lit(0)) == 0) & (F.col("rank") == F.col("first_rank")))
    bare = bare.groupBy(key, part).agg(F.min(F.struct(order, "size")).alias("b")).where(F.col("b.size") > budget).select(key, part, f"b.{order}", F.lit(budget).cast("long").alias("size"), F.lit(True).alias("clipped"))
    return out.unionByName(bare)


# How failures are told.
SUMMARY = "Evaluation summary: {status}. Target tests (FAIL_TO_PASS) passing: {passed}/{total}. Regressions (PASS_TO_PASS now failing): {broken}."
FAILING, REGRESSIONS = "Target tests still failing ({count}):\n{tests}", "Previously-passing tests your change broke ({count}):\n{tests}"
MODES = {
    "empty_patch": "No code changes were detected in the submission (empty patch).",
    "patch_apply_failed": "The submitted patch could not be applied to the repository.",
    "eval_incomplete": "The evaluation did not run to completion (environment error or timeout).",
    "unparseable": "The test results could not be parsed from the evaluation output.",
}
ABORT_MODE = "No test ran: pytest aborted during collection because a file failed to import -- {detail}. Pass/fail counts below are not meaningful; fix the import first."
CUT_NOTE = "\n[... feedback truncated ...]"


def failure_mode(abort: Column, patch: Column, apply_failed: Column, completed: Column, found: Column) -> Column:
    """The first of: collection abort, empty patch, patch that did not apply, evaluation not completed, nothing parsed; null if none."""
    told = F.when(F.trim(patch) == "", MODES["empty_patch"]).when(F.coalesce(apply_failed, F.lit(False)), MODES["patch_apply_failed"])
    told = told.when(~F.coalesce(completed, F.lit(False)), MODES["eval_incomplete"]).when(~F.coalesce(found, F.lit(False)), MODES["unparseable"])
    return F.when(abort.isNotNull(), fill(ABORT_MODE, detail=abort)).otherwise(told)


def feedback(graded: DataFrame, failing: DataFrame, key: str = "run_id", most: int = 25, cap: int = 4000) -> DataFrame:
    """(key, feedback) of graded rows (key, resolved, f2p_passed, f2p_failed, p2p_failed, mode) and failing tests (key, kind, test):
    summary, failing target tests, regressions and failure mode, those that have content, an empty line between; cut at ``cap``.

    Of either list the first ``most`` names are shown; each task passes on that many a key and kind."""
    nth = F.row_number().over(W.partitionBy(key, "kind").orderBy("test"))
    named = failing.withColumn("nth", nth).where(F.col("nth") <= most).groupBy(key, "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list("test")), lambda t: F.concat(F.lit("- "), t)), "\n").alias("names"))
    of = lambda kind, name: named.where(F.col("kind") == kind).select(key, F.col("names").alias(name))
    g = graded.join(of("F2P", "f2p_names"), key, "left").join(of("P2P", "p2p_names"), key, "left")
    summary = fill(SUMMARY, status=F.when(F.col("resolved"), "resolved").otherwise("not resolved"), passed=F.col("f2p_passed"), total=F.col("f2p_passed") + F.col("f2p_failed"), broken=F.col("p2p_failed"))
    text = F.concat_ws("\n\n", summary, fill(FAILING, count=F.col("f2p_failed"), tests=F.col("f2p_names")), fill(REGRESSIONS, count=F.col("p2p_failed"), tests=F.col("p2p_names")), "mode")
    return g.select(key, F.when(F.length(text) > cap, F.concat(F.left(text, F.lit(cap)), F.lit(CUT_NOTE))).otherwise(text).alias("feedback"))


def report_buckets(expected: DataFrame, observed: DataFrame, key: str = "run_id", most: int = 40) -> DataFrame:
    """(key, kind, n_success, n_failure, failure, failure_omitted): counts of every bucket, names of the first failures only."""
    e = expected.select(key, "kind", "test").distinct().join(observed.select(key, "test", "status"), [key, "test"], "left").withColumn("ok", F.coalesce(F.col("status") == "PASSED", F.lit(False)))
    n = e.groupBy(key, "kind").agg(F.count_if("ok").alias("n_success"), F.count_if(~F.col("ok")).alias("n_failure"))
    bad = e.where(~F.col("ok")).withColumn("nth", F.row_number().over(W.partitionBy(key, "kind").orderBy("test"))).where(F.col("nth") <= most)
    named = bad.groupBy(key, "kind").agg(F.array_join(F.array_sort(F.collect_list("test")), ",").alias("failure"))
    return n.join(named, [key, "kind"], "left").select(key, "kind", "n_success", "n_failure", F.coalesce("failure", F.lit("")).alias("failure"), F.greatest(F.col("n_failure") - most, F.lit(0)).alias("failure_omitted"))


def failures(results: DataFrame, name: str) -> DataFrame:
    """(name, kind) of results (name, resolved, completed) that did not succeed: wrong_answer or time_limit."""
    return results.where(~F.coalesce("resolved", F.lit(False))).select(name, F.when(F.coalesce("completed", F.lit(False)), "wrong_answer").otherwise("time_limit").alias("kind"))


def score_summary(rewards: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of rewards (reward): total, resolved (at or above the threshold, null is 0), rate in percent, mean reward."""
    r = F.coalesce("reward", F.lit(0.0))
    out = rewards.agg(F.count("*").alias("total"), F.count_if(r >= threshold).alias("resolved"), F.round(F.coalesce(F.avg(r), F.lit(0.0)), 6).alias("mean_reward"))
    return out.withColumn("rate", F.round(F.when(F.col("total") > 0, 100.0 * F.col("resolved") / F.col("total")).otherwise(0.0), 6))


def running_tally(results: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``results`` (key, order, resolved, completed) with ok, wrong, late and rate so far, each with the row's own."""
    ok, done = F.coalesce("resolved", F.lit(False)), F.coalesce("completed", F.lit(False))
    rows = results.select(key, *order, ok.cast("long").alias("o"), (~ok & done).cast("long").alias("w"), (~ok & ~done).cast("long").alias("l"))
    s = scan(place(rows, [key], order[0]), order, sums={"ok": F.col("o"), "wrong": F.col("w"), "late": F.col("l")})
    return s.select(key, *order, "ok", "wrong", "late", F.round(100.0 * F.col("ok") / (F.col("ok") + F.col("wrong") + F.col("late")), 6).alias("rate"))


def mean_reward(rows: DataFrame, scores: str) -> DataFrame:
    """One row: samples and the mean over them of the sum of each one's token scores."""
    total = F.aggregate(F.coalesce(F.col(scores), F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return rows.agg(F.count("*").alias("samples"), F.round(F.coalesce(F.avg(total), F.lit(0.0)), 6).alias("mean_reward"))


def average_at_n(rollouts: DataFrame, task: str, passed: str) -> DataFrame:
    """One row: tasks, rollouts and the mean over tasks of their share of passed rollouts, in percent."""
    per = rollouts.groupBy(task).agg(F.avg(F.coalesce(F.col(passed), F.lit(False)).cast("double")).alias("share"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("tasks"), F.coalesce(F.sum("n"), F.lit(0)).alias("rollouts"), F.round(F.coalesce(100.0 * F.avg("share"), F.lit(0.0)), 6).alias("avg_at_n"))


def raw_output(log: Column, cap: int = 2000) -> Column:
    """What a log shows between its markers, or all of it, both ends of a long one; null if blank."""
    return F.nullif(clip_middle(F.trim(grading.section(log, True)), cap, NOTES["traceback"]), F.lit(""))
