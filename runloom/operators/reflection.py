"""Looking back at runs: failed edits and facts, what had been seen, hints parsed, checked, placed and routed."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.functions.text import NOTES, clip_middle, fill
from runloom.operators.blocks import place, scan

EDITOR = "str_replace_editor"
# What an editor's message says of a failed edit, in the order in which it is read.
FAILED = "No replacement was performed"
CLASSES = (("collapsed your newlines", "escape"), ("leading space", "indent"), ("trailing whitespace", "trailing"), ("Multiple occurrences", "multiple"), ("is the same as new_str", "same"), ("Closest match", "window"))
EDIT = rf"^{EDITOR}\s+str_replace\b"
DROPPED = ("DROP", "NONE", "REMOVE")
BANNED = ("fail", "error", "attempt", "previous", "tried")
NOTHING = "(nothing yet)"

_CALL = ("step_idx", "call_idx", "call_id")


def edit_class(observation: Column) -> Column:
    """The class of a failed edit by the first fragment that its message has; verbatim without any."""
    out = None
    for fragment, name in CLASSES:
        hit = observation.contains(fragment)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("verbatim")


def _is_edit() -> Column:
    return (F.col("tool_name") == EDITOR) & F.col("action").rlike(EDIT)


def _path() -> Column:
    return F.nullif(F.regexp_extract("action", r"--path\s+(\S+)", 1), F.lit(""))


def first_failed_edit(calls: DataFrame) -> DataFrame:
    """(run_id, step_idx, call_id, class) of each run's first edit whose message says that nothing was replaced."""
    bad = calls.where(_is_edit() & F.col("observation").contains(FAILED)).select("run_id", *_CALL, edit_class(F.col("observation")).alias("class"))
    return bad.groupBy("run_id").agg(F.min(F.struct(*_CALL, "class")).alias("f")).select("run_id", "f.step_idx", "f.call_id", "f.class")


def facts(calls: DataFrame, most: int = 35) -> DataFrame:
    """(run_id, nth, step_idx, note) of what can be told of a run without asking: when something was first run, the first edit of a
    source file and whether anything had been run before, edits repeated to the letter (300 characters), failed edits, exceptions,
    submissions; in order of calls, at most ``most`` a run, which is all that each task passes on."""
    command = F.regexp_extract("action", rf"^{EDITOR}\s+(\w+)", 1)
    name = F.substring_index(_path(), "/", -1)
    source = F.coalesce((name != "") & ~name.contains("reproduce") & ~name.contains("test"), F.lit(False))
    seen = F.coalesce("observation", F.lit(""))
    c = calls.select(
        "run_id", *_CALL, ((F.col("tool_name") == "execute_bash") & F.col("action").contains("python")).alias("ran"), (command.isin("str_replace", "insert", "create") & source).alias("edits"), _path().alias("path"),
        F.left(F.coalesce("action", F.lit("")), F.lit(300)).alias("key"), seen.contains(FAILED).alias("missed"), seen.contains("Traceback").alias("raised"), (F.col("tool_name") == "submit").alias("submits"),
    )
    at = F.struct(*_CALL)
    first = c.groupBy("run_id").agg(F.min(F.when(F.col("ran"), at)).alias("first_run"), F.min(F.when(F.col("edits"), at)).alias("first_edit"))
    note = lambda order, text: F.struct(F.lit(order).alias("order"), text.alias("note"))
    turn = F.concat(F.lit("turn "), F.col("step_idx").cast("string"), F.lit(": "))
    late = lambda says: F.when(F.col("first_run").isNull() | (F.col("first_run") > at), F.lit(says)).otherwise("")
    told = c.join(first, "run_id").select(
        "run_id", *_CALL, F.explode(F.filter(F.array(
            F.when(F.col("ran") & (at == F.col("first_run")), note(0, F.concat(turn, F.lit("the first time anything is actually run")))),
            F.when(F.col("edits") & (at == F.col("first_edit")), note(1, F.concat(turn, F.lit("first edit to source ("), F.col("path"), F.lit(")"), late(", and nothing has been run yet")))),
            F.when(F.col("missed"), note(3, F.concat(turn, F.lit("the edit matched nothing in the file")))).when(F.col("raised"), note(3, F.concat(turn, F.lit("what it ran raised an exception")))),
            F.when(F.col("submits"), note(4, F.concat(turn, F.lit("submits"), late(", having never run anything")))),
        ), lambda x: x.isNotNull())).alias("n"),
    ).select("run_id", *_CALL, "n.order", "n.note")
    edits = scan(place(c.where("edits"), ["run_id", "key"], "step_idx"), _CALL, before=("seen", F.col("step_idx"), 1))
    before = F.get("seen", F.size("seen") - 1)
    again = edits.where(before.isNotNull()).select("run_id", *_CALL, F.lit(2).alias("order"), F.concat(turn, F.lit("repeats verbatim the edit made at turn "), before.cast("string")).alias("note"))
    both = told.unionByName(again).withColumn("nth", F.row_number().over(W.partitionBy("run_id").orderBy(*_CALL, "order")))
    return both.where(F.col("nth") <= most).select("run_id", "nth", "step_idx", "note")


def failed_edit_turns(calls: DataFrame) -> DataFrame:
    """(run_id, step_idx, call_id, path, observation): per turn the first edit that failed."""
    bad = calls.where(_is_edit() & F.col("observation").contains(FAILED)).select("run_id", *_CALL, _path().alias("path"), "observation")
    return bad.groupBy("run_id", "step_idx").agg(F.min(F.struct("call_idx", "call_id", "path", "observation")).alias("f")).select("run_id", "step_idx", "f.call_id", "f.path", "f.observation")


def viewed_before(calls: DataFrame, cap: int = 40_000, boundary: str = "\x00") -> DataFrame:
    """(run_id, step_idx, viewed) for each turn whose edit failed: what earlier turns without a failed edit had shown with line
    numbers or tabs, without those numbers, parts divided by a boundary line, the last ``cap`` characters.

    Views are laid end to end and cut into stretches of ``cap``; a failed edit meets the stretch that it stands in and the one before."""
    failed = failed_edit_turns(calls).select("run_id", "step_idx")
    views = calls.where(F.col("observation").contains("cat -n") | F.col("observation").contains("\t")).select("run_id", *_CALL, F.right(F.regexp_replace("observation", r"(?m)^ *\d+\t", ""), F.lit(cap)).alias("text"))
    views = views.join(failed, ["run_id", "step_idx"], "left_anti").withColumn("n", F.length("text") + len(boundary) + 2)
    marks = views.select("run_id", *_CALL, "n", F.lit(False).alias("ask")).unionByName(failed.select("run_id", "step_idx", F.lit(None).cast("int").alias("call_idx"), F.lit(None).cast("long").alias("call_id"), F.lit(0).alias("n"), F.lit(True).alias("ask")))
    marks = scan(place(marks, ["run_id"], "step_idx"), _CALL, sums={"end": F.col("n").cast("long")}).select("run_id", *_CALL, "ask", "end")
    laid = views.join(marks.where("not ask").select("run_id", "call_id", "end"), ["run_id", "call_id"]).select("run_id", F.col("step_idx").alias("at"), "call_idx", "call_id", "text", "end", F.expr(f"(end - 1) div {cap}").alias("stretch"))
    asked = marks.where("ask").select("run_id", "step_idx", F.col("end").alias("upto"), F.explode(F.array(F.expr(f"end div {cap}"), F.expr(f"end div {cap} - 1"))).alias("stretch"))
    met = asked.join(laid, ["run_id", "stretch"]).where(F.col("end") <= F.col("upto"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "call_idx", "call_id", "text"))), lambda p: p["text"])
    seen = met.groupBy("run_id", "step_idx").agg(F.right(F.array_join(parts, f"\n{boundary}\n"), F.lit(cap)).alias("viewed"))
    return failed.join(seen, ["run_id", "step_idx"], "left").select("run_id", "step_idx", F.coalesce("viewed", F.lit("")).alias("viewed"))


def retry_turn(calls: DataFrame) -> DataFrame:
    """(run_id, step_idx, retry_step) for each turn whose edit failed: the next turn that edits, if its first edit is of the same path and fails too; else null."""
    edits = calls.where(_is_edit()).select("run_id", *_CALL, _path().alias("path"), F.coalesce(F.col("observation").contains(FAILED), F.lit(False)).alias("failed"))
    turns = edits.groupBy("run_id", "step_idx").agg(F.min(F.struct("call_idx", "call_id", "path", "failed")).alias("f"), F.max("failed").alias("any")).select("run_id", "step_idx", "f.path", "f.failed", "any")
    x = scan(place(turns, ["run_id"], "step_idx"), ["step_idx"], before=("later", F.struct("step_idx", "path", "failed"), 1), reverse=True)
    nxt = F.get("later", F.size("later") - 1)
    return x.where("any").select("run_id", "step_idx", F.when(nxt["failed"] & (nxt["path"] == F.col("path")), nxt["step_idx"]).alias("retry_step"))


def select_edits(edits: DataFrame, select: str = "first", most: int = 1) -> DataFrame:
    """Rows of ``edits`` (run_id, step_idx, raw, corrected) to give hints for. first: a run's first, if it has a correction; all: the
    first ``most`` that have; repeat: the first with a correction whose call had been made before to the letter."""
    if select not in ("first", "all", "repeat"):
        raise ValueError(f"no selection {select!r}; there are all, first, repeat")
    order = W.partitionBy("run_id").orderBy("step_idx")
    good = F.col("corrected").isNotNull()
    if select == "first":
        return edits.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").where(good).drop("_nth")
    if select == "repeat":
        nth = F.row_number().over(W.partitionBy("run_id", "raw").orderBy("step_idx"))
        first = edits.withColumn("_seen", nth).groupBy("run_id").agg(F.min(F.when(good & (F.col("_seen") > 1), F.col("step_idx"))).alias("step_idx"))
        return edits.join(first, ["run_id", "step_idx"], "left_semi")
    return edits.where(good).withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= most).drop("_nth")


# How a turn and its tools are shown.
TURN, TOOL, NO_TOOLS = "### Turn {step}\nASSISTANT:\n{response}\n{tools}", "TOOL {name}:\n{observation}", "(no tool calls)"
DEGENERATE = "(degenerate turn: the model emitted almost no output and no tool call) "


def turn_text(step: Column, response: Column, tools: Column, observation_cap: int | None = 1000, response_cap: int | None = None) -> Column:
    """A turn as one text; ``tools`` an array of struct(name, observation). A turn without tools and of hardly any words is said to be one."""
    cut = lambda x, cap: clip_middle(x, cap, NOTES["turn"]) if cap else x
    bare = (F.size(tools) == 0) & (F.length(F.trim(response)) < 20)
    said = F.when(bare, F.concat(F.lit(DEGENERATE + "'"), response, F.lit("'"))).otherwise(cut(response, response_cap))
    used = F.array_join(F.transform(tools, lambda t: fill(TOOL, name=t["name"], observation=cut(F.coalesce(t["observation"], F.lit("")), observation_cap))), "\n")
    return fill(TURN, step=step, response=said, tools=F.when(F.size(tools) > 0, used).otherwise(NO_TOOLS))


def prefixes(turns: DataFrame, asked: DataFrame) -> DataFrame:
    """(run_id, step_idx, prefix) for each asked (run_id, step_idx): the texts of turns (run_id, step_idx, text) before it, in order, an
    empty line between; (nothing yet) without any. A prefix is as long as what it holds, so ask for the few steps that need one."""
    a = asked.select("run_id", "step_idx").distinct()
    met = a.join(turns.select("run_id", F.col("step_idx").alias("at"), "text"), "run_id").where("at < step_idx")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda t: t["text"]), "\n\n")
    out = met.groupBy("run_id", "step_idx").agg(joined.alias("prefix"))
    return a.join(out, ["run_id", "step_idx"], "left").select("run_id", "step_idx", F.coalesce("prefix", F.lit(NOTHING)).alias("prefix"))


#: Caps of observations and responses, tried in order until a text fits.
LADDER = ((1000, None), (7600, None), (3800, None), (3800, 7600), (3800, 3800))


def shrink(rungs: list[Column], budget: int) -> Column:
    """struct(rung, text) of the first text that fits the budget; null if none does."""
    out = None
    for i, text in enumerate(rungs):
        hit = F.length(text) <= budget
        v = F.struct(F.lit(i).alias("rung"), text.alias("text"))
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out


def check_stages(stages: list[dict], trace: set[str], per_turn: set[str]) -> None:
    """A pipeline's stages, dicts with id, user (a template), per (trace or turn), parse (text, turns or hints) and edit (free or delete_only):
    an error unless the last yields hints, templates name only fields they can be given, per-turn stages do not select turns, and delete_only goes with hints."""
    if not stages:
        raise ValueError("a pipeline needs a stage")
    if stages[-1].get("parse") != "hints":
        raise ValueError("the last stage has to parse hints")
    for i, s in enumerate(stages):
        allowed = trace | ({"prev"} if i else set()) | (per_turn if s.get("per") == "turn" else set()) | {"k"}
        unknown = {name for _, name, _, _ in string.Formatter().parse(s["user"]) if name} - allowed
        if unknown:
            raise ValueError(f"stage {s['id']!r} names fields it cannot be given: {sorted(unknown)}")
        if s.get("per") == "turn" and s.get("parse") == "turns":
            raise ValueError(f"stage {s['id']!r}: a stage per turn cannot select turns")
        if s.get("edit") == "delete_only" and s.get("parse") != "hints":
            raise ValueError(f"stage {s['id']!r}: delete_only goes with hints")


def plain_words(x: Column) -> Column:
    """Words of a text in lower case, reduced to letters and digits of ASCII; empty ones left out."""
    return F.filter(F.transform(F.split(F.lower(F.coalesce(x, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]+", "")), lambda w: w != "")


def only_deletes(candidate: Column, original: Column) -> Column:
    """Whether a text is another with whole words left out and none put in."""
    wanted = plain_words(candidate)
    reached = F.aggregate(plain_words(original), F.lit(0), lambda at, w: F.when(F.get(wanted, at) == w, at + 1).otherwise(at))
    return reached == F.size(wanted)


def special_tokens_out(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"<\|[^|]*\|>", " "), r"\s+", " "))


def adopt(reply: Column, original: Column, marker: str, delete_only: bool = False) -> Column:
    """struct(hint, outcome) of a stage's reply to a draft: failed (no reply; no hint), empty (the draft stays), dropped, unchanged, rewrote
    (words put in though only deletions are allowed; the draft stays) or edited.

    The reply's text stands behind its last marker, else on its last line that is not blank; control tokens and quotes around it are dropped."""
    draft = F.coalesce(original, F.lit(""))
    lines = F.filter(F.split(reply, r"\r?\n", -1), lambda x: F.trim(x) != "")
    raw = F.when(reply.contains(marker), F.substring_index(reply, marker, -1)).otherwise(F.coalesce(F.element_at(F.concat(F.array(F.lit("")), lines), -1), F.lit("")))
    text = F.regexp_replace(special_tokens_out(raw), '^"+|"+$', "")
    same = text == F.trim(F.regexp_replace(draft, r"\s+", " "))
    outcome = F.when(reply.isNull(), "failed").when(text == "", "empty").when(F.upper(text).isin(*DROPPED), "dropped").when(same, "unchanged")
    if delete_only:
        outcome = outcome.when(~only_deletes(text, draft), "rewrote")
    outcome = outcome.otherwise("edited")
    hint = F.when(outcome.isin("failed", "dropped"), F.lit(None)).when(outcome == "edited", text).otherwise(F.nullif(draft, F.lit("")))
    return F.struct(hint.alias("hint"), outcome.alias("outcome"))


def keep_hints(hints: DataFrame, turns: DataFrame, most: int = 5, cap: int = 4000) -> DataFrame:
    """``hints`` (run_id, step_idx, hint) for turns that there are, the ``most`` earliest of a run, long ones cut with a note."""
    real = hints.join(turns.select("run_id", "step_idx").distinct(), ["run_id", "step_idx"], "left_semi")
    first = real.withColumn("_nth", F.row_number().over(W.partitionBy("run_id").orderBy("step_idx"))).where(F.col("_nth") <= most)
    return first.select("run_id", "step_idx", F.when(F.length("hint") > cap, F.concat(F.left("hint", F.lit(cap)), F.lit(" [... clipped ...]"))).otherwise(F.col("hint")).alias("hint"))


def reads_as_hindsight(hint: Column) -> Column:
    return F.lower(hint).rlike("|".join(BANNED))


def place_hints(hints: DataFrame, segments: DataFrame, key: str = "run_id") -> DataFrame:
    """(run_id, segment_index, step, span_start, span_end, hint): hints (run_id, step_idx, hint) beside the spans of their steps."""
    spans = segments.select(key, "segment_index", F.explode("turn_spans").alias("s")).select(key, "segment_index", "s.step", "s.span_start", "s.span_end")
    return spans.join(hints.select(key, F.col("step_idx").alias("step"), "hint"), [key, "step"]).select(key, "segment_index", "step", "span_start", "span_end", "hint")


def with_fallback(found: DataFrame, other: DataFrame, key: str = "run_id") -> DataFrame:
    """Rows of ``found``, and those of ``other`` for keys that it has none of."""
    return found.unionByName(other.join(found.select(key).distinct(), key, "left_anti"))


def worth_reflection(runs: DataFrame, failed_only: bool = True) -> DataFrame:
    """Runs (reward, eval_completed, validating) to look back at: not those that validate, nor with an evaluation that did not end, nor, if ``failed_only``, those with a reward."""
    keep = ~F.coalesce("validating", F.lit(False)) & (F.coalesce("eval_completed", F.lit(1.0)) >= 1.0)
    return runs.where(keep & (F.coalesce("reward", F.lit(0.0)) == 0) if failed_only else keep)


def unique_line(text: Column, what: Column) -> Column:
    """The line, from 1, of a text's only occurrence; null if there is none or another."""
    at = F.position(what, text)
    again = F.position(what, text, at + 1)
    head = F.left(text, at - 1)
    return F.when((what != "") & (at > 0) & (again == 0), F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("int")
