"""Operators over ordered sequences: turns, tool calls and messages of agent runs.

All take DataFrames and return DataFrames; order is always explicit. Passes over a run go block by block (``blocks``), so that
a run of any length spreads over many tasks. Null keys form a group of their own, empty inputs give
empty results, and further columns of an input are ignored unless said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.functions.text import action_mask
from runloom.operators.blocks import place, scan, unplace
from runloom.session import checkpoint

# Texts that the condensed history shows in place of what was cut or masked.
CLIP_MARK = " [... TRUNCATED ...] "
CLIP_NOTE = "\n[The observation was truncated in the middle as it was too long.]"
MASKED_ARGUMENTS = ("old_str", "new_str", "file_text")
MASK_NOTE = "[The observation of the above action has been masked out to shorten the context.]"


_CALL = ("step_idx", "call_idx", "call_id")
_TURN = ("step_idx", "turn_id")


def _runs(df: DataFrame) -> DataFrame:
    return place(df, ["run_id"], "step_idx")


def _before(name: str, n: int) -> Column:
    """The n-th value before a row, of an array that ``scan`` made; null where there are fewer."""
    return F.get(name, F.size(name) - n)


def _same(key: str, at: str, a: str, b: str) -> Column:
    return F.col(f"{a}.{key}").eqNullSafe(F.col(f"{b}.{key}")) & (F.col(f"{a}.{at}") == F.col(f"{b}.{at}"))


def numbered(rows: DataFrame, key: str, order: tuple[str, ...], name: str) -> DataFrame:
    """``rows`` with their places in their group, from 1."""
    return unplace(scan(place(rows, [key], order[0]), order, sums={name: F.lit(1).cast("long")}))


def stuck(calls: DataFrame, text: str, k: int = 3) -> DataFrame:
    """(run_id, first_stuck): first position, among non-empty texts, at which the last k are equal. k <= 0 finds none."""
    if k <= 0:
        return calls.select("run_id", F.lit(0).cast("long").alias("first_stuck")).limit(0)
    rows = calls.where(F.coalesce(F.col(text), F.lit("")) != "").select("run_id", *_CALL, F.md5(text).alias("same"))
    rows = scan(_runs(rows), _CALL, sums={"pos": F.lit(1).cast("long")}, before=("seen", F.col("same"), max(1, k - 1)))
    equal = (F.size("seen") == k - 1) & F.forall("seen", lambda x: x == F.col("same")) if k > 1 else F.lit(True)
    return rows.where(equal).groupBy("run_id").agg(F.min("pos").alias("first_stuck"))


def signature(tool: str = "tool_name", action: str = "action", cut: int = 300) -> Column:
    """Tool and action with blanks collapsed, cut to a length."""
    both = F.concat_ws(" ", F.coalesce(tool, F.lit("")), F.coalesce(action, F.lit("")))
    return F.left(F.trim(F.regexp_replace(both, r"\s+", " ")), F.lit(cut))


def first_loop(calls: DataFrame, k: int = 3) -> DataFrame:
    """(run_id, signature, first_step, hit_step): the signature that is first to occur k times in a run, wherever, and where it began."""
    s = calls.select("run_id", "step_idx", "call_idx", "call_id", signature().alias("signature"))
    at = F.struct("step_idx", "call_idx", "call_id")
    n = s.withColumn("rn", F.row_number().over(W.partitionBy("run_id", "signature").orderBy("step_idx", "call_idx", "call_id")))
    per = n.where(F.col("rn") <= k).where(F.col("rn").isin(1, k)).groupBy("run_id", "signature").agg(F.min(F.when(F.col("rn") == 1, at)).alias("first"), F.min(F.when(F.col("rn") == k, at)).alias("hit")).where("hit is not null")
    best = per.groupBy("run_id").agg(F.min_by(F.struct("signature", "first", "hit"), "hit").alias("b"))
    return best.select("run_id", "b.signature", F.col("b.first.step_idx").alias("first_step"), F.col("b.hit.step_idx").alias("hit_step"))


def termination(turns: DataFrame) -> DataFrame:
    """(run_id, termination): of the last step its exit_reason, unless empty or turn_done; then finished if done, else max_turns."""
    last = turns.groupBy("run_id").agg(F.max_by(F.struct("exit_reason", "done"), F.struct("step_idx", "turn_id")).alias("l"))
    reason = F.coalesce("l.exit_reason", F.lit(""))
    return last.select("run_id", F.when(~reason.isin("", "turn_done"), reason).when(F.coalesce("l.done", F.lit(False)), "finished").otherwise("max_turns").alias("termination"))


def step_exit(calls: DataFrame, turns: DataFrame, budget: int = 3) -> DataFrame:
    """(run_id, step_idx, exit): terminal_dead > timeout_budget_exhausted > finished > completed_with_tool_errors > completed.

    A step is dead if a call was skipped, its budget exhausted if the run's timeouts so far exceed ``budget``."""
    per = calls.groupBy("run_id", "step_idx").agg(F.max((F.col("status") == "skipped").cast("int")).alias("dead"), F.sum((F.col("status") == "timeout").cast("long")).alias("timeouts"), F.max((F.col("status") != "ok").cast("int")).alias("errors"))
    t = turns.groupBy("run_id", "step_idx").agg(F.max(F.coalesce("done", F.lit(False)).cast("int")).alias("done"))
    both = scan(_runs(t.join(per, ["run_id", "step_idx"], "left")), ["step_idx"], sums={"spent": F.coalesce("timeouts", F.lit(0))})
    out = F.when(F.coalesce("dead", F.lit(0)) == 1, "terminal_dead").when((F.col("timeouts") > 0) & (F.col("spent") > budget), "timeout_budget_exhausted").when(F.col("done") == 1, "finished")
    return both.select("run_id", "step_idx", out.when(F.coalesce("errors", F.lit(0)) == 1, "completed_with_tool_errors").otherwise("completed").alias("exit"))


def skipped_fill(calls: DataFrame) -> DataFrame:
    """(call_id, status): after a timeout, the remaining calls of the step count as skipped."""
    before = W.partitionBy("run_id", "step_idx").orderBy("call_idx", "call_id").rowsBetween(W.unboundedPreceding, -1)
    dead = F.coalesce(F.max((F.col("status") == "timeout").cast("int")).over(before), F.lit(0)) == 1
    return calls.select("call_id", F.when(dead, "skipped").otherwise(F.col("status")).alias("status"))


def response_spans(turns: DataFrame, limit: int) -> DataFrame:
    """(run_id, step_idx, span_start, span_end): half-open token spans, without those that start at or after ``limit``, ends clamped to it."""
    n = F.coalesce("tokens", F.lit(0)).cast("long")
    s = scan(_runs(turns.select("run_id", *_TURN, n.alias("n"))), _TURN, sums={"e": F.col("n")}).withColumn("span_start", F.col("e") - F.col("n"))
    return s.where(F.col("span_start") < limit).select("run_id", "step_idx", "span_start", F.least("e", F.lit(limit)).cast("long").alias("span_end"))


def length_stop(turns: DataFrame, limit: int) -> DataFrame:
    """(run_id, kept_turns, tokens, stopped): turns before the one whose tokens would reach ``limit``."""
    n = F.coalesce("tokens", F.lit(0)).cast("long")
    s = scan(_runs(turns.select("run_id", *_TURN, n.alias("n"))), _TURN, sums={"so_far": F.col("n")})
    keep = F.col("so_far") < limit
    return s.groupBy("run_id").agg(F.count_if(keep).alias("kept_turns"), F.sum(F.when(keep, F.col("n")).otherwise(0)).cast("long").alias("tokens"), F.max(~keep).alias("stopped"))


def token_cost(text: Column) -> Column:
    """Tokens of a message without a tokenizer: a quarter of its characters, at least 1, and 4 for the message."""
    return (F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)) + 4).cast("long")


def compact(messages: DataFrame, most: int, target: int) -> DataFrame:
    """Kept rows of ``messages`` (conv_id, idx, role, content): all, where a conversation costs at most ``most`` or has no user
    message; else system messages and the newest user-led chunks that fit ``target``, the newest always."""
    user, system = F.coalesce(F.col("role") == "user", F.lit(False)), F.coalesce(F.col("role") == "system", F.lit(False))
    # texts stay behind: what is kept is decided on costs alone
    m = place(messages.select("conv_id", "idx", user.alias("user"), system.alias("system"), token_cost(F.col("content")).alias("cost")), ["conv_id"], "idx")
    moving = F.when(F.col("system"), 0).otherwise(F.col("cost"))
    m = scan(m, ["idx"], sums={"chunk": F.col("user").cast("long"), "so_far": moving}, totals={"newest": ("sum", F.col("user").cast("long")), "total": ("sum", F.col("cost")), "moving": ("sum", moving)})
    m = checkpoint(m)
    # a chunk and all after it cost what is left at its user message
    m = scan(m, ["idx"], lasts={"run": F.when(F.col("user"), F.col("moving") - F.col("so_far") + F.col("cost"))})
    room = F.greatest(F.lit(0), F.lit(target) - (F.col("total") - F.col("moving")))
    keep = (F.col("total") <= most) | (F.col("newest") == 0) | F.col("system") | ((F.col("chunk") > 0) & ((F.col("chunk") == F.col("newest")) | (F.col("run") <= room)))
    kept = m.where(keep).select("conv_id", "idx")
    return messages.select("conv_id", "idx", "role", "content").alias("a").join(kept.alias("k"), _same("conv_id", "idx", "a", "k"), "left_semi")


def condense(messages: DataFrame, budget: int, cap: int = 5000, keep_first: int = 2, keep_last: int = 10, role: str = "tool", assistant: str = "assistant", arguments: tuple[str, ...] = MASKED_ARGUMENTS) -> DataFrame:
    """``messages`` (conv_id, idx from 0, role, content) with long observations clipped in the middle, then the oldest masked until
    ``budget`` characters are saved, then the named arguments of the assistant's calls, oldest first; unmet: whether the budget was not reached."""
    half = cap // 2
    seen = F.coalesce(F.col("role") == role, F.lit(False)) & (F.col("idx") >= keep_first)
    t = messages.select("conv_id", "idx", F.coalesce("content", F.lit("")).alias("content"), seen.alias("seen"), F.coalesce(F.col("role") == assistant, F.lit(False)).alias("reply"))
    clipped = F.concat(F.left("content", F.lit(half)), F.lit(CLIP_MARK), F.right("content", F.lit(half)), F.lit(CLIP_NOTE))
    t = t.withColumn("t1", F.when(F.col("seen") & (F.length("content") > cap), clipped).otherwise(F.col("content")))
    t = t.withColumn("t2", F.when(F.col("reply"), action_mask(F.col("t1"), list(arguments))).otherwise(F.col("t1")))
    # texts stay behind: what is cut is decided on lengths alone
    m = t.select("conv_id", "idx", "seen", F.length("content").alias("n0"), F.length("t1").alias("n1"), F.length("t2").alias("n2"), (F.col("t1") == MASK_NOTE).alias("gone"))
    m = checkpoint(scan(place(m, ["conv_id"], "idx"), ["idx"], totals={"saved": ("sum", F.col("n0") - F.col("n1")), "newest": ("max", F.col("idx"))}))
    old = F.col("idx") < F.col("newest") + 1 - keep_last
    m = m.withColumn("size", F.when(F.col("seen") & old & ~F.col("gone"), F.col("n1")).otherwise(0)).withColumn("gain", F.when(old, F.col("n1") - F.col("n2")).otherwise(0))
    m = scan(m, ["idx"], sums={"so_far": F.col("size"), "gained": F.col("gain")}, totals={"all": ("sum", F.col("size")), "gains": ("sum", F.col("gain"))})
    left = F.lit(budget) - F.col("saved")
    masked = F.col("seen") & old & ~F.col("gone") & (left - (F.col("so_far") - F.col("size")) > 0)
    # last, the named arguments of what the assistant sent, oldest first, while still too much is left
    cut = (F.col("gain") > 0) & (left - F.col("all") - (F.col("gained") - F.col("gain")) > 0)
    m = m.select("conv_id", "idx", masked.alias("masked"), cut.alias("cut"), (left - F.col("all") - F.col("gains") > 0).alias("unmet"))
    out = t.alias("t").join(m.alias("m"), _same("conv_id", "idx", "t", "m"))
    return out.select("t.conv_id", "t.idx", F.when(F.col("masked"), MASK_NOTE).when(F.col("cut"), F.col("t2")).otherwise(F.col("t1")).alias("content"), "masked", "unmet")


def condense_budget(length: Column, limit: int, attempt: int = 0, margin: int = 1024, per_token: int = 4, least: int = 2000) -> Column:
    """Characters to save: the tokens over the limit and a margin, more with every attempt."""
    return F.greatest(F.lit(least), (F.greatest(F.lit(0), length - limit) + margin) * (attempt + 1) * per_token)


def split_on_change(rows: DataFrame, by: list[str], key: str = "run_id", order: tuple[str, ...] = ("step_idx", "turn_id")) -> DataFrame:
    """``rows`` with trajectory: a number that goes up by one where a column of ``by`` differs from the row before. All columns
    of ``rows`` are written once; give it only those that are needed."""
    x = scan(place(rows, [key], order[0]), order, before=("_seen", F.struct(*by), 1))
    last = _before("_seen", 1)
    same = last.isNotNull()
    for c in by:
        same = same & F.col(c).eqNullSafe(last[c])
    x = checkpoint(x.withColumn("_new", F.when(same, 0).otherwise(1)).drop("_seen"))
    return unplace(scan(x, order, sums={"trajectory": F.col("_new")})).drop("_new")


def split_trajectories(requests: DataFrame) -> DataFrame:
    """(session_id, seq, trajectory) of requests (session_id, seq, tools, history array of canonical messages, reply, ok).

    A request goes on with its trajectory if tools are equal and its history begins with the history and reply of the last
    committed request. Failed requests commit nothing and have no row."""
    r = requests.where("ok").withColumn("committed", F.concat("history", F.array("reply")))
    r = scan(place(r, ["session_id"], "seq"), ["seq"], before=("seen", F.struct("committed", "tools"), 1)).withColumn("prev", _before("seen", 1))
    prev = F.col("prev.committed")
    goes_on = prev.isNotNull() & F.col("tools").eqNullSafe(F.col("prev.tools")) & (F.slice("history", F.lit(1), F.size(prev)) == prev)
    return _trajectories(r, goes_on)


def _trajectories(r: DataFrame, goes_on: Column) -> DataFrame:
    r = checkpoint(r.select("session_id", "seq", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1).alias("new")))
    r = scan(place(r, ["session_id"], "seq"), ["seq"], sums={"trajectory": F.col("new")})
    return r.select("session_id", "seq", "trajectory")


def _parts(idx: Column, message: Column) -> list[Column]:
    """The MD5 of a message at its place as four numbers below 2^32. A list of messages has their sums, so those of its beginnings are running sums."""
    h = F.md5(F.concat(idx.cast("string"), F.coalesce(F.concat(F.lit("="), message), F.lit(""))))
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def split_logged(requests: DataFrame, messages: DataFrame) -> DataFrame:
    """``split_trajectories`` where each message is held once: of requests (session_id, seq, tools, log, depth, reply, ok), whose history is the
    first ``depth`` of the ``messages`` (session_id, log, idx from 1, canonical message) of that log of the session.

    Histories in full are as many messages as a session's requests squared; here beginnings are compared by 128-bit sums, those of different
    logs too. A request whose log lacks a message at its depth goes on with none."""
    m = messages.select("session_id", "log", "idx", *[p.alias(f"p{i}") for i, p in enumerate(_parts(F.col("idx"), F.col("message")))])
    m = scan(place(m, ["session_id", "log"], "idx"), ["idx"], sums={f"s{i}": F.col(f"p{i}") for i in range(4)})
    m = m.select("session_id", "log", "idx", F.array("s0", "s1", "s2", "s3").alias("digest")).alias("m")

    def begins(r: DataFrame, n: Column, name: str) -> DataFrame:
        """Digests of the first n messages; rows without n have none, and are spread by their own number."""
        r = r.withColumn("_at", F.coalesce(n, -1 - F.abs("seq"))).alias("r")
        at = F.col("r.session_id").eqNullSafe(F.col("m.session_id")) & F.col("r.log").eqNullSafe(F.col("m.log")) & (F.col("r._at") == F.col("m.idx"))
        return r.join(m, at, "left").select("r.*", F.col("m.digest").alias(name)).drop("_at")

    own = F.col("depth") > 0
    r = begins(requests.where("ok").select("session_id", "seq", "tools", "log", "depth", "reply"), F.when(own, F.col("depth")), "digest")
    n = F.col("depth") + 1
    committed = F.zip_with(F.when(own, F.col("digest")).otherwise(F.array(*[F.lit(0).cast("long")] * 4)), F.array(*_parts(n, F.col("reply"))), lambda a, b: a + b)
    r = r.select("session_id", "seq", "tools", "log", "depth", n.alias("n"), committed.alias("committed"))
    r = scan(place(r, ["session_id"], "seq"), ["seq"], before=("seen", F.struct("n", "committed", "tools"), 1)).withColumn("prev", _before("seen", 1))
    may = F.col("prev").isNotNull() & F.col("tools").eqNullSafe(F.col("prev.tools")) & (F.col("depth") >= F.col("prev.n"))
    r = begins(r.select("session_id", "seq", "log", F.when(may, F.col("prev.n")).alias("n"), F.col("prev.committed").alias("committed")), F.col("n"), "digest")
    return _trajectories(r, F.col("n").isNotNull() & (F.col("digest") == F.col("committed")))


def carry_kind(lines: DataFrame) -> DataFrame:
    """``lines`` (run_id, source, byte_offset, text) with kind: that of the last marker, until a dated line without one."""
    t = F.coalesce("text", F.lit(""))
    marker = F.when(t.rlike(r"STEP \d+"), "step").when(t.contains("THOUGHT:"), "thought").when(t.contains("ACTION"), "action").when(t.contains("MODEL INPUT"), "input").when(t.contains("Observation:"), "observation").when(t.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d"), "none")
    x = lines.select("run_id", "source", "byte_offset", marker.alias("marker"))
    x = scan(place(x, ["run_id", "source"], "byte_offset", 1 << 22), ["byte_offset"], lasts={"kind": F.col("marker")})
    return x.select("run_id", "source", "byte_offset", F.coalesce("kind", F.lit("none")).alias("kind"))


def retries(calls: DataFrame) -> DataFrame:
    """(call_id, next_call_id, failed_again): for each failed call the next of its tool in the run; null where none follows."""
    x = place(calls.select("run_id", "tool_name", *_CALL, "status"), ["run_id", "tool_name"], "step_idx")
    x = scan(x, _CALL, before=("later", F.struct("call_id", "status"), 1), reverse=True).withColumn("next", _before("later", 1))
    return x.where("status <> 'ok'").select("call_id", F.col("next.call_id").alias("next_call_id"), (F.col("next.status") != "ok").alias("failed_again"))


def verbatim_repeats(calls: DataFrame) -> DataFrame:
    """(call_id, step_idx, repeats_step, nth): calls whose signature was seen before in the run, with the latest step it had."""
    x = place(calls.select("run_id", *_CALL, signature().alias("sig")), ["run_id", "sig"], "step_idx")
    x = scan(x, _CALL, sums={"nth": F.lit(1)}, before=("seen", F.col("step_idx"), 1))
    return x.where("nth > 1").select("call_id", "step_idx", _before("seen", 1).alias("repeats_step"), F.col("nth").cast("int").alias("nth"))


def new_output(calls: DataFrame) -> DataFrame:
    """(call_id, fresh): a call's observation without what the run's call before had shown already."""
    c = _runs(calls.select("run_id", *_CALL, F.coalesce("observation", F.lit("")).alias("text")))
    c = scan(c, _CALL, before=("shown", F.col("text"), 1)).withColumn("seen", F.coalesce(_before("shown", 1), F.lit("")))
    return c.select("call_id", F.when(F.col("seen").startswith(F.col("text")), "").when(F.col("text").startswith(F.col("seen")), F.substring("text", F.length("seen") + 1, F.length("text"))).otherwise(F.col("text")).alias("fresh"))


def mask_summary(segments: DataFrame) -> DataFrame:
    """Per segment: response and generated tokens, whether mask and logprobs fit the ids, steps in order of their spans, clamped to the response."""
    n = F.coalesce(F.size("response_ids"), F.lit(0))
    inside = F.filter(F.coalesce("turn_spans", F.array().cast("array<struct<step:int,span_start:int,span_end:int>>")), lambda s: s["span_start"] < n)
    covered = F.aggregate(inside, F.lit(0), lambda a, s: a + F.least(s["span_end"], n) - s["span_start"])
    return segments.select(
        "run_id", "segment_index", n.cast("long").alias("response_tokens"), F.aggregate(F.coalesce("response_mask", F.array().cast("array<tinyint>")), F.lit(0).cast("long"), lambda a, x: a + x).alias("generated_tokens"),
        ((F.size("response_mask") == n) & ((F.size("response_logprobs") == 0) | (F.size("response_logprobs") == n))).alias("fits"), F.size(inside).cast("long").alias("spans"), covered.cast("long").alias("covered_tokens"),
    )


def split_response(ids: Column, mask: Column, prompt_most: int, response_most: int) -> Column:
    """struct(prompt, response) of a token list whose last size(mask) ids are the response, both cut to limits from the front."""
    n, k = F.size(ids), F.coalesce(F.size(mask), F.lit(0))
    prompt = F.when(n > k, F.slice(ids, F.lit(1), F.least(n - k, F.lit(prompt_most)))).otherwise(F.slice(ids, 1, 0))
    response = F.when(k > 0, F.slice(ids, n - k + 1, F.least(k, F.lit(response_most)))).otherwise(F.slice(ids, 1, 0))
    return F.struct(prompt.alias("prompt"), response.alias("response"))


def run_outcomes(turns: DataFrame, calls: DataFrame, segments: DataFrame, resolved: DataFrame | None = None, hints: DataFrame | None = None) -> DataFrame:
    """Per run: turns, termination, condensations (segments - 1), tool seconds, whether it is among ``resolved`` (run_id), and how many of its turns have ``hints`` (run_id, step_idx)."""
    t = turns.groupBy("run_id").agg(F.count("*").alias("turns")).join(termination(turns), "run_id")
    s = segments.groupBy("run_id").agg(F.greatest(F.countDistinct("segment_index") - 1, F.lit(0)).alias("condensations"))
    c = calls.groupBy("run_id").agg(F.round(F.sum("execution_time"), 3).alias("tool_seconds"))
    out = t.join(s, "run_id", "left").join(c, "run_id", "left")
    out = out.join(resolved.select("run_id").distinct().withColumn("_solved", F.lit(True)), "run_id", "left") if resolved is not None else out.withColumn("_solved", F.lit(False))
    out = out.join(hints.groupBy("run_id").agg(F.countDistinct("step_idx").alias("_hinted")), "run_id", "left") if hints is not None else out.withColumn("_hinted", F.lit(0))
    return out.select(
        "run_id", "turns", "termination", F.coalesce("condensations", F.lit(0)).cast("long").alias("condensations"), F.coalesce("tool_seconds", F.lit(0.0)).alias("tool_seconds"),
        F.coalesce("_solved", F.lit(False)).alias("resolved"), F.coalesce("_hinted", F.lit(0)).cast("long").alias("hinted_turns"),
    )
