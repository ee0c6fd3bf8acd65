"""Rows of requests, samples and token buffers: projections, gates, clamps and fallbacks, nearly all single expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.text import xml_escape
from runloom.operators.blocks import place, scan
from runloom.operators.grading import END, START



def _ints(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<int>"))


# --- samples


def nested_sample(question: Column, ground_truth: Column, source: Column, index: Column, split: str, prefix: str = "Question: ", default_source: str = "unknown") -> Column:
    """struct of a task row: data_source, prompt messages, target as a list, index in its split. ``ground_truth`` is JSON: an object's
    field target, else itself; null is no target, a scalar one."""
    v = F.try_parse_json(ground_truth)
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    inner = F.when(kind.startswith("OBJECT") & F.try_variant_get(v, "$.target", "variant").isNotNull(), F.try_variant_get(v, "$.target", "variant")).otherwise(v)
    inner_kind = F.coalesce(F.schema_of_variant(inner), F.lit("VOID"))
    none = F.array().cast("array<string>")
    target = F.when(inner_kind == "VOID", none).when(inner_kind.startswith("ARRAY"), F.try_variant_get(inner, "$", "array<string>")).otherwise(F.array(F.try_variant_get(inner, "$", "string")))
    return F.struct(
        F.coalesce(F.nullif(source, F.lit("")), F.lit(default_source)).alias("data_source"), F.concat(F.lit(prefix.rstrip("\n")), F.coalesce(question, F.lit(""))).alias("user"),
        target.alias("target"), F.lit("rule").alias("style"), index.cast("long").alias("index"), F.lit(split).alias("split"),
    )


def without(df: DataFrame, column: str, skip: list[str]) -> DataFrame:
    """Rows whose id is not in a skip-list; rows without an id stay."""
    return df.where(~F.coalesce(F.col(column).isin(skip), F.lit(False))) if skip else df


def only(df: DataFrame, column: str, allowed: str | None) -> DataFrame:
    """Rows whose id a comma-separated list names, blanks around names dropped; all rows without a list."""
    names = [x.strip() for x in (allowed or "").split(",") if x.strip()]
    return df.where(F.col(column).isin(names)) if names else df


def task_key(repo: Column, commit: Column) -> Column:
    """``repo__commit``, the commit cut to ten characters."""
    return F.concat(repo, F.lit("__"), F.left(commit, F.lit(10)))


def head(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows in a total order; all of them for none, or a number below 1."""
    return df.orderBy(*order).limit(n) if n and n > 0 else df


# --- requests


def request_error(n: Column, response_format: Column, tool_choice: Column) -> Column:
    """Why a request is refused: more than one choice, a response format, a tool choice that is an object or required; null if it is not."""
    choice = F.lower(F.trim(tool_choice))
    return F.when(F.coalesce(n, F.lit(1)) != 1, "n_not_one").when(response_format.isNotNull(), "response_format").when(F.coalesce(choice.startswith("{") | (choice == "required"), F.lit(False)), "tool_choice")


def sampling(base: Column, asked: Column, allowed: tuple[str, ...] = ("temperature", "top_p", "top_k", "max_tokens")) -> Column:
    """A map of defaults with what a request asks for over them, as far as its keys are allowed."""
    mine = F.map_filter(F.coalesce(asked, F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*allowed))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(mine, k)), mine)


def valid_event(df: DataFrame, *needed: str) -> DataFrame:
    """Rows in which every one of the columns holds something."""
    keep = F.lit(True)
    for c in needed:
        keep = keep & (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return df.where(keep)


def message(m: Column) -> Column:
    """struct(role, content, tool_calls, tool_call_id, error) of a message as VARIANT.

    A missing or null content is empty, text stays and other values keep their JSON; arguments of calls that are JSON text are
    parsed where they can be. Errors, the first that applies: not_object, role, content (a number or truth value), tool_calls
    (no list, or an entry without a function object)."""
    get = lambda p, t: F.try_variant_get(m, p, t)
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    role, content, calls = get("$.role", "variant"), get("$.content", "variant"), get("$.tool_calls", "variant")
    listed = F.try_variant_get(calls, "$", "array<variant>")
    bad_call = F.exists(listed, lambda c: ~kind(F.try_variant_get(c, "$.function", "variant")).startswith("OBJECT"))
    error = (
        F.when(~kind(m).startswith("OBJECT"), "not_object").when((kind(role) != "STRING") | (get("$.role", "string") == ""), "role")
        .when(~kind(content).rlike("^(VOID|STRING|OBJECT|ARRAY)"), "content").when(calls.isNotNull() & (~kind(calls).startswith("ARRAY") | F.coalesce(bad_call, F.lit(False))), "tool_calls")
    )
    args = lambda c: F.try_variant_get(c, "$.function.arguments", "variant")
    parsed = lambda c: F.when(kind(args(c)) == "STRING", F.coalesce(F.try_parse_json(F.try_variant_get(args(c), "$", "string")), args(c))).otherwise(args(c))
    out_calls = F.transform(listed, lambda c: F.struct(F.try_variant_get(c, "$.id", "string").alias("id"), F.try_variant_get(c, "$.function.name", "string").alias("name"), F.to_json(parsed(c)).alias("arguments")))
    text = F.when(kind(content) == "VOID", "").when(kind(content) == "STRING", get("$.content", "string")).otherwise(F.to_json(content))
    return F.struct(get("$.role", "string").alias("role"), text.alias("content"), out_calls.alias("tool_calls"), get("$.tool_call_id", "string").alias("tool_call_id"), error.alias("error"))


def has_media(parts: Column) -> Column:
    """Whether an array of parts, struct(type, ...), holds an image or a video."""
    return F.coalesce(F.exists(parts, lambda p: p["type"].isin("image", "image_url", "video", "video_url")), F.lit(False))


def media_so_far(df: DataFrame, key: str, order: list[str], media: str) -> DataFrame:
    """(key, order, carried): how many media a request carries with those of all before it; null while there are none."""
    rows = df.select(key, *order, F.coalesce(F.size(media), F.lit(0)).alias("n"))
    s = scan(place(rows, [key], order[0]), order, sums={"all": F.col("n").cast("long")})
    return s.select(key, *order, F.nullif("all", F.lit(0).cast("long")).alias("carried"))


def api_message(role: Column, content: Column, tool_calls: Column, call_id: Column, name: Column) -> Column:
    """struct of what a message sends: content unless null, calls of the assistant only, id and name of tools only."""
    return F.struct(role.alias("role"), content.alias("content"), F.when(role == "assistant", tool_calls).alias("tool_calls"), F.when(role == "tool", call_id).alias("tool_call_id"), F.when(role == "tool", name).alias("name"))


def user_block(content: Column, header: str, at: Column | None = None, **fields: Column) -> Column:
    """A chat message under a header and a line for each field, one for its time if that is known; blanks at its end are dropped."""
    lines = [F.concat(F.lit(f"  {k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields.items()]
    time = [F.when(F.coalesce(at, F.lit("")) != "", F.concat(F.lit("  create_time_ms: "), at))] if at is not None else []
    return F.concat_ws("\n", F.lit(header), *lines, *time, F.concat(F.lit("\nContent:\n"), F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+$", ""), F.lit("\n")))


def system_with(messages: Column, manifest: Column) -> Column:
    """Messages, struct(role, content), with a manifest at the end of the first system message, or in one of its own before all others; unchanged for a blank one."""
    at = F.array_position(F.transform(messages, lambda m: m["role"]), "system")
    said = F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(i + 1 == at, F.concat_ws("\n\n", m["content"], manifest)).otherwise(m["content"]).alias("content")))
    own = F.concat(F.array(F.struct(F.lit("system").alias("role"), manifest.alias("content"))), F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    return F.when(F.coalesce(manifest, F.lit("")) == "", messages).when(at > 0, said).otherwise(own)


def skills_manifest(skills: DataFrame, key: str) -> DataFrame:
    """(key, manifest) of skills (key, name, description, path): a list of escaped blocks, by name. As long as a key's skills are many; keys without skills have no row."""
    told = F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.lit("(no description)"))
    tag = lambda name, x: F.concat(F.lit(f"    <{name}>"), xml_escape(x), F.lit(f"</{name}>"))
    block = F.concat_ws("\n", F.lit("  <skill>"), tag("name", F.col("name")), tag("description", told), tag("location", F.col("path")), F.lit("  </skill>"))
    rows = F.array_sort(F.collect_list(F.struct("name", block.alias("block"))))
    return skills.groupBy(key).agg(F.concat(F.lit("<available_skills>\n"), F.array_join(F.transform(rows, lambda r: r["block"]), "\n"), F.lit("\n</available_skills>")).alias("manifest"))


# --- token buffers


def mask_of(spans: Column, size: Column) -> Column:
    """A response's mask from its half-open spans: 1 where the model wrote, 0 elsewhere, ``size`` long."""
    inside = lambda i: F.exists(spans, lambda s: (s["span_start"] <= i) & (i < s["span_end"]))
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(inside(i), F.lit(False)).cast("tinyint"))).otherwise(F.array().cast("array<tinyint>"))


def append_observation(ids: Column, mask: Column, logprobs: Column, new: Column) -> Column:
    """struct(ids, mask, logprobs) with the tokens of an observation behind them: mask 0, logprobs 0.0 only where there are any."""
    n = F.size(_ints(new))
    zeros = F.array_repeat(F.lit(0).cast("tinyint"), n)
    probs = F.when(F.size(logprobs) > 0, F.concat(logprobs, F.array_repeat(F.lit(0.0), n))).otherwise(logprobs)
    return F.struct(F.concat(_ints(ids), _ints(new)).alias("ids"), F.concat(F.coalesce(mask, F.array().cast("array<tinyint>")), zeros).alias("mask"), probs.alias("logprobs"))


def clamp(ids: Column, logprobs: Column, cap: int) -> Column:
    """struct(ids, logprobs, capped) of a completion cut to ``cap`` tokens; capped: whether it reached them."""
    return F.struct(F.slice(ids, F.lit(1), F.lit(cap)).alias("ids"), F.slice(logprobs, F.lit(1), F.lit(cap)).alias("logprobs"), (F.size(ids) >= cap).alias("capped"))


def room(asked: Column, used: Column, limit: int) -> Column:
    """Tokens that may still be written: what is asked for, at most what is left, at least 1."""
    return F.greatest(F.lit(1), F.least(asked, F.lit(limit) - used))


def overflows(ids: Column, limit: int) -> Column:
    return F.coalesce(F.size(ids), F.lit(0)) >= limit


def incremental(ids: Column, prefix: Column) -> Column:
    """An encoding without the tokens of the system prompt before it."""
    return F.when(F.size(ids) > F.size(prefix), F.slice(ids, F.size(prefix) + 1, F.size(ids) - F.size(prefix))).otherwise(F.slice(ids, 1, 0))


def boundary(whole: Column, alone: Column, eos: Column) -> Column:
    """Tokens between the last end of a message and what follows it, where ``whole`` ends with ``alone``; none where it does not, or holds no end."""
    n, k = F.size(whole), F.size(alone)
    head = F.when(n > k, F.slice(whole, F.lit(1), n - k)).otherwise(F.slice(whole, 1, 0))
    ends = (n >= k) & (F.when(k > 0, F.slice(whole, n - k + 1, k)).otherwise(F.slice(whole, 1, 0)) == alone)
    last = F.size(head) - F.array_position(F.reverse(head), eos) + 1
    found = F.array_contains(head, eos)
    return F.when(ends & found, F.slice(head, F.greatest(last.cast("int") + 1, F.lit(1)), F.greatest(F.size(head) - last.cast("int"), F.lit(0)))).otherwise(F.slice(whole, 1, 0))


def masked_trajectory(mask: Column, eval_completed: Column, exit_reason: Column, abnormal: bool = True) -> Column:
    """A mask of zeros where the evaluation did not end or, if so set, the run did not finish; else the mask itself."""
    off = F.coalesce(eval_completed, F.lit(1.0)) < 1.0
    if abnormal:
        off = off | (F.coalesce(exit_reason, F.lit("")) != "finished")
    return F.when(off, F.transform(mask, lambda _: F.lit(0).cast("tinyint"))).otherwise(mask)


def trained_segments(segments: DataFrame, runs: DataFrame, key: str = "run_id", pad: int = 0, most_prompt: int = 1024, most_response: int = 512) -> DataFrame:
    """(run_id, segment_index, prompt_ids, response_ids, response_mask, masked): segments with a mask; one made-up row, masked, of padding for each of ``runs`` without any."""
    full = segments.where(F.size("response_mask") > 0)
    none = runs.select(key).distinct().join(full.select(key).distinct(), key, "left_anti")
    prompts = segments.groupBy(key).agg(F.min_by("prompt_ids", "segment_index").alias("p"))
    n = min(512, most_response)
    made = none.join(prompts, key, "left").select(
        key, F.lit(0).alias("segment_index"), F.slice(_ints(F.col("p")), F.lit(1), F.lit(most_prompt)).alias("prompt_ids"), F.array_repeat(F.lit(pad), n).alias("response_ids"), F.array_repeat(F.lit(0).cast("tinyint"), n).alias("response_mask"), F.lit(True).alias("masked"),
    )
    return full.select(key, "segment_index", "prompt_ids", "response_ids", "response_mask", F.lit(False).alias("masked")).unionByName(made)


def zero_experts(length: Column, layers: int, top_k: int) -> Column:
    """A tensor of zeros for the routing of a response; null for a dense model."""
    return F.array_repeat(F.array_repeat(F.array_repeat(F.lit(0), top_k), layers), length) if layers > 0 and top_k > 0 else F.lit(None).cast("array<array<array<int>>>")


def failure_reason(setup_done: Column, error: Column) -> Column:
    """Why a run has no result: its setup timed out, or anything else."""
    return F.when(~F.coalesce(setup_done, F.lit(False)) & F.coalesce(error.contains("Timeout"), F.lit(False)), "setup_timeout").otherwise("agent_loop_failed")


def outcome_text(resolved: Column, reward: Column, termination: Column, turns: Column) -> Column:
    return F.concat(F.lit("resolved: "), F.when(resolved, "True").otherwise("False"), F.lit(" | reward: "), F.coalesce(reward.cast("string"), F.lit("None")), F.lit(" | termination: "), termination, F.lit(" | turns: "), turns.cast("string"))


def usage(prompt: Column, completion: Column, text: Column) -> Column:
    """struct(prompt, completion, total): as reported, else no prompt and as many tokens as words, at least 1."""
    words = F.greatest(F.lit(1), F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")))
    p, c = F.coalesce(prompt, F.lit(0)).cast("long"), F.coalesce(completion, words).cast("long")
    return F.struct(p.alias("prompt"), c.alias("completion"), (p + c).alias("total"))


def preemptions(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, preemptions): a group's sum, where a missing value counts -1 if it is the first and nothing later."""
    first = F.min_by(F.coalesce(F.col(value), F.lit(-1)), F.struct(*order))
    known = F.sum(F.coalesce(value, F.lit(0)))
    return df.groupBy(key).agg((known + F.when(first == -1, F.when(F.min_by(F.col(value).isNull(), F.struct(*order)), -1).otherwise(0)).otherwise(0)).cast("long").alias("preemptions"))


def step_range(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, first, last): the value of a group's first row, null or not, and the last one that is not null."""
    at = F.struct(*order)
    return df.groupBy(key).agg(F.min_by(value, at).alias("first"), F.max_by(value, F.when(F.col(value).isNotNull(), at)).alias("last"))


def identity(**columns: Column) -> Column:
    """A JSON object of the columns that are not null."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in columns.items()]))


# --- joins by id


def documents_of(results: DataFrame, documents: DataFrame) -> DataFrame:
    """``results`` (query_id, rank, doc_id) with text and, where there is no such document, an error."""
    d = documents.select("doc_id", "text", F.lit(True).alias("there"))
    return results.join(d, "doc_id", "left").select("query_id", "rank", "doc_id", "text", F.when(F.col("there").isNull(), F.concat(F.lit("no document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("error"))


def call_states(messages: DataFrame, results: DataFrame) -> DataFrame:
    """``messages`` (run_id, step_idx, tool_call_id) with the state of their calls; a call without a result was rejected."""
    return messages.select("run_id", "step_idx", "tool_call_id").join(results.select("run_id", "step_idx", "tool_call_id", "status"), ["run_id", "step_idx", "tool_call_id"], "left").select("run_id", "step_idx", "tool_call_id", F.coalesce("status", F.lit("rejected")).alias("status"))


def results_of(samples: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """``samples`` with their results by id; samples without one have an error, and results without a sample no row."""
    r = results.withColumn("_there", F.lit(True))
    return samples.join(r, key, "left").withColumn("error", F.when(F.col("_there").isNull(), "no result")).drop("_there")


def union_spans(segments: DataFrame, key: str = "run_id") -> DataFrame:
    """(run_id, step, span_start, span_end): all spans of a run's segments, a step's first by segment."""
    spans = segments.select(key, "segment_index", F.explode("turn_spans").alias("s")).select(key, "segment_index", "s.step", "s.span_start", "s.span_end")
    return spans.groupBy(key, "step").agg(F.min(F.struct("segment_index", "span_start", "span_end")).alias("f")).select(key, "step", "f.span_start", "f.span_end")


def least_loaded(servers: DataFrame, key: str, load: str, name: str) -> DataFrame:
    """(key, name): per key the server with the least load, ties to the lowest name."""
    return servers.groupBy(key).agg(F.min(F.struct(load, name)).alias("m")).select(key, f"m.{name}")


# --- scripts and prompts

# Ends of output after which a program waits for input.
PROMPTS = (r">>> $", r"In \[\d+\]: $", r"\.\.\. $", r"\(Pdb\) $", r"ipdb> $", r"\[Y/n\]", r"\[y/N\]", r"\(y/n\)", r"File to patch: $", r"\? $")


def waits(output: Column) -> Column:
    """Whether an output ends with a prompt; blanks may follow a prompt that is not anchored itself."""
    ends = "|".join(p if p.endswith("$") else p + r"\s*$" for p in PROMPTS)
    return F.coalesce(F.right(output, F.lit(200)).rlike(f"(?:{ends})"), F.lit(False))


def test_command(command: Column) -> Column:
    """A test command with long tracebacks: its --tb option set, or one put at its end, if it runs pytest."""
    long = F.regexp_replace(command, r"--tb[= ]\S+", "--tb=long")
    return F.when(~command.contains("pytest"), command).when(command.rlike(r"--tb[= ]\S+"), long).otherwise(F.concat(command, F.lit(" --tb=long")))


def eval_script(base: Column, setup: Column, test_files: Column, patch: Column, command: Column) -> Column:
    """The lines that evaluate a change: setup, only the test files that the patch touches reset, the patch, the command between markers, the files reset again."""
    reset = F.when(F.size(test_files) > 0, F.concat(F.lit("git checkout "), base, F.lit(" "), F.array_join(test_files, " "))).otherwise("echo 'skip reset'")
    lines = F.array(F.lit("set -uxo pipefail"), setup, reset, F.when(F.coalesce(patch, F.lit("")) != "", F.concat(F.lit("git apply -v - <<'EOF'\n"), patch, F.lit("\nEOF"))), F.lit(f": '{START}'"), command, F.lit(f": '{END}'"), reset)
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def failed_rows(df: DataFrame, error: str, name: str) -> DataFrame:
    """(name, resolved, reward, error) of rows with an error, as results."""
    return df.where(F.col(error).isNotNull()).select(name, F.lit(False).alias("resolved"), F.lit(0.0).alias("reward"), F.col(error).alias("error"))
