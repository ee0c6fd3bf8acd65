"""Queries of samples, requests and token buffers, each with the DuckDB SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.functions import text as T
from runloom.operators import grading, messages, prep, samples, sequence
from runloom.plans.agent_queries import _C, _T, PLACE, calls, turns
from runloom.plans.registering import collection
from runloom.sources.tables import table

QUERIES, SQL, query = collection()


@query("""SELECT doc_id, CASE WHEN coalesce(source, '') = '' THEN 'unknown' ELSE source END AS data_source, 'Question: ' || coalesce(title, '') AS "user", CASE doc_id % 5 WHEN 0 THEN 'a|2' WHEN 1 THEN 'x' WHEN 2 THEN '7' WHEN 3 THEN '' ELSE 'p|q' END AS target, doc_id AS "index" FROM documents""")
def nested_samples(spark, d):
    """Documents as task rows, their targets given in all ways."""
    m = F.col("doc_id") % 5
    truth = F.when(m == 0, '["a", 2]').when(m == 1, '{"target": "x"}').when(m == 2, "7").when(m == 3, "null").otherwise('{"target": ["p", "q"]}')
    s = table(spark, d, "documents").select("doc_id", samples.nested_sample(F.col("title"), truth, F.col("source"), F.col("doc_id"), "train").alias("s"))
    return s.select("doc_id", "s.data_source", "s.user", F.array_join("s.target", "|").alias("target"), "s.index")


@query("""SELECT doc_id, repo, lower(replace(repo || '__' || left(md5(text), 10), '__', '_1776_')) AS image, repo || '__' || left(md5(text), 10) AS task FROM documents WHERE text IS NOT NULL AND repo IS NOT NULL AND doc_id NOT IN (3, 5, 8) AND lang IN ('en', 'de')""")
def sample_filters(spark, d):
    """Documents as tasks: of some languages, without those to skip and those without an image."""
    x = samples.only(samples.without(table(spark, d, "documents"), "doc_id", [3, 5, 8]), "lang", " en, de ,")
    key = samples.task_key(F.col("repo"), F.md5("text"))
    return x.select("doc_id", "repo", prep.image_name(key).alias("image"), key.alias("task")).where("image is not null")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def head_limit(spark, d):
    return samples.head(table(spark, d, "documents").select("doc_id"), 25, "doc_id")


@query("""SELECT doc_id, '<issue>' || chr(10) || coalesce(title, '') || chr(10) || '</issue>' || chr(10) || 'In ' || coalesce(repo, '') || '.' AS prompt FROM documents""")
def prompts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fill("<issue>\n{problem}\n</issue>\nIn {repo}.", problem=F.coalesce("title", F.lit("")), repo=F.coalesce("repo", F.lit(""))).alias("prompt"))


@query("SELECT delivery_id FROM chat_events WHERE coalesce(chat_id, '') <> '' AND coalesce(message_id, '') <> '' AND coalesce(sender_id, '') <> ''")
def valid_events(spark, d):
    return samples.valid_event(table(spark, d, "chat_events"), "chat_id", "message_id", "sender_id").select("delivery_id")


@query("SELECT delivery_id FROM chat_events WHERE sender_id <> 'bot' AND message_type IN ('text', 'post')")
def source_predicate(spark, d):
    """The filter of an event source."""
    return table(spark, d, "chat_events").where("sender_id <> 'bot' and message_type in ('text', 'post')").select("delivery_id")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'n_not_one' WHEN 1 THEN 'response_format' WHEN 2 THEN 'tool_choice' WHEN 3 THEN 'tool_choice' END AS error, CASE WHEN event_id % 2 = 0 THEN '0.5' ELSE '1.0' END AS temperature, CASE WHEN event_id % 3 = 0 THEN '64' END AS max_tokens, CAST(CASE WHEN event_id % 3 = 0 THEN 3 ELSE 2 END AS INT) AS keys FROM events")
def request_gates(spark, d):
    """Requests refused, and sampling parameters over their defaults."""
    e, m = table(spark, d, "events"), F.col("event_id") % 5
    error = samples.request_error(F.when(m == 0, 2), F.when(m == 1, "json"), F.when(m == 2, '{"type": "function"}').when(m == 3, "Required").otherwise("auto"))
    base = F.create_map(F.lit("temperature"), F.lit("1.0"), F.lit("top_p"), F.lit("0.9"))
    asked = F.map_from_entries(F.filter(F.array(F.when(F.col("event_id") % 2 == 0, F.struct(F.lit("temperature").alias("k"), F.lit("0.5").alias("v"))), F.when(F.col("event_id") % 3 == 0, F.struct(F.lit("max_tokens").alias("k"), F.lit("64").alias("v"))), F.struct(F.lit("user").alias("k"), F.lit("x").alias("v"))), lambda x: x.isNotNull()))
    s = samples.sampling(base, asked)
    return e.select("event_id", error.alias("error"), F.try_element_at(s, F.lit("temperature")).alias("temperature"), F.try_element_at(s, F.lit("max_tokens")).alias("max_tokens"), F.size(s).alias("keys"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'user' END AS role, CASE event_id % 8 WHEN 0 THEN 'hi ' || event_id WHEN 4 THEN '[1,2]' WHEN 5 THEN 'x' WHEN 6 THEN 'x' WHEN 7 THEN 'x' ELSE '' END AS content, CASE WHEN event_id % 8 = 5 THEN '{"a":1,"b":2}' WHEN event_id % 8 = 7 THEN '"{broken"' END AS arguments, CASE event_id % 8 WHEN 1 THEN 'not_object' WHEN 2 THEN 'role' WHEN 6 THEN 'tool_calls' END AS error FROM events""")
def normalized_messages(spark, d):
    """Messages of every form, made one."""
    n, m = F.col("event_id").cast("string"), F.col("event_id") % 8
    text = (
        F.when(m == 0, F.concat(F.lit('{"role": "user", "content": "hi '), n, F.lit('", "extra": 1}'))).when(m == 1, "[]").when(m == 2, '{"role": 3}').when(m == 3, '{"role": "user", "content": null}')
        .when(m == 4, '{"role": "user", "content": [1, 2]}').when(m == 5, '{"role": "user", "content": "x", "tool_calls": [{"id": "c", "function": {"name": "f", "arguments": "{\\"b\\": 2, \\"a\\": 1}"}}]}')
        .when(m == 6, '{"role": "user", "content": "x", "tool_calls": [{"id": "c"}]}').otherwise('{"role": "user", "content": "x", "tool_calls": [{"id": "c", "function": {"name": "f", "arguments": "{broken"}}]}')
    )
    x = table(spark, d, "events").select("event_id", samples.message(F.try_parse_json(text)).alias("m"))
    return x.select("event_id", F.when(m != 2, F.col("m.role")).alias("role"), F.coalesce("m.content", F.lit("")).alias("content"), F.get(F.transform("m.tool_calls", lambda c: c["arguments"]), F.lit(0)).alias("arguments"), "m.error")


@query(f"""WITH {_C} SELECT call_id, status IN ('timeout', 'skipped') AS media, coalesce(observation, '') AS content, CASE WHEN tool_name = 'search' THEN action END AS tool_calls, CASE WHEN tool_name = 'execute_bash' THEN tool_call_id END AS tool_call_id FROM calls1""")
def api_messages(spark, d):
    """Calls as messages to send: searches play the assistant, commands the tools."""
    role = F.when(F.col("tool_name") == "search", "assistant").when(F.col("tool_name") == "execute_bash", "tool").otherwise("user")
    parts = F.array(F.struct(F.lit("text").alias("type")), F.struct(F.when(F.col("status") == "timeout", "image_url").when(F.col("status") == "skipped", "video").otherwise("text").alias("type")))
    m = samples.api_message(role, F.coalesce("observation", F.lit("")), F.col("action"), F.col("tool_call_id"), F.col("tool_name"))
    return calls(spark, d, "tool_name", "status", "observation", "action", "tool_call_id").select("call_id", samples.has_media(parts).alias("media"), m.alias("m")).select("call_id", "media", "m.content", "m.tool_calls", "m.tool_call_id")


@query(f"""WITH {_C} SELECT run_id, step_idx, call_idx, call_id, CAST(nullif(sum(CASE WHEN status = 'timeout' THEN 2 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY step_idx, call_idx, call_id ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS carried FROM calls1""")
def media_carried(spark, d):
    c = calls(spark, d, *PLACE, "status").withColumn("media", F.when(F.col("status") == "timeout", F.array(F.lit("a"), F.lit("b"))))
    return samples.media_so_far(c, "run_id", ["step_idx", "call_idx", "call_id"], "media")


@query("""SELECT delivery_id, concat_ws(chr(10), '[New message]', '  chat: ' || coalesce(chat_id, ''), '  sender: ' || coalesce(sender_id, ''), CASE WHEN coalesce(create_time, '') <> '' THEN '  create_time_ms: ' || create_time END, chr(10) || 'Content:' || chr(10) || regexp_replace(coalesce(content, ''), '\\s+$', '') || chr(10)) AS block FROM chat_events""")
def user_blocks(spark, d):
    return table(spark, d, "chat_events").select("delivery_id", samples.user_block(F.col("content"), "[New message]", F.col("create_time"), chat=F.col("chat_id"), sender=F.col("sender_id")).alias("block"))


_X = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_MANIFEST = f"""mf AS (SELECT repo, '<available_skills>' || chr(10) || string_agg('  <skill>' || chr(10) || '    <name>' || {_X.format("n")} || '</name>' || chr(10) || '    <description>' || {_X.format("coalesce(nullif(trim(title), ''), '(no description)')")} || '</description>' || chr(10) || '    <location>/s/' || doc_id || '</location>' || chr(10) || '  </skill>', chr(10) ORDER BY n) || chr(10) || '</available_skills>' AS manifest FROM (SELECT *, 's' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS n FROM documents WHERE lang = 'de' AND repo IS NOT NULL) GROUP BY repo)"""


def _manifests(spark, d):
    x = table(spark, d, "documents").where("lang = 'de' and repo is not null").select("repo", F.concat(F.lit("s"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("name"), F.col("title").alias("description"), F.concat(F.lit("/s/"), F.col("doc_id").cast("string")).alias("path"))
    return samples.skills_manifest(x, "repo")


@query(f"WITH {_MANIFEST} SELECT * FROM mf")
def skills_manifests(spark, d):
    """German documents of each repository as skills."""
    return _manifests(spark, d)


@query(f"WITH {_MANIFEST} SELECT repo, 'user:a|system:be brief' || chr(10) || chr(10) || manifest || '|system:c' AS first, 'system:' || manifest || '|user:a' AS own FROM mf")
def manifests_injected(spark, d):
    msg = lambda r, c: F.struct(F.lit(r).alias("role"), F.lit(c).alias("content"))
    shown = lambda ms: F.array_join(F.transform(ms, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    m = F.col("manifest")
    return _manifests(spark, d).select("repo", shown(samples.system_with(F.array(msg("user", "a"), msg("system", "be brief"), msg("system", "c")), m)).alias("first"), shown(samples.system_with(F.array(msg("user", "a")), m)).alias("own"))


def _segments(spark, d):
    return table(spark, d, "segments").select("run_id", "segment_index", "prompt_ids", "response_ids", "response_mask", "response_logprobs", "turn_spans").distinct()


_S = "sg AS (SELECT DISTINCT * FROM segments)"


@query(f"""WITH {_S} SELECT run_id, segment_index, CAST(len(response_ids) AS INT) AS tokens, CAST(coalesce(list_sum(response_mask), 0) AS BIGINT) AS ones, true AS equal FROM sg WHERE len(response_ids) > 0 AND len(response_mask) = len(response_ids)""")
def built_masks(spark, d):
    """Masks built from the spans of turns, held against the ones stored."""
    s = _segments(spark, d).where("size(response_ids) > 0 and size(response_mask) = size(response_ids)")
    built = samples.mask_of(F.col("turn_spans"), F.size("response_ids"))
    s = s.withColumn("built", built)
    return s.select("run_id", "segment_index", F.size("response_ids").alias("tokens"), F.aggregate("built", F.lit(0).cast("long"), lambda a, x: a + x).alias("ones"), (F.col("built") == F.col("response_mask")).alias("equal"))


@query(f"""WITH {_S} SELECT run_id, segment_index, CAST(len(response_ids) + 3 AS INT) AS ids, CAST(coalesce(list_sum(response_mask), 0) AS BIGINT) AS ones, CAST(len(response_logprobs) + CASE WHEN len(response_logprobs) > 0 THEN 3 ELSE 0 END AS INT) AS probs,
 CAST(least(len(response_ids), 64) AS INT) AS clamped, len(response_ids) >= 64 AS capped, greatest(1, least(100, 512 - len(response_ids)))::INT AS room, len(response_ids) >= 256 AS overflow FROM sg WHERE response_ids IS NOT NULL AND response_logprobs IS NOT NULL AND response_mask IS NOT NULL""")
def buffer_steps(spark, d):
    """An observation of three tokens appended, a completion cut to 64, room for more, and overflow."""
    s = _segments(spark, d).where("response_ids is not null and response_logprobs is not null and response_mask is not null")
    a = samples.append_observation(F.col("response_ids"), F.col("response_mask"), F.col("response_logprobs"), F.array(F.lit(1), F.lit(2), F.lit(3)))
    c = samples.clamp(F.col("response_ids"), F.col("response_logprobs"), 64)
    n = F.size("response_ids")
    return s.select(
        "run_id", "segment_index", F.size(a["ids"]).alias("ids"), F.aggregate(a["mask"], F.lit(0).cast("long"), lambda t, x: t + x).alias("ones"), F.size(a["logprobs"]).alias("probs"),
        F.size(c["ids"]).alias("clamped"), c["capped"].alias("capped"), samples.room(F.lit(100), n, 512).alias("room"), samples.overflows(F.col("response_ids"), 256).alias("overflow"),
    )


@query(f"""WITH {_S}, w AS (SELECT run_id, segment_index, coalesce(prompt_ids, []) AS p, coalesce(response_ids, []) AS r FROM sg)
SELECT run_id, segment_index, array_to_string(r, ',') AS added, '7,8' AS bound, CAST(least(len(p), 32) AS INT) AS prompt, CAST(least(len(r), 48) AS INT) AS response FROM w WHERE len(r) > 0""")
def buffer_parts(spark, d):
    """A continuation without its system prompt, the tokens between messages, and buffers cut into prompt and response."""
    none = F.array().cast("array<int>")
    p, r = F.coalesce("prompt_ids", none), F.coalesce("response_ids", none)
    whole = F.concat(p, F.array(F.lit(-5), F.lit(7), F.lit(8)), r)
    split = sequence.split_response(F.concat(p, r), F.transform(r, lambda _: F.lit(1)), 32, 48)
    s = _segments(spark, d).where(F.size(r) > 0)
    return s.select("run_id", "segment_index", F.array_join(samples.incremental(F.concat(p, r), p), ",").alias("added"), F.array_join(samples.boundary(whole, r, F.lit(-5)), ",").alias("bound"), F.size(split["prompt"]).alias("prompt"), F.size(split["response"]).alias("response"))


@query(f"""WITH {_S}, f AS (SELECT run_id, segment_index, false AS masked, CAST(len(response_ids) AS INT) AS n FROM sg WHERE len(response_mask) > 0), r AS (SELECT DISTINCT run_id FROM turns UNION SELECT 'made-up') SELECT * FROM f UNION ALL SELECT run_id, 0, true, 40 FROM r WHERE run_id NOT IN (SELECT run_id FROM f)""")
def trained_segments(spark, d):
    """Segments to train on; a run without any, here also one that is nowhere, has a masked row of padding."""
    runs = table(spark, d, "turns").select("run_id").where("run_id is not null").distinct().union(spark.createDataFrame([("made-up",)], "run_id string"))
    s = samples.trained_segments(_segments(spark, d), runs, most_response=40)
    return s.select("run_id", "segment_index", "masked", F.size("response_ids").alias("n"))


@query(f"""WITH {_S}, {_T}, l AS (SELECT run_id, arg_max(coalesce(exit_reason, ''), (step_idx, turn_id)) AS e FROM turns1 GROUP BY run_id) SELECT sg.run_id, segment_index, CASE WHEN e <> 'finished' THEN 0 ELSE CAST(coalesce(list_sum(response_mask), 0) AS BIGINT) END AS ones, CAST(len(response_mask) AS INT) AS n, CAST(len(response_ids) * 6 AS BIGINT) AS experts FROM sg JOIN l ON l.run_id = sg.run_id WHERE response_mask IS NOT NULL AND response_ids IS NOT NULL""")
def masked_trajectories(spark, d):
    """Masks of runs that did not finish set to zero; routing tensors of zeros."""
    at = F.struct("step_idx", "turn_id")
    e = turns(spark, d, "run_id", "step_idx", "exit_reason").groupBy("run_id").agg(F.max_by(F.coalesce("exit_reason", F.lit("")), at).alias("e"))
    m = samples.masked_trajectory(F.col("response_mask"), F.lit(1.0), F.col("e"))
    s = _segments(spark, d).where("response_mask is not null and response_ids is not null").join(e, "run_id")
    z = F.flatten(F.flatten(samples.zero_experts(F.size("response_ids"), 3, 2)))
    return s.select("run_id", "segment_index", F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + x).alias("ones"), F.size(m).alias("n"), F.size(z).cast("long").alias("experts"))


@query(f"""WITH {_T}, l AS (SELECT run_id, arg_max(exit_reason, (step_idx, turn_id)) AS e, count(*) AS n, max(tokens) AS t FROM turns1 GROUP BY run_id) SELECT run_id, CASE WHEN n % 2 = 0 AND n % 3 = 0 THEN 'setup_timeout' ELSE 'agent_loop_failed' END AS reason, 'resolved: ' || CASE WHEN n % 2 = 0 THEN 'True' ELSE 'False' END || ' | reward: ' || coalesce(CAST(t AS VARCHAR), 'None') || ' | termination: ' || coalesce(e, '?') || ' | turns: ' || n AS outcome FROM l""")
def run_endings(spark, d):
    """Why runs have no result, and their outcome as a line."""
    at = F.struct("step_idx", "turn_id")
    r = turns(spark, d, "run_id", "step_idx", "exit_reason", "tokens").groupBy("run_id").agg(F.max_by("exit_reason", at).alias("e"), F.count("*").alias("n"), F.max("tokens").alias("t"))
    reason = samples.failure_reason(F.when(F.col("n") % 2 == 1, True), F.when(F.col("n") % 3 == 0, "TimeoutError()").otherwise("ValueError"))
    return r.select("run_id", reason.alias("reason"), samples.outcome_text(F.col("n") % 2 == 0, F.col("t"), F.coalesce("e", F.lit("?")), F.col("n")).alias("outcome"))


@query(rf"""WITH {_T}, u AS (SELECT run_id, CASE WHEN turn_id % 2 = 0 THEN 5 ELSE 0 END AS p, coalesce(tokens, greatest(1, len(list_filter(regexp_split_to_array(coalesce(response, ''), '\s+'), lambda w: w <> '')))) AS c FROM turns1) SELECT run_id, CAST(sum(p) AS BIGINT) AS prompt, CAST(sum(c) AS BIGINT) AS completion, CAST(sum(p + c) AS BIGINT) AS total FROM u GROUP BY run_id""")
def token_usage(spark, d):
    """Tokens of each run; a turn without a count has as many as it has words."""
    u = samples.usage(F.when(F.col("turn_id") % 2 == 0, 5), F.col("tokens"), F.col("response"))
    return turns(spark, d, "run_id", "tokens", "response").select("run_id", u.alias("u")).groupBy("run_id").agg(*[F.sum(f"u.{c}").alias(c) for c in ("prompt", "completion", "total")])


@query(f"""WITH {_T}, n AS (SELECT *, CASE WHEN turn_id % 3 > 0 THEN tokens END AS v, row_number() OVER (PARTITION BY run_id ORDER BY step_idx, turn_id) AS k FROM turns1) SELECT run_id, CAST(sum(CASE WHEN v IS NULL THEN CASE WHEN k = 1 THEN -1 ELSE 0 END ELSE v END) AS BIGINT) AS preemptions, any_value(v) FILTER (WHERE k = 1) AS first, arg_max(v, k) FILTER (WHERE v IS NOT NULL) AS last FROM n GROUP BY run_id""")
def step_counters(spark, d):
    """Sums that begin at -1 for a missing value, first and last known values."""
    t = turns(spark, d, "run_id", "step_idx", "tokens").withColumn("v", F.when(F.col("turn_id") % 3 > 0, F.col("tokens")))
    order = ["step_idx", "turn_id"]
    return samples.preemptions(t, "run_id", order, "v").join(samples.step_range(t, "run_id", order, "v"), "run_id")


@query(f"""WITH {_C}, r AS (SELECT call_id AS query_id, CAST(call_idx AS INT) AS rank, CASE WHEN call_id % 10 = 0 THEN NULL WHEN call_id % 10 = 1 THEN -1 ELSE call_id % 500 END AS doc_id FROM calls1) SELECT query_id, rank, r.doc_id, text, CASE WHEN d.doc_id IS NULL THEN 'no document ' || coalesce(CAST(r.doc_id AS VARCHAR), 'null') END AS error FROM r LEFT JOIN documents d ON d.doc_id = r.doc_id""")
def documents_by_id(spark, d):
    r = calls(spark, d, "call_idx").select(F.col("call_id").alias("query_id"), F.col("call_idx").alias("rank"), F.when(F.col("call_id") % 10 == 1, -1).when(F.col("call_id") % 10 > 1, F.col("call_id") % 500).cast("long").alias("doc_id"))
    return samples.documents_of(r, table(spark, d, "documents"))


@query(f"""WITH {_C} SELECT run_id, step_idx, tool_call_id, CASE WHEN call_id % 4 = 0 THEN 'rejected' ELSE coalesce(status, 'rejected') END AS status FROM calls1 WHERE tool_call_id IS NOT NULL AND run_id IS NOT NULL AND step_idx IS NOT NULL QUALIFY count(*) OVER (PARTITION BY run_id, step_idx, tool_call_id) = 1""")
def call_states(spark, d):
    """States of the calls that messages name; every fourth has no result."""
    from pyspark.sql import Window as W

    c = calls(spark, d, "run_id", "step_idx", "tool_call_id", "status").where("tool_call_id is not null and run_id is not null and step_idx is not null")
    c = c.withColumn("n", F.count("*").over(W.partitionBy("run_id", "step_idx", "tool_call_id"))).where("n = 1")
    return samples.call_states(c, c.where("call_id % 4 > 0"))


@query(f"""WITH {_T}, r AS (SELECT turn_id, tokens FROM turns1 WHERE turn_id % 3 > 0) SELECT t.turn_id, r.tokens, CASE WHEN r.turn_id IS NULL THEN 'no result' END AS error FROM turns1 t LEFT JOIN r ON r.turn_id = t.turn_id WHERE t.turn_id IS NOT NULL""")
def results_by_id(spark, d):
    t = turns(spark, d).where("turn_id is not null")
    return samples.results_of(t, turns(spark, d, "tokens").where("turn_id % 3 > 0"), "turn_id")


@query(f"WITH {_T} SELECT turn_id, false AS resolved, 0.0::DOUBLE AS reward, 'failed with ' || exit_reason AS error FROM turns1 WHERE exit_reason NOT IN ('', 'finished')")
def failed_rows(spark, d):
    t = turns(spark, d, "exit_reason").withColumn("error", F.when(~F.col("exit_reason").isin("", "finished"), F.concat(F.lit("failed with "), F.col("exit_reason"))))
    return samples.failed_rows(t, "error", "turn_id")


@query(f"""WITH {_S}, x AS (SELECT run_id, segment_index, unnest(turn_spans) AS s FROM sg) SELECT run_id, s.step AS step, arg_min(s.span_start, (segment_index, s.span_start, s.span_end)) AS span_start, arg_min(s.span_end, (segment_index, s.span_start, s.span_end)) AS span_end FROM x GROUP BY run_id, s.step""")
def union_spans(spark, d):
    return samples.union_spans(_segments(spark, d))


@query("SELECT event_type AS grp, arg_min(event_id, (value, event_id)) AS server FROM events GROUP BY 1")
def least_loaded(spark, d):
    return samples.least_loaded(table(spark, d, "events").select(F.col("event_type").alias("grp"), "value", F.col("event_id").alias("server")), "grp", "value", "server")


@query(f"""WITH {_C} SELECT call_id, call_id % 4 < 3 AS waits, CASE WHEN call_id % 3 = 0 THEN 'pytest -q --tb=long x' WHEN call_id % 3 = 1 THEN 'pytest -q --tb=long' ELSE 'make test --tb=no' END AS command,
 'set -uxo pipefail' || chr(10) || CASE WHEN call_id % 2 = 0 THEN 'git checkout c0 a.py b.py' ELSE 'echo ''skip reset''' END || chr(10) || 'git apply -v - <<''EOF''' || chr(10) || 'p' || call_id || chr(10) || 'EOF' || chr(10) || ': ''{grading.START}''' || chr(10) || 'run' || chr(10) || ': ''{grading.END}''' || chr(10) || CASE WHEN call_id % 2 = 0 THEN 'git checkout c0 a.py b.py' ELSE 'echo ''skip reset''' END AS script FROM calls1""")
def scripts(spark, d):
    """Outputs that wait, test commands with long tracebacks, scripts that evaluate a change."""
    n, m = F.col("call_id").cast("string"), F.col("call_id") % 4
    out = F.concat(F.lit("text\n"), F.when(m == 0, "In [3]: ").when(m == 1, "Go on? [Y/n] ").when(m == 2, "(Pdb) ").otherwise("done.\n"))
    command = F.when(F.col("call_id") % 3 == 0, "pytest -q --tb=no x").when(F.col("call_id") % 3 == 1, "pytest -q").otherwise("make test --tb=no")
    files = F.when(F.col("call_id") % 2 == 0, F.array(F.lit("a.py"), F.lit("b.py"))).otherwise(F.array().cast("array<string>"))
    script = samples.eval_script(F.lit("c0"), F.lit(None).cast("string"), files, F.concat(F.lit("p"), n), F.lit("run"))
    return calls(spark, d).select("call_id", samples.waits(out).alias("waits"), samples.test_command(command).alias("command"), script.alias("script"))


@query(f"""WITH {_T} SELECT turn_id, CAST(json_extract_string(j, '$.run_id') AS VARCHAR) AS run_id, CAST(len(json_keys(j)) AS INT) AS keys FROM (SELECT turn_id, CAST(CASE WHEN run_id IS NULL THEN '{{"uid":1}}' WHEN turn_id % 2 = 0 THEN json_object('uid', 1, 'run_id', run_id, 'extra', 2) ELSE json_object('uid', 1, 'run_id', run_id) END AS JSON) AS j FROM turns1)""")
def identities(spark, d):
    """What a record keeps of who it is from, nulls dropped."""
    j = samples.identity(uid=F.lit(1), run_id=F.col("run_id"), extra=F.when(F.col("turn_id") % 2 == 0, 2))
    v = F.try_parse_json(j)
    return turns(spark, d, "run_id").select("turn_id", F.try_variant_get(v, "$.run_id", "string").alias("run_id"), F.size(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))).alias("keys"))


@query(f"""WITH {_C} SELECT run_id, count(*) FILTER (WHERE tool_name IN ('search', 'execute_bash')) + 1 AS turns FROM calls1 GROUP BY run_id""")
def chat_turns(spark, d):
    """Messages of user and assistant, and one."""
    role = F.when(F.col("tool_name") == "search", "user").when(F.col("tool_name") == "execute_bash", "assistant").otherwise("tool")
    return messages.turn_count(calls(spark, d, "run_id", "tool_name").select(F.col("run_id").alias("conv_id"), role.alias("role"))).withColumnRenamed("conv_id", "run_id")


@query("""SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS clipped, least(30.0, 2.0 * pow(2, doc_id % 7)) AS wait, '  a' || chr(10) || chr(10) || '    b ' || doc_id AS right_, 'a' || chr(10) || 'b ' || doc_id AS left_, doc_id % 2 = 0 AS same FROM documents""")
def small_texts(spark, d):
    """Prefix clips, waits before a retry, indents moved either way, JSON compared whatever its order."""
    n = F.col("doc_id").cast("string")
    body = F.concat(F.lit("a\n\n  b "), n)
    one, two = F.concat(F.lit('{"a": 1, "b": ['), n, F.lit("]}")), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"b":['), n, F.lit('],"a":1}'))).otherwise("{broken")
    return table(spark, d, "documents").select(
        "doc_id", T.clip(F.col("text"), 40).alias("clipped"), T.backoff(F.col("doc_id") % 7).alias("wait"), T.shift_indent(body, 2).alias("right_"), T.shift_indent(F.concat(F.lit("  a\n b "), n), -2).alias("left_"),
        (messages.canonical(one) == messages.canonical(two)).alias("same"),
    )


@query(f"WITH {_T} SELECT run_id, count(*) AS messages, CAST(greatest(2000, (greatest(0, sum(length(coalesce(response, ''))) - 3000) + 1024) * 2 * 4) AS BIGINT) AS budget FROM turns1 GROUP BY run_id")
def condense_budgets(spark, d):
    """Characters that each run's history would have to lose at a second attempt."""
    t = turns(spark, d, "run_id", "response").groupBy("run_id").agg(F.count("*").alias("messages"), F.sum(F.length(F.coalesce("response", F.lit("")))).alias("n"))
    return t.select("run_id", "messages", sequence.condense_budget(F.col("n"), 3000, 1).cast("long").alias("budget"))
