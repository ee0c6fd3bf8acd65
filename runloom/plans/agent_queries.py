"""Queries of the reference's operators over whole tables, each with the DuckDB SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions import text as T
from runloom.operators import grading, monitor, prep, retrieval, sequence
from runloom.operators.blocks import once
from runloom.operators.order import with_index
from runloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Copies of a turn or call (equal id, later ingestion) counted once, as views of the SQL side.
_T = "turns1 AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY ingested_at) = 1)"
_C = "calls1 AS (SELECT * FROM tool_results QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY ingested_at) = 1)"
_ORD = "step_idx, call_idx, call_id"
_SIG = r"left(trim(regexp_replace(coalesce(tool_name, '') || ' ' || coalesce(action, ''), '\s+', ' ', 'g')), 300)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def turns(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each turn once, with turn_id and the columns asked for and no others."""
    return once(table(spark, d, "turns").select("turn_id", "ingested_at", *columns), "turn_id", "ingested_at").drop("ingested_at")


def calls(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each call once, with call_id and the columns asked for and no others."""
    return once(table(spark, d, "tool_results").select("call_id", "ingested_at", *columns), "call_id", "ingested_at").drop("ingested_at")


PLACE = ("run_id", "step_idx", "call_idx")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


# --- ordered sequences


@query(f"""WITH {_C}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {_ORD}) AS pos FROM calls1 WHERE coalesce(action, '') <> ''),
s AS (SELECT run_id, pos, action = lag(action) OVER w AND action = lag(action, 2) OVER w AS st FROM n WINDOW w AS (PARTITION BY run_id ORDER BY pos))
SELECT run_id, min(pos) AS first_stuck FROM s WHERE st GROUP BY run_id""")
def stuck_runs(spark, d):
    return sequence.stuck(calls(spark, d, *PLACE, "action"), "action", 3)


@query(f"""WITH {_C}, s AS (SELECT *, {_SIG} AS signature FROM calls1), n AS (SELECT *, row_number() OVER (PARTITION BY run_id, signature ORDER BY {_ORD}) AS rn FROM s),
h AS (SELECT * FROM n WHERE rn = 3 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY {_ORD}) = 1)
SELECT h.run_id, h.signature, f.step_idx AS first_step, h.step_idx AS hit_step FROM h JOIN n f ON f.run_id = h.run_id AND f.signature = h.signature AND f.rn = 1""")
def first_loop(spark, d):
    return sequence.first_loop(calls(spark, d, *PLACE, "tool_name", "action"), 3)


@query(f"""WITH {_T}, l AS (SELECT * FROM turns1 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step_idx DESC, turn_id DESC) = 1)
SELECT run_id, CASE WHEN coalesce(exit_reason, '') NOT IN ('', 'turn_done') THEN exit_reason WHEN coalesce(done, false) THEN 'finished' ELSE 'max_turns' END AS termination FROM l""")
def termination_status(spark, d):
    return sequence.termination(turns(spark, d, "run_id", "step_idx", "exit_reason", "done"))


@query(f"""WITH {_T}, {_C}, p AS (SELECT run_id, step_idx, max(CASE WHEN status = 'skipped' THEN 1 ELSE 0 END) AS dead, sum(CASE WHEN status = 'timeout' THEN 1 ELSE 0 END) AS timeouts, max(CASE WHEN status <> 'ok' THEN 1 ELSE 0 END) AS errors FROM calls1 GROUP BY ALL),
t AS (SELECT run_id, step_idx, max(CASE WHEN done THEN 1 ELSE 0 END) AS done FROM turns1 GROUP BY ALL),
b AS (SELECT t.run_id, t.step_idx, dead, timeouts, errors, done, sum(coalesce(timeouts, 0)) OVER (PARTITION BY t.run_id ORDER BY t.step_idx ROWS UNBOUNDED PRECEDING) AS spent FROM t LEFT JOIN p ON p.run_id = t.run_id AND p.step_idx = t.step_idx)
SELECT run_id, step_idx, CASE WHEN coalesce(dead, 0) = 1 THEN 'terminal_dead' WHEN timeouts > 0 AND spent > 3 THEN 'timeout_budget_exhausted' WHEN done = 1 THEN 'finished' WHEN coalesce(errors, 0) = 1 THEN 'completed_with_tool_errors' ELSE 'completed' END AS exit FROM b""")
def step_exit_precedence(spark, d):
    return sequence.step_exit(calls(spark, d, "run_id", "step_idx", "status"), turns(spark, d, "run_id", "step_idx", "done"))


@query(f"""WITH {_C} SELECT call_id, CASE WHEN coalesce(max(CASE WHEN status = 'timeout' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, step_idx ORDER BY call_idx, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'skipped' ELSE status END AS status FROM calls1""")
def skipped_fill(spark, d):
    return sequence.skipped_fill(calls(spark, d, *PLACE, "status"))


@query(f"""WITH {_T}, s AS (SELECT run_id, step_idx, coalesce(tokens, 0) AS n, sum(coalesce(tokens, 0)) OVER (PARTITION BY run_id ORDER BY step_idx, turn_id ROWS UNBOUNDED PRECEDING) AS e FROM turns1)
SELECT run_id, step_idx, CAST(e - n AS BIGINT) AS span_start, CAST(least(e, 4096) AS BIGINT) AS span_end FROM s WHERE e - n < 4096""")
def response_spans(spark, d):
    return sequence.response_spans(turns(spark, d, "run_id", "step_idx", "tokens"), 4096)


@query(f"""WITH {_T}, s AS (SELECT run_id, coalesce(tokens, 0) AS n, sum(coalesce(tokens, 0)) OVER (PARTITION BY run_id ORDER BY step_idx, turn_id ROWS UNBOUNDED PRECEDING) AS c FROM turns1)
SELECT run_id, count(*) FILTER (WHERE c < 2048) AS kept_turns, CAST(sum(CASE WHEN c < 2048 THEN n ELSE 0 END) AS BIGINT) AS tokens, max(c >= 2048) AS stopped FROM s GROUP BY run_id""")
def length_stop(spark, d):
    return sequence.length_stop(turns(spark, d, "run_id", "step_idx", "tokens"), 2048)


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Calls as a chat log: search calls play the user, a run's first call the system, others the tool."""
    c = sequence.numbered(calls(spark, d, *PLACE, "tool_name", "observation"), "run_id", ("step_idx", "call_idx", "call_id"), "nth")
    idx = F.col("nth") - 1
    role = F.when(F.col("idx") == 0, "system").when(F.col("tool_name") == "search", "user").otherwise("tool")
    return c.withColumn("idx", idx).select(F.col("run_id").alias("conv_id"), "idx", role.alias("role"), F.col("observation").alias("content"))


_M = f"""m0 AS (SELECT run_id AS conv_id, row_number() OVER (PARTITION BY run_id ORDER BY {_ORD}) - 1 AS idx, tool_name, observation AS content FROM calls1),
m AS (SELECT conv_id, idx, CASE WHEN idx = 0 THEN 'system' WHEN tool_name = 'search' THEN 'user' ELSE 'tool' END AS role, content FROM m0)"""


@query(f"""WITH {_C}, {_M}, c AS (SELECT *, greatest(1, length(coalesce(content, '')) // 4) + 4 AS cost, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS ch FROM m),
t AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id) AS total, sum(CASE WHEN role = 'system' THEN cost ELSE 0 END) OVER (PARTITION BY conv_id) AS fixed, max(ch) OVER (PARTITION BY conv_id) AS newest,
 sum(CASE WHEN role <> 'system' AND ch > 0 THEN cost ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY ch DESC RANGE UNBOUNDED PRECEDING) AS run FROM c)
SELECT conv_id, idx, role, content FROM t WHERE total <= 1500 OR newest = 0 OR role = 'system' OR (ch > 0 AND (ch = newest OR run <= greatest(0, 800 - fixed)))""")
def history_compaction(spark, d):
    return sequence.compact(messages(spark, d), 1500, 800)


@query(f"""WITH {_C}, {_M}, a AS (SELECT conv_id, idx, role, coalesce(content, '') AS content, max(idx) OVER (PARTITION BY conv_id) + 1 AS n FROM m),
k AS (SELECT *, role = 'tool' AND idx >= 2 AS seen, CASE WHEN role = 'tool' AND idx >= 2 AND length(content) > 300 THEN left(content, 150) || '{sequence.CLIP_MARK}' || right(content, 150) || chr(10) || '{sequence.CLIP_NOTE[1:]}' ELSE content END AS t1 FROM a),
v AS (SELECT *, 4000 - sum(length(content) - length(t1)) OVER (PARTITION BY conv_id) AS left0, seen AND idx < n - 10 AND t1 <> '{sequence.MASK_NOTE}' AS cand FROM k),
w AS (SELECT *, left0 - coalesce(sum(CASE WHEN cand THEN length(t1) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft, left0 - sum(CASE WHEN cand THEN length(t1) ELSE 0 END) OVER (PARTITION BY conv_id) > 0 AS unmet FROM v)
SELECT conv_id, idx, CASE WHEN cand AND lft > 0 THEN '{sequence.MASK_NOTE}' ELSE t1 END AS content, cand AND lft > 0 AS masked, unmet FROM w""")
def condense_clip_and_mask(spark, d):
    return sequence.condense(messages(spark, d), 4000, 300, 2, 10)


@query(f"""WITH {_T}, f AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND source IS NOT DISTINCT FROM lag(source) OVER w THEN 0 ELSE 1 END AS nw FROM turns1 WINDOW w AS (PARTITION BY run_id ORDER BY step_idx, turn_id)),
g AS (SELECT *, sum(nw) OVER (PARTITION BY run_id ORDER BY step_idx, turn_id ROWS UNBOUNDED PRECEDING) AS trajectory FROM f)
SELECT run_id, CAST(trajectory AS BIGINT) AS trajectory, any_value(source) AS source, count(*) AS turns, min(step_idx) AS first_step FROM g GROUP BY run_id, trajectory""")
def trajectory_split(spark, d):
    s = sequence.split_on_change(turns(spark, d, "run_id", "step_idx", "source"), ["source"])
    return s.groupBy("run_id", "trajectory").agg(F.max("source").alias("source"), F.count("*").alias("turns"), F.min("step_idx").alias("first_step"))


@query("""SELECT run_id, segment_index, CAST(coalesce(len(response_ids), 0) AS BIGINT) AS response_tokens, CAST(coalesce(list_sum(response_mask), 0) AS BIGINT) AS generated_tokens,
 len(response_mask) = len(response_ids) AND (len(response_logprobs) = 0 OR len(response_logprobs) = len(response_ids)) AS fits,
 CAST(len(list_filter(turn_spans, lambda s: s.span_start < len(response_ids))) AS BIGINT) AS spans,
 CAST(coalesce(list_sum(list_transform(list_filter(turn_spans, lambda s: s.span_start < len(response_ids)), lambda s: least(s.span_end, len(response_ids)) - s.span_start)), 0) AS BIGINT) AS covered_tokens
FROM (SELECT DISTINCT * FROM segments)""")
def mask_lengths(spark, d):
    return sequence.mask_summary(table(spark, d, "segments").distinct())


@query("""SELECT run_id, s.step AS step, count(DISTINCT segment_index) AS segments FROM (SELECT DISTINCT run_id, segment_index, unnest(turn_spans) AS s FROM segments) GROUP BY ALL""")
def steps_of_segments(spark, d):
    e = table(spark, d, "segments").select("run_id", "segment_index", F.explode("turn_spans").alias("s")).select("run_id", "segment_index", "s.step")
    return e.groupBy("run_id", "step").agg(F.countDistinct("segment_index").alias("segments"))


_L = "lines1 AS (SELECT run_id, source, byte_offset, any_value(text) AS text FROM run_log GROUP BY ALL HAVING true)".replace("GROUP BY ALL HAVING true", "GROUP BY run_id, source, byte_offset")


@query(rf"""WITH {_L}, k AS (SELECT *, CASE WHEN regexp_matches(coalesce(text, ''), 'STEP \d+') THEN 'step' WHEN contains(text, 'THOUGHT:') THEN 'thought' WHEN contains(text, 'ACTION') THEN 'action' WHEN contains(text, 'MODEL INPUT') THEN 'input' WHEN contains(text, 'Observation:') THEN 'observation' WHEN regexp_matches(coalesce(text, ''), '^\d\d\d\d-\d\d-\d\d \d\d:\d\d:\d\d') THEN 'none' END AS mk FROM lines1)
SELECT run_id, source, byte_offset, coalesce(last_value(mk IGNORE NULLS) OVER (PARTITION BY run_id, source ORDER BY byte_offset ROWS UNBOUNDED PRECEDING), 'none') AS kind FROM k""")
def carry_forward_kind(spark, d):
    return sequence.carry_kind(table(spark, d, "run_log").dropDuplicates(["run_id", "source", "byte_offset"]))


@query(r"""SELECT run_id, max(CAST(regexp_extract(text, 'STEP\s+(\d+)', 1) AS INT)) AS furthest_step, count(*) AS marks FROM (SELECT DISTINCT * FROM run_log) WHERE regexp_matches(text, 'STEP\s+\d+') GROUP BY run_id""")
def current_step(spark, d):
    x = table(spark, d, "run_log").where("text like '%STEP%'").distinct().withColumn("s", T.current_step(F.col("text"))).where("s is not null")
    return x.groupBy("run_id").agg(F.max("s").alias("furthest_step"), F.count("*").alias("marks"))


@query(f"WITH {_C} SELECT run_id, tool_name, round(sum(execution_time), 3) AS seconds, count(*) AS calls FROM calls1 GROUP BY ALL")
def timer_accumulate(spark, d):
    return calls(spark, d, "run_id", "tool_name", "execution_time").groupBy("run_id", "tool_name").agg(F.round(F.sum("execution_time"), 3).alias("seconds"), F.count("*").alias("calls"))


@query(f"""WITH {_C} SELECT call_id, next_call_id, next_status <> 'ok' AS failed_again FROM (SELECT *, lead(call_id) OVER w AS next_call_id, lead(status) OVER w AS next_status FROM calls1 WINDOW w AS (PARTITION BY run_id, tool_name ORDER BY {_ORD})) WHERE status <> 'ok'""")
def retry_after_failure(spark, d):
    return sequence.retries(calls(spark, d, *PLACE, "tool_name", "status"))


@query(f"""WITH {_C}, s AS (SELECT *, {_SIG} AS sig FROM calls1) SELECT * FROM (SELECT call_id, step_idx, lag(step_idx) OVER w AS repeats_step, CAST(row_number() OVER w AS INT) AS nth FROM s WINDOW w AS (PARTITION BY run_id, sig ORDER BY {_ORD})) WHERE nth > 1""")
def verbatim_repeats(spark, d):
    return sequence.verbatim_repeats(calls(spark, d, *PLACE, "tool_name", "action"))


@query(f"""WITH {_C}, x AS (SELECT call_id, coalesce(lag(observation) OVER (PARTITION BY run_id ORDER BY {_ORD}), '') AS seen, coalesce(observation, '') AS text FROM calls1)
SELECT call_id, CASE WHEN starts_with(seen, text) THEN '' WHEN starts_with(text, seen) THEN substr(text, length(seen) + 1) ELSE text END AS fresh FROM x""")
def fresh_output(spark, d):
    return sequence.new_output(calls(spark, d, *PLACE, "observation"))


@query(f"""WITH {_T}, {_C}, l AS (SELECT * FROM turns1 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step_idx DESC, turn_id DESC) = 1), n AS (SELECT run_id, count(*) AS turns FROM turns1 GROUP BY 1),
s AS (SELECT run_id, greatest(count(DISTINCT segment_index) - 1, 0) AS c FROM segments GROUP BY 1), k AS (SELECT run_id, round(sum(execution_time), 3) AS t FROM calls1 GROUP BY 1)
SELECT n.run_id, turns, CASE WHEN coalesce(exit_reason, '') NOT IN ('', 'turn_done') THEN exit_reason WHEN coalesce(done, false) THEN 'finished' ELSE 'max_turns' END AS termination, CAST(coalesce(c, 0) AS BIGINT) AS condensations, coalesce(t, 0.0) AS tool_seconds, n.run_id IN (SELECT run_id FROM turns1 WHERE exit_reason = 'finished') AS resolved, coalesce((SELECT count(DISTINCT step_idx) FROM turns1 h WHERE h.run_id = n.run_id AND h.step_idx % 7 = 0), 0) AS hinted_turns
FROM n JOIN l ON l.run_id = n.run_id LEFT JOIN s ON s.run_id = n.run_id LEFT JOIN k ON k.run_id = n.run_id""")
def run_outcomes(spark, d):
    """Runs as records; those that finished count as resolved, every seventh step as hinted."""
    t = turns(spark, d, "run_id", "step_idx", "exit_reason", "done")
    return sequence.run_outcomes(t, calls(spark, d, "run_id", "execution_time"), table(spark, d, "segments"), t.where("exit_reason = 'finished'"), t.where("step_idx % 7 = 0"))


@query(f"""WITH {_T} SELECT run_id, arg_min(finish_reason, (step_idx, turn_id)) FILTER (WHERE finish_reason IS NOT NULL) AS first_reason, arg_max(finish_reason, (step_idx, turn_id)) FILTER (WHERE finish_reason IS NOT NULL) AS last_reason, count(*) FILTER (WHERE CASE WHEN finish_reason IN ('length', 'max_tokens') THEN true ELSE false END) AS length_stops FROM turns1 GROUP BY run_id""")
def finish_reasons(spark, d):
    t = turns(spark, d, "run_id", "step_idx", "finish_reason")
    at = F.when(F.col("finish_reason").isNotNull(), F.struct("step_idx", "turn_id"))
    return t.groupBy("run_id").agg(F.min_by("finish_reason", at).alias("first_reason"), F.max_by("finish_reason", at).alias("last_reason"), F.count_if(T.finish_reason(F.col("finish_reason")) == "length").alias("length_stops"))


# --- logs and grading

_PL = rf"""pl AS (SELECT run_id, step_idx, call_idx, call_id, unnest(string_split(regexp_replace(coalesce(observation, ''), '\x1b\[[0-9;]*m|\r', '', 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(coalesce(observation, ''), '\x1b\[[0-9;]*m|\r', '', 'g'), chr(10)), 1) AS no FROM calls1),
pq AS (SELECT *, string_split_regex(trim(CASE WHEN starts_with(line, 'FAILED') THEN replace(line, ' - ', ' ') ELSE line END), '\s+') AS p FROM pl WHERE regexp_matches(line, '^(PASSED|FAILED|ERROR|SKIPPED|XFAIL)')),
st AS (SELECT run_id, p[2] AS test, arg_min(p[1], (step_idx, call_idx, call_id, no)) AS first_status, arg_max(p[1], (step_idx, call_idx, call_id, no)) AS status FROM pq WHERE len(p) >= 2 GROUP BY ALL)"""


def states(spark: SparkSession, d: str) -> DataFrame:
    return grading.test_states(calls(spark, d, *PLACE, "observation").where("observation is not null"), ["run_id"], "observation", ["step_idx", "call_idx", "call_id"])


def expected(s: DataFrame) -> DataFrame:
    """Tests that failed when first seen have to pass in the end, those that passed have to stay so."""
    return s.where("first_status in ('FAILED', 'PASSED')").select("run_id", F.when(F.col("first_status") == "FAILED", "F2P").otherwise("P2P").alias("kind"), "test")


@query(f"WITH {_C}, {_PL} SELECT run_id, test, first_status, status FROM st")
def test_states(spark, d):
    return states(spark, d)


_SEEN = "ob AS (SELECT run_id, test, status FROM st WHERE hash(test) IS NOT NULL AND status <> 'SKIPPED')"


@query(f"""WITH {_C}, {_PL}, ex AS (SELECT run_id, test, CASE first_status WHEN 'FAILED' THEN 'F2P' ELSE 'P2P' END AS kind FROM st WHERE first_status IN ('FAILED', 'PASSED')), {_SEEN},
j AS (SELECT ex.*, coalesce(ob.status = 'PASSED', false) AS ok FROM ex LEFT JOIN ob ON ob.run_id = ex.run_id AND ob.test = ex.test),
g AS (SELECT run_id, count(*) FILTER (WHERE kind = 'F2P' AND ok) AS f2p_passed, count(*) FILTER (WHERE kind = 'F2P' AND NOT ok) AS f2p_failed, count(*) FILTER (WHERE kind = 'P2P' AND ok) AS p2p_passed, count(*) FILTER (WHERE kind = 'P2P' AND NOT ok) AS p2p_failed FROM j GROUP BY run_id)
SELECT *, f2p_passed > 0 AND f2p_failed = 0 AND p2p_failed = 0 AS resolved FROM g""")
def grade_strict(spark, d):
    s = states(spark, d)
    return grading.grade_strict(expected(s), s.where("status <> 'SKIPPED'"))


@query(f"""WITH {_C}, {_PL}, ex AS (SELECT run_id, test, CASE first_status WHEN 'FAILED' THEN 'F2P' ELSE 'P2P' END AS kind FROM st WHERE first_status IN ('FAILED', 'PASSED')), {_SEEN},
j AS (SELECT ex.*, contains(lower(ob.status), 'pass') AS ok, NOT contains(lower(ob.status), 'pass') AND NOT contains(lower(ob.status), 'skip') AS bad FROM ex JOIN ob ON ob.run_id = ex.run_id AND ob.test = ex.test),
g AS (SELECT run_id, count(*) FILTER (WHERE kind = 'F2P' AND ok) AS f2p_passed, count(*) FILTER (WHERE kind = 'F2P' AND bad) AS f2p_failed, count(*) FILTER (WHERE kind = 'P2P' AND ok) AS p2p_passed, count(*) FILTER (WHERE kind = 'P2P' AND bad) AS p2p_failed FROM j GROUP BY run_id)
SELECT *, f2p_passed > 0 AND f2p_failed = 0 AND p2p_failed = 0 AS resolved FROM g""")
def grade_lenient(spark, d):
    s = states(spark, d)
    return grading.grade_lenient(expected(s), s.where("status <> 'SKIPPED'"))


@query(f"""WITH {_C}, {_PL} SELECT run_id, count(*) AS tests, bool_and(coalesce(first_status = CASE WHEN status <> 'SKIPPED' THEN status END, false)) AS equal FROM st GROUP BY run_id""")
def grade_exact_map(spark, d):
    s = states(spark, d)
    return grading.grade_exact(s.select("run_id", "test", F.col("first_status").alias("status")), s.where("status <> 'SKIPPED'"))


@query(f"""WITH {_C}, {_PL}, f AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY test) AS rn FROM st WHERE status IN ('FAILED', 'ERROR'))
SELECT run_id, count(*) AS failing, string_agg(test, ',' ORDER BY test) FILTER (WHERE rn <= 5) AS shown, CAST(greatest(count(*) - 5, 0) AS BIGINT) AS omitted FROM f GROUP BY run_id""")
def report_clip(spark, d):
    return grading.clip_failures(states(spark, d))


@query(f"""WITH {_C}, l AS (SELECT call_id, list_filter(string_split(observation, chr(10)), lambda x: starts_with(x, '+++ ')) AS ls FROM calls1 WHERE contains(observation, '+++ ')),
n AS (SELECT call_id, unnest(list_transform(ls, lambda x: regexp_replace(string_split(substr(x, 5), chr(9))[1], '^b/', ''))) AS f FROM l)
SELECT call_id, string_agg(DISTINCT f, ',' ORDER BY f) AS files FROM n WHERE f <> '/dev/null' GROUP BY call_id""")
def modified_files(spark, d):
    c = calls(spark, d, "observation").where("observation like '%+++ %'").select("call_id", grading.diff_files(F.col("observation")).alias("f")).where("size(f) > 0")
    return c.select("call_id", F.array_join(F.array_sort("f"), ",").alias("files"))


@query("""SELECT doc_id, source, CAST(row_number() OVER (ORDER BY rn, source) - 1 AS BIGINT) AS pick FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE source IS NOT NULL)""")
def round_robin_pick(spark, d):
    return grading.round_robin(table(spark, d, "documents").where("source is not null").select("doc_id", "source"), "source", "doc_id").select("doc_id", "source", "pick")


@query("""SELECT doc_id, repo, used FROM (SELECT doc_id, repo, CAST(sum(n_chars) OVER (PARTITION BY repo ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents WHERE repo IS NOT NULL) WHERE used <= 5000""")
def budget_greedy(spark, d):
    return grading.greedy_budget(table(spark, d, "documents").where("repo is not null").select("doc_id", "repo", "n_chars"), "repo", "doc_id", "n_chars", 5000).select("doc_id", "repo", "used")


_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '\b(a|an|the)\b', ' ', 'g'), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '\s+', ' ', 'g'))"""


@query(f"""SELECT doc_id, CASE WHEN {_NORM.format("title")} = {_NORM.format("regexp_replace(string_split(text, chr(10))[1], '^#+ *', '')")} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM documents WHERE title IS NOT NULL""")
def exact_match(spark, d):
    """Titles against the first lines of all titled documents."""
    return _title_match(table(spark, d, "documents").where("title is not null"))


def _title_match(x):
    head = F.regexp_replace(F.get(F.split("text", "\n", -1), F.lit(0)), "^#+ *", "")
    return x.select("doc_id", grading.exact_match(F.col("title"), F.array(head)).alias("score"))


# --- retrieval


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(qv, embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS score FROM q, embeddings)
SELECT query_id, vec_id, score, CAST(rk AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s) WHERE rk <= 5""")
def exact_topk(spark, d):
    v = vectors(spark, d)
    return retrieval.exact_topk(v.where("id % 20 = 0"), v, 5)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, label, round(list_sum(list_transform(list_zip(qv, embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS score FROM q, embeddings),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) = 1)
SELECT query_id, vec_id, CAST(label AS VARCHAR) AS url, score, CAST(rk AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM b) WHERE rk <= 3""")
def topk_dedup(spark, d):
    v = vectors(spark, d)
    return retrieval.dedup_results(retrieval.exact_topk(v.where("id % 20 = 0"), v, 10), v.select(F.col("id").alias("vec_id"), F.col("label").cast("string").alias("url")), 3)


_CELLS = """e AS (SELECT vec_id, label, embedding, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c0 AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY ALL), c AS (SELECT label AS cell, list(m ORDER BY i) AS c FROM c0 GROUP BY label),
a AS (SELECT vec_id, embedding, cell FROM (SELECT vec_id, embedding, cell, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_sum(list_transform(list_zip(c, embedding), lambda p: p[1] * CAST(p[2] AS DOUBLE))), 6) DESC, cell) AS r FROM embeddings, c) WHERE r = 1)"""


@query(f"""WITH {_CELLS} SELECT vec_id, cell FROM a""")
def cell_assignment(spark, d):
    v = vectors(spark, d)
    return retrieval.assign_cells(v, retrieval.centroids_by_label(v)).select(F.col("id").alias("vec_id"), "cell")


@query(f"""WITH {_CELLS}, q AS (SELECT vec_id AS query_id, embedding AS qv, cell FROM (SELECT vec_id, embedding, cell, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_sum(list_transform(list_zip(c, embedding), lambda p: p[1] * CAST(p[2] AS DOUBLE))), 6) DESC, cell) AS r FROM embeddings, c WHERE vec_id % 20 = 0) WHERE r <= 8),
s AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(qv, embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS score FROM q JOIN a ON a.cell = q.cell)
SELECT query_id, vec_id, score, CAST(rk AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s) WHERE rk <= 5""")
def ivf_probe_topk(spark, d):
    v = vectors(spark, d)
    return retrieval.probe_topk(v.where("id % 20 = 0"), v, retrieval.centroids_by_label(v), 8, 5)


@query("SELECT true AS reached, count(*) AS queries FROM embeddings WHERE vec_id % 20 = 0")
def ivf_recall(spark, d):
    """Whether the cells of k-means, probed as ivf_kmeans does, find nine in ten of the five nearest that exact_topk finds."""
    v = vectors(spark, d)
    q = v.where("id % 20 = 0")
    exact = retrieval.exact_topk(q, v, 5).select("query_id", "vec_id")
    found = ivf_kmeans(spark, d).select("query_id", "vec_id")
    hits = exact.join(found.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hits.agg(F.coalesce(F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*"), F.lit(True)).alias("reached"), F.countDistinct("query_id").alias("queries"))


@query()
def ivf_kmeans(spark, d):
    """Cells from k-means, as many probed as recall of 0.9 against exact_topk takes; ivf_recall measures it."""
    v = vectors(spark, d)
    return retrieval.probe_topk(v.where("id % 20 = 0"), v, retrieval.train_cells(v, 8), 7, 5)


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) = 1) SELECT count(*) AS asked, count(*) FILTER (WHERE query_id = vec_id AND score >= 0.99) AS found FROM t""")
def self_retrieval(spark, d):
    """Every queried vector finds itself first, at a score of 0.99 or more."""
    v = vectors(spark, d)
    t = retrieval.exact_topk(v.where("id % 20 = 0"), v, 1)
    return t.agg(F.count("*").alias("asked"), F.count_if((F.col("query_id") == F.col("vec_id")) & (F.col("score") >= 0.99)).alias("found"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(qv, embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS score FROM q, embeddings),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s QUALIFY rk <= 3), n AS (SELECT query_id, count(*) AS n, string_agg(rk || '. url: ' || CASE WHEN vec_id % 2 = 0 THEN 'u/' || vec_id ELSE 'No URL provided' END || chr(10) || 'Title: v' || vec_id || chr(10) || 'Snippet: ' || CASE WHEN vec_id % 3 = 0 THEN 'No snippet provided' ELSE 'text ' || vec_id END || chr(10), chr(10) ORDER BY rk) AS l FROM t GROUP BY query_id)
SELECT query_id, rtrim('Found ' || n || ' results:' || chr(10) || l, chr(10) || ' ') AS text FROM n""")
def formatted_results(spark, d):
    """Results as a numbered list, fields missing here and there."""
    v = vectors(spark, d)
    n = F.col("vec_id").cast("string")
    r = retrieval.exact_topk(v.where("id % 20 = 0"), v, 3)
    r = r.select("query_id", "rank", F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("u/"), n)).alias("url"), F.concat(F.lit("v"), n).alias("title"), F.lit("").alias("content"), F.when(F.col("vec_id") % 3 != 0, F.concat(F.lit("text "), n)).alias("text"), F.lit(None).cast("string").alias("snippet"), F.lit(None).cast("double").alias("score"))
    return retrieval.format_results(r)


@query("""SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'query: v' || vec_id WHEN 1 THEN 'v' || vec_id WHEN 2 THEN 'Represent this sentence for searching relevant passages: v' || vec_id ELSE 'v' || vec_id END AS text, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS length FROM embeddings""")
def encoder_inputs(spark, d):
    """Texts as encoders want them, and token vectors pooled: two kept and one masked, which give the vector's direction."""
    v, m = vectors(spark, d), F.col("id") % 4
    model = F.when(m == 0, "E5-large").when(m == 1, "bge-m3").when(m == 2, "bge-base").otherwise("dpr")
    twice = F.transform("v", lambda x: x.cast("double") * 3)
    p = retrieval.pooled(F.array(F.transform("v", lambda x: x.cast("double")), F.transform("v", lambda x: -x.cast("double")), twice), F.array(F.lit(1), F.lit(0), F.lit(1)))
    return v.where("v is not null").select(F.col("id").alias("vec_id"), retrieval.query_text(model, F.concat(F.lit("v"), F.col("id").cast("string")), True).alias("text"), F.round(retrieval.inner(p, F.col("v")), 4).alias("length"))


@query("""WITH p AS (SELECT repo AS url, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS passages FROM documents WHERE repo IS NOT NULL AND repo <> '' GROUP BY repo), r AS (SELECT DISTINCT repo AS url FROM documents WHERE repo IS NOT NULL UNION ALL SELECT 'no/such-repo'),
n AS (SELECT CAST(row_number() OVER (ORDER BY url) AS BIGINT) AS pos, url FROM r)
SELECT pos, n.url, coalesce(passages, '') AS passages, CASE WHEN passages IS NULL THEN 'No passages found for URL: ' || n.url ELSE '' END AS message FROM n LEFT JOIN p ON p.url = n.url""")
def crawl_lookup(spark, d):
    x = table(spark, d, "documents").select(F.col("repo").alias("url"), F.col("doc_id").alias("id"))
    urls = x.where("url is not null").select("url").distinct().unionByName(spark.createDataFrame([("no/such-repo",)], "url string"))
    return retrieval.crawl(with_index(urls, "url", name="pos").withColumn("pos", F.col("pos") + 1), x)


@query("""SELECT event_id, ts, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 50""")
def fetch_filter_limit(spark, d):
    return retrieval.fetch_filter_limit(table(spark, d, "events").select("event_id", "ts", "event_type"), [F.desc("ts"), F.desc("event_id")], 200, F.col("event_type") != "view", 50)


# --- texts


@query("""SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 100) || chr(10) || '[... ' || CAST(length(text) - 200 AS VARCHAR) || ' characters elided ...]' || chr(10) || right(text, 100) ELSE text END AS clipped FROM documents""")
def clip_middle(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clip_middle(F.col("text"), 200).alias("clipped"))


@query("""SELECT doc_id, CASE WHEN length(text) > 101 THEN left(text, 50) || chr(10) || '[... ' || (length(text) - 101) || ' chars elided ...]' || chr(10) || right(text, 51) ELSE text END AS turn, CASE WHEN length(text) > 101 THEN left(text, 50) || chr(10) || '[... ' || (length(text) - 101) || ' chars elided from the middle ...]' || chr(10) || right(text, 51) ELSE text END AS traceback,
 CASE WHEN length(text) > 101 THEN left(text, 50) || ' [... TRUNCATED ...] ' || right(text, 50) ELSE text END AS history, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM documents""")
def clip_variants(spark, d):
    """The other middle clips, and texts as a page holds them."""
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.clip_middle(x, 101, T.NOTES["turn"]).alias("turn"), T.clip_middle(x, 101, T.NOTES["traceback"]).alias("traceback"), T.clip_middle(x, 101, sequence.CLIP_MARK, True).alias("history"), T.html_escape(x).alias("html"))


@query(rf"""WITH {_C}, b AS (SELECT call_id, regexp_replace(regexp_replace(coalesce(observation, ''), '\x1b\[[0-9;]*m|\r', '', 'g'), '^\s+|\s+$', '', 'g') AS t FROM calls1)
SELECT call_id, CASE WHEN t = '' THEN '{T.NO_OUTPUT}' WHEN length(t) > 400 THEN 'Observation:' || chr(10) || left(t, 200) || chr(10) || '<response clipped: ' || (length(t) - 400) || ' characters elided from the middle>' || chr(10) || right(t, 200) || chr(10) || '{T.CLIP_ADVICE[1:].replace("{cap}", "400")}' ELSE 'Observation:' || chr(10) || t END AS observation FROM b""")
def observation_format(spark, d):
    return calls(spark, d, "observation").select("call_id", T.format_observation(F.col("observation"), 400).alias("observation"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM documents""")
def xml_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", T.xml_escape(F.col("text")).alias("escaped"))


@query(f"""WITH {_C} SELECT call_id, CASE WHEN action = '' THEN '''''' WHEN regexp_full_match(action, '[A-Za-z0-9_@%+=:,./-]+') THEN action ELSE '''' || replace(action, '''', '''"''"''') || '''' END AS quoted FROM calls1""")
def shell_quote(spark, d):
    return calls(spark, d, "action").select("call_id", T.shell_quote(F.col("action")).alias("quoted"))


@query("""SELECT delivery_id, CASE WHEN n = '' THEN 'default' ELSE n END AS name FROM (SELECT delivery_id, regexp_replace(regexp_replace(content, '[^a-zA-Z0-9_-]', '_', 'g'), '^_+|_+$', '', 'g') AS n FROM chat_events WHERE content IS NOT NULL)""")
def file_names(spark, d):
    return table(spark, d, "chat_events").where("content is not null").select("delivery_id", T.file_name(F.col("content")).alias("name"))


@query("""SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS BIGINT) AS matches FROM documents""")
def count_matches(spark, d):
    return table(spark, d, "documents").select("doc_id", T.count_matches(F.col("text"), "The").alias("matches"))


@query("""SELECT doc_id, string_agg(lpad(CAST(i AS VARCHAR), 6, ' ') || chr(9) || line, chr(10) ORDER BY i) AS numbered FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY doc_id""")
def line_numbering(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.number_lines(F.col("text")).alias("numbered"))


# --- monitoring and preparation


@query(rf"""WITH s AS (SELECT run_id, max(CASE WHEN {" OR ".join(f"contains(text, '{w}')" for w in monitor.VERIFYING)} THEN 1 ELSE 0 END) AS v, max(CASE WHEN {" OR ".join(f"contains(text, '{w}')" for w in monitor.RUNNING)} THEN 1 ELSE 0 END) AS r, count(*) AS lines FROM run_log GROUP BY run_id), f AS (SELECT DISTINCT run_id FROM turns WHERE done)
SELECT s.run_id, CASE WHEN f.run_id IS NOT NULL THEN 'completed' WHEN v = 1 THEN 'verify' WHEN r = 1 THEN 'running' ELSE 'queued' END AS status, lines FROM s LEFT JOIN f ON f.run_id = s.run_id""")
def run_status(spark, d):
    return monitor.run_status(table(spark, d, "run_log"), table(spark, d, "turns").where("done"))


@query("WITH r AS (" + SQL["run_status"].replace("WITH s AS", "WITH s AS", 1) + """) SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'verify') AS verify, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status IN ('running', 'verify')) AS active, CAST(coalesce(sum(lines), 0) AS BIGINT) AS lines FROM r""")
def dashboard_stats(spark, d):
    return monitor.stats(run_status(spark, d))


@query("WITH r AS (" + SQL["run_status"] + ") SELECT * FROM r WHERE contains(lower(run_id || ' ' || status), 'r0000') AND contains(lower(run_id || ' ' || status), 'verify')")
def dashboard_search(spark, d):
    return monitor.search(run_status(spark, d), "R0000 Verify", F.concat_ws(" ", "run_id", "status"))


@query("SELECT DISTINCT run_id, source, byte_offset, text FROM run_log WHERE byte_offset >= 1000 AND byte_offset + strlen(coalesce(text, '')) + 1 <= 3000")
def log_page_reverse(spark, d):
    return monitor.page_back(table(spark, d, "run_log"), 3000, 2000)


@query("SELECT event_id, user_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def ring_buffer(spark, d):
    return monitor.newest(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("event_id", "user_id", "ts", "event_type")


@query("""SELECT doc_id, CASE WHEN n < floor(c * 0.9) THEN 'train' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n, count(*) OVER () AS c FROM documents)""")
def train_test_split(spark, d):
    x = table(spark, d, "documents").select("doc_id")
    n = x.count()
    return prep.positional_split(x, "doc_id", n * 9 // 10, n - n * 9 // 10)


@query("""SELECT item_id, CAST(i % 7 AS INT) AS worker, CAST(i // ((n - 1) // 7 + 1) AS INT) AS chunk FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM eval_items)""")
def deal_out(spark, d):
    return prep.deal(table(spark, d, "eval_items").select("item_id"), "item_id", 7)


@query("SELECT item_id, CAST(r AS INT) AS rollout FROM eval_items, range(1, 5) t(r)")
def repeat_n(spark, d):
    return prep.repeat(table(spark, d, "eval_items").select("item_id"), 4)


@query("SELECT doc_id, lang FROM documents WHERE lower(coalesce(lang, '')) IN ('de', 'fr')")
def language_filter(spark, d):
    return prep.language_filter(table(spark, d, "documents"), "lang", ["DE", "fr"]).select("doc_id", "lang")


@query("SELECT doc_id, created_at FROM documents WHERE created_at IS NULL OR created_at >= TIMESTAMP '2026-04-01 00:00:00' - INTERVAL 30 DAY")
def recency_filter(spark, d):
    return prep.recent(table(spark, d, "documents"), "created_at", F.lit("2026-04-01 00:00:00").cast("timestamp_ntz"), 30).select("doc_id", "created_at")


# --- capabilities of the host engine, not of the reference


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY CUBE (l_returnflag, l_linestatus)""")
def host_cube(spark, d):
    x = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return x.cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def host_join(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def host_anti_join(spark, d):
    """Customers without a large order."""
    o, c = table(spark, d, "orders").where("o_totalprice > 400000"), table(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def host_event_windows(spark, d):
    from runloom.streaming.windows import hourly

    return hourly(table(spark, d, "events"))


@query(f"""WITH {_T}, e AS (SELECT run_id AS session_id, row_number() OVER (PARTITION BY run_id ORDER BY step_idx, turn_id) AS seq, CASE WHEN exit_reason IN ('finished') THEN 'finalize' WHEN done THEN 'complete' WHEN finish_reason IN ('abort', 'aborted') THEN 'abort' ELSE 'request' END AS event FROM turns1),
p AS (SELECT *, coalesce(max(CASE WHEN event IN ('finalize', 'abort') THEN 1 ELSE 0 END) OVER w, 0) AS ended, coalesce(max(CASE WHEN event = 'complete' THEN 1 ELSE 0 END) OVER w, 0) AS done, first_value(CASE WHEN event IN ('finalize', 'abort') THEN event END IGNORE NULLS) OVER w AS fin FROM e WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, CASE WHEN ended = 1 THEN CASE WHEN fin = 'finalize' THEN 'finalized' ELSE 'aborted' END WHEN done = 1 THEN 'completed' ELSE 'active' END AS bf FROM p),
m AS (SELECT *, CASE WHEN bf = 'active' AND event = 'request' THEN 'active' WHEN bf IN ('active', 'completed') AND event = 'complete' THEN 'completed' WHEN bf IN ('active', 'completed') AND event = 'finalize' THEN 'finalized' WHEN bf IN ('active', 'completed', 'aborted') AND event = 'abort' THEN 'aborted' END AS nx FROM b)
SELECT session_id, seq, event, coalesce(nx, bf) AS phase, nx IS NOT NULL AS accepted FROM m""")
def session_states(spark, d):
    from runloom.streaming.sessions import states as session_fold

    t = turns(spark, d, "run_id", "step_idx", "exit_reason", "done", "finish_reason")
    event = F.when(F.coalesce(F.col("exit_reason"), F.lit("")) == "finished", "finalize").when(F.coalesce("done", F.lit(False)), "complete").when(F.coalesce("finish_reason", F.lit("")).isin("abort", "aborted"), "abort").otherwise("request")
    t = sequence.numbered(t, "run_id", ("step_idx", "turn_id"), "seq")
    return session_fold(t.select(F.col("run_id").alias("session_id"), "seq", event.alias("event")))
