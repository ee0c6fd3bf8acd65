"""Queries of tool calls, answers and their scores, each with the DuckDB SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import grading, toolcalls
from runloom.plans.agent_queries import _C, _NORM, _T, PLACE, calls, turns
from runloom.plans.registering import collection

QUERIES, SQL, query = collection()

TOOLS = {"execute_bash": {"command": "string", "timeout": "integer", "is_input": "boolean"}, "str_replace_editor": {"command": "string", "path": "string"}}

_BLOCKS = r"""b AS (SELECT turn_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS call_no FROM (SELECT turn_id, CASE WHEN contains(response, '</tool_call>') THEN list_filter(regexp_extract_all(response, '(?s)<tool_call>\s*(.*?)\s*</tool_call>', 1), lambda x: trim(x) <> '') ELSE [NULL] END AS l FROM turns1 WHERE contains(response, '<tool_call>'))),
v AS (SELECT turn_id, call_no, raw, CASE WHEN raw IS NOT NULL AND json_valid(raw) THEN raw::JSON END AS j FROM b),
p AS (SELECT *, json_type(j) AS jt, json_type(j -> '$.name') AS nt, j ->> '$.name' AS nm, json_type(j -> '$.arguments') AS atype, CASE WHEN json_type(j -> '$.arguments') = 'VARCHAR' THEN j ->> '$.arguments' END AS inner_text FROM v),
q AS (SELECT *, CASE WHEN atype IS NULL OR atype = 'NULL' THEN '{}'::JSON WHEN atype = 'VARCHAR' THEN CASE WHEN json_valid(inner_text) THEN inner_text::JSON END ELSE j -> '$.arguments' END AS args FROM p)"""


@query(rf"""WITH {_T}, {_BLOCKS} SELECT turn_id, CAST(call_no AS INT) AS call_no, CASE WHEN nt = 'VARCHAR' THEN nm END AS name,
 CASE WHEN error IS NULL THEN args ->> '$.command' END AS command, CASE WHEN error IS NULL THEN CAST(len(json_keys(args)) AS INT) END AS arguments, error FROM (SELECT *, CASE WHEN raw IS NULL THEN 'unclosed' WHEN j IS NULL THEN 'invalid_json' WHEN jt <> 'OBJECT' THEN 'not_object' WHEN nt IS NULL THEN 'no_name' WHEN nt <> 'VARCHAR' THEN 'name_not_text' WHEN nm NOT IN ('execute_bash', 'str_replace_editor') THEN 'unknown_function' WHEN args IS NULL THEN 'invalid_arguments' WHEN json_type(args) <> 'OBJECT' THEN 'arguments_not_object' END AS error FROM q)""")
def tool_calls_all(spark, d):
    """Every JSON call of every response, with what is wrong with it."""
    c = toolcalls.hermes_calls(turns(spark, d, "response"), "turn_id", "response", TOOLS)
    v = F.try_parse_json("arguments")
    return c.select("turn_id", "call_no", "name", F.try_variant_get(v, "$.command", "string").alias("command"), F.size(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))).alias("arguments"), "error").withColumn("arguments", F.when(F.col("error").isNull(), F.col("arguments")))


@query(f"""WITH {_C}, c AS (SELECT *, coalesce(action, '') AS a, CAST(floor(execution_time * 10) AS BIGINT) AS t FROM calls1)
SELECT call_id, tool_name AS name, CASE WHEN tool_name = 'execute_bash' AND lower(a) <> 'null' THEN a END AS command, CASE WHEN tool_name = 'execute_bash' THEN t END AS timeout, CASE WHEN tool_name = 'execute_bash' THEN status = 'ok' END AS is_input,
 CASE WHEN tool_name NOT IN ('execute_bash', 'str_replace_editor') THEN 'unknown_function' WHEN tool_name = 'str_replace_editor' THEN 'unknown_parameter' END AS error FROM c WHERE tool_name IS NOT NULL""")
def tool_calls_xml(spark, d):
    """Calls written in XML notation and read back, with typed arguments; the editor declares no is_input."""
    c = calls(spark, d, "tool_name", "action", "status", "execution_time")
    t = F.coalesce(F.floor(F.col("execution_time") * 10).cast("string"), F.lit("null"))
    text = F.concat(
        F.lit("Next.\n<tool_call>\n<function="), F.col("tool_name"), F.lit(">\n<parameter=command>\n"), F.coalesce("action", F.lit("")), F.lit("\n</parameter>\n<parameter=timeout>"), t,
        F.lit("</parameter>\n<parameter=is_input>"), F.when(F.col("status") == "ok", "True").otherwise("false"), F.lit("\n</parameter>\n</function>\n</tool_call>"),
    )
    p = toolcalls.xml_calls(c.select("call_id", text.alias("text")), "call_id", "text", TOOLS)
    v = F.try_parse_json("arguments")
    return p.select("call_id", "name", F.try_variant_get(v, "$.command", "string").alias("command"), F.try_variant_get(v, "$.timeout", "bigint").alias("timeout"), F.try_variant_get(v, "$.is_input", "boolean").alias("is_input"), "error")


_MASK = r"""regexp_replace(response, '("command"\s*:\s*")((?:[^"\\]|\\.)*)(")', '\1<MASKED>\3', 'g')"""


@query(rf"""WITH {_T} SELECT turn_id, {_MASK} AS masked, CAST(coalesce(list_sum(list_transform(regexp_extract_all(response, '("command"\s*:\s*")((?:[^"\\]|\\.)*)(")', 2), lambda x: greatest(0, length(x) - 8))), 0) AS INT) AS removed FROM turns1 WHERE contains(response, '<tool_call>')""")
def argument_masks(spark, d):
    """Commands of JSON calls masked."""
    m = toolcalls.mask_hermes(F.col("response"), ["command"])
    return turns(spark, d, "response").where(F.col("response").contains("<tool_call>")).select("turn_id", m["text"].alias("masked"), m["removed"].alias("removed"))


@query(f"""WITH {_C} SELECT call_id, '<parameter=command><MASKED></parameter><parameter=status>' || coalesce(status, '') || '</parameter>' AS masked, CAST(greatest(0, length(coalesce(action, '')) - 8) AS INT) AS removed FROM calls1""")
def argument_masks_xml(spark, d):
    text = F.concat(F.lit("<parameter=command>"), F.coalesce("action", F.lit("")), F.lit("</parameter><parameter=status>"), F.coalesce("status", F.lit("")), F.lit("</parameter>"))
    m = toolcalls.mask_xml(F.col("text"), ["command", "old_str"])
    return calls(spark, d, "action", "status").select("call_id", text.alias("text")).select("call_id", m["text"].alias("masked"), m["removed"].alias("removed"))


@query(f"""WITH {_C} SELECT call_id, 0 AS call_no, tool_call_id, 'function' AS type, tool_name AS name, CASE WHEN tool_name IN ('execute_bash', 'search') AND call_id % 5 <> 0 THEN coalesce(action, '') END AS command,
 CASE WHEN tool_name IS NULL OR tool_name NOT IN ('execute_bash', 'search') THEN 'unknown_function' WHEN call_id % 5 = 0 THEN 'invalid_arguments' END AS error FROM calls1""")
def structured_calls(spark, d):
    """Calls as a chat interface sends them, arguments as an object, as text, or as text that does not parse."""
    c = calls(spark, d, "tool_call_id", "tool_name", "action")
    args = F.to_json(F.struct(F.coalesce("action", F.lit("")).alias("command")))
    quoted = F.to_json(F.struct(F.when(F.col("call_id") % 5 == 0, F.lit("{broken")).otherwise(args).alias("x")))
    value = F.when(F.col("call_id") % 5 < 3, F.substring(quoted, F.lit(6), F.length(quoted) - 6)).otherwise(args)
    head = F.to_json(F.struct(F.col("tool_call_id").alias("id"), F.struct(F.col("tool_name").alias("name"), F.lit("@@").alias("arguments")).alias("function")))
    text = F.concat(F.lit("["), F.replace(head, F.lit('"@@"'), value), F.lit("]"))
    p = toolcalls.structured_calls(c.select("call_id", text.alias("t")), "call_id", "t", ["execute_bash", "search"])
    return p.select("call_id", "call_no", "tool_call_id", "type", "name", F.try_variant_get(F.try_parse_json("arguments"), "$.command", "string").alias("command"), "error")


_QUOTED = "CASE WHEN {0} = '' THEN '''''' WHEN regexp_full_match({0}, '[A-Za-z0-9_@%+=:,./-]+') THEN {0} ELSE '''' || replace({0}, '''', '''\"''\"''') || '''' END"


@query(f"""WITH {_C} SELECT call_id, CASE WHEN tool_name = 'execute_bash' THEN coalesce(action, '') ELSE tool_name || coalesce(' ' || {_QUOTED.format("action")}, '') || coalesce(' --status ' || {_QUOTED.format("status")}, '') END AS command FROM calls1 WHERE tool_name IS NOT NULL""")
def shell_commands(spark, d):
    """The command line of each call."""
    args = F.filter(F.array(F.struct(F.lit("command").alias("key"), F.col("action").alias("value")), F.struct(F.lit("status").alias("key"), F.col("status").alias("value"))), lambda a: a["value"].isNotNull())
    return calls(spark, d, "tool_name", "action", "status").where("tool_name is not null").select("call_id", toolcalls.shell_command(F.col("tool_name"), args).alias("command"))


@query(f"""WITH {_C} SELECT call_id, '<parameter=tool>' || tool_name || '</parameter> <parameter=status>' || status || '</parameter>' AS xml, '{{"tool": ' || to_json(tool_name)::VARCHAR || ', "status": ' || to_json(status)::VARCHAR || '}}' AS json FROM calls1 WHERE tool_name IS NOT NULL AND status IS NOT NULL""")
def argument_examples(spark, d):
    args = F.array(F.struct(F.lit("tool").alias("key"), F.col("tool_name").alias("value")), F.struct(F.lit("status").alias("key"), F.col("status").alias("value")))
    return calls(spark, d, "tool_name", "status").where("tool_name is not null and status is not null").select("call_id", toolcalls.arguments_example(args).alias("xml"), toolcalls.arguments_example(args, "hermes").alias("json"))


@query(rf"""WITH {_T}, {_BLOCKS} SELECT turn_id, CAST(call_no AS INT) AS call_no, greatest(1, least(CASE WHEN t > 0 THEN t ELSE 60 END, 120, 90)) AS seconds FROM (SELECT turn_id, call_no, TRY_CAST(args ->> '$.timeout' AS INT) AS t FROM q WHERE jt = 'OBJECT' AND nt = 'VARCHAR' AND json_type(args) = 'OBJECT')""")
def call_timeouts(spark, d):
    """Seconds that each call of a response may take."""
    c = toolcalls.hermes_calls(turns(spark, d, "response"), "turn_id", "response").where("error is null")
    asked = F.try_variant_get(F.try_parse_json("arguments"), "$.timeout", "string")
    return c.select("turn_id", "call_no", toolcalls.timeout(asked, 60, 120, F.lit(89.5)).alias("seconds"))


_FINISHED = rf"""f AS (SELECT run_id, step_idx, turn_id, response FROM turns1 WHERE exit_reason = 'finished'),
j AS (SELECT *, regexp_extract(response, '(?s)<tool_call>(.*?)</tool_call>', 1) AS raw FROM f),
k AS (SELECT *, CASE WHEN json_valid(trim(raw)) THEN trim(raw)::JSON ->> '$.arguments.command' END AS said FROM j),
o AS (SELECT run_id, step_idx, arg_max(trim(observation), (call_idx, call_id)) AS shown FROM calls1 WHERE tool_name = 'execute_bash' AND status = 'ok' GROUP BY ALL),
a AS (SELECT k.run_id, k.step_idx, k.turn_id, coalesce(said, nullif(shown, '')) AS answer FROM k LEFT JOIN o ON o.run_id = k.run_id AND o.step_idx = k.step_idx),
best AS (SELECT run_id, arg_max(answer, (step_idx, turn_id)) AS answer FROM a WHERE answer IS NOT NULL GROUP BY run_id)"""


@query(f"WITH {_T}, {_C}, {_FINISHED} SELECT run_id, answer FROM best")
def answer_extraction(spark, d):
    """What each finished run answered: the command of its last finished step's call, else what its last good call showed."""
    return grading.answers(turns(spark, d, "run_id", "step_idx", "response", "exit_reason"), calls(spark, d, *PLACE, "tool_name", "status", "observation"), "command", ("execute_bash",))


_N = _NORM.format("answer")
_G = _NORM.format("'The ' || upper((SELECT arg_min(answer, run_id) FROM best)) || ' !'")


@query(f"WITH {_T}, {_C}, {_FINISHED}, r AS (SELECT DISTINCT run_id FROM turns1) SELECT r.run_id, CASE WHEN answer IS NOT NULL AND {_N} = {_G} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, answer IS NOT NULL AS answered FROM r LEFT JOIN best ON best.run_id = r.run_id")
def search_scores(spark, d):
    """Every run's score against the first finished run's answer, written otherwise; runs without an answer score 0."""
    t = turns(spark, d, "run_id", "step_idx", "response", "exit_reason")
    a = grading.answers(t, calls(spark, d, *PLACE, "tool_name", "status", "observation"), "command", ("execute_bash",))
    first = a.agg(F.min_by("answer", "run_id").alias("first"))
    x = t.select("run_id").distinct().join(a, "run_id", "left").crossJoin(F.broadcast(first))  # one row
    wanted = F.array(F.lit("no such answer"), F.concat(F.lit("The "), F.upper("first"), F.lit(" !")))
    return x.select("run_id", grading.search_score(F.col("answer"), wanted).alias("score"), F.col("answer").isNotNull().alias("answered"))
