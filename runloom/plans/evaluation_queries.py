"""Queries of evaluation runs, each with the DuckDB SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.functions import text as T
from runloom.operators import evaluation, grading
from runloom.plans.agent_queries import _C, _PL, _SEEN, _T, PLACE, calls, expected, states, turns
from runloom.plans.registering import collection
from runloom.sources.tables import table

QUERIES, SQL, query = collection()

_EX = "ex AS (SELECT run_id, test, CASE first_status WHEN 'FAILED' THEN 'F2P' ELSE 'P2P' END AS kind FROM st WHERE first_status IN ('FAILED', 'PASSED'))"


def _logs(spark, d):
    """Observations as logs: a third between markers, a third with a first marker only, a third without."""
    text = F.coalesce("observation", F.lit(""))
    marked = F.when(F.col("call_id") % 3 == 0, F.concat(F.lit("setup\n" + grading.START + "\n"), text, F.lit("\n" + grading.END + "\nPASSED outside"))).when(F.col("call_id") % 3 == 1, F.concat(F.lit(grading.START + "\n"), text)).otherwise(text)
    return calls(spark, d, "observation").select("call_id", marked.alias("log"))


_LOG = f"""lg AS (SELECT call_id, CASE call_id % 3 WHEN 0 THEN 'setup' || chr(10) || '{grading.START}' || chr(10) || coalesce(observation, '') || chr(10) || '{grading.END}' || chr(10) || 'PASSED outside' WHEN 1 THEN '{grading.START}' || chr(10) || coalesce(observation, '') ELSE coalesce(observation, '') END AS log, chr(10) || coalesce(observation, '') || chr(10) AS sect FROM calls1)"""


@query(f"WITH {_C}, {_LOG} SELECT call_id, CASE WHEN call_id % 3 = 0 THEN sect END AS strict, CASE WHEN call_id % 3 = 0 THEN sect ELSE log END AS lenient FROM lg")
def marker_sections(spark, d):
    return _logs(spark, d).select("call_id", grading.section(F.col("log")).alias("strict"), grading.section(F.col("log"), True).alias("lenient"))


def _parsed(source: str) -> str:
    """Lines of a text column as (call_id, test, status), the last state of a test."""
    return rf"""SELECT call_id, p[2] AS test, arg_max(p[1], no) AS status FROM (SELECT call_id, no, string_split_regex(trim(CASE WHEN starts_with(line, 'FAILED') THEN replace(line, ' - ', ' ') ELSE line END), '\s+') AS p FROM (SELECT call_id, unnest(l) AS line, generate_subscripts(l, 1) AS no FROM (SELECT call_id, string_split(regexp_replace(t, '\x1b\[[0-9;]*m|\r', '', 'g'), chr(10)) AS l FROM {source})) WHERE regexp_matches(line, '^(PASSED|FAILED|ERROR|SKIPPED|XFAIL)')) WHERE len(p) >= 2 GROUP BY ALL"""


@query(f"WITH {_C}, {_LOG}, a AS ({_parsed('(SELECT call_id, CASE WHEN call_id % 3 = 0 THEN sect ELSE log END AS t FROM lg)')}), b AS ({_parsed('(SELECT call_id, log AS t FROM lg WHERE call_id NOT IN (SELECT call_id FROM a))')}) SELECT * FROM a UNION ALL SELECT * FROM b")
def lenient_states(spark, d):
    """States between the markers, of the whole log where nothing stands there."""
    return evaluation.lenient_states(_logs(spark, d), "call_id", "log")


_V2 = r"regexp_replace(regexp_replace(line, '\[(\d+)m', '', 'g'), '[\x01-\x1f]', '', 'g')"


@query(rf"""WITH {_C}, ln AS (SELECT call_id, unnest(l) AS raw, generate_subscripts(l, 1) AS no FROM (SELECT call_id, string_split(regexp_replace(observation, '\x1b\[[0-9;]*m|\r', '', 'g'), chr(10)) AS l FROM calls1 WHERE observation IS NOT NULL)),
x AS (SELECT call_id, no, {_V2} AS line FROM (SELECT call_id, no, CASE WHEN no % 2 = 0 AND regexp_matches(raw, '^(PASSED|FAILED|ERROR) \S+$') THEN regexp_replace(raw, '^(\S+) (\S+)$', '\2 [32m\1') ELSE raw END AS line FROM ln)),
p AS (SELECT call_id, no, CASE WHEN regexp_matches(line, '^(PASSED|FAILED|ERROR|SKIPPED|XFAIL)') THEN string_split_regex(trim(CASE WHEN starts_with(line, 'FAILED') THEN replace(line, ' - ', ' ') ELSE line END), '\s+') END AS a, CASE WHEN regexp_matches(line, '(PASSED|FAILED|ERROR|SKIPPED|XFAIL)$') THEN string_split_regex(trim(line), '\s+') END AS b FROM x)
SELECT call_id, CASE WHEN len(a) >= 2 THEN a[2] ELSE b[1] END AS test, arg_max(CASE WHEN len(a) >= 2 THEN a[1] ELSE b[2] END, no) AS status FROM p WHERE len(a) >= 2 OR (coalesce(len(a), 0) < 2 AND len(b) >= 2) GROUP BY ALL""")
def test_states_v2(spark, d):
    """The second parser, on logs of which every other state line has the state behind the name, coloured."""
    c = calls(spark, d, "observation").where("observation is not null").select("call_id", F.split(T.strip_ansi(F.col("observation")), "\n", -1).alias("l"))
    turned = F.transform("l", lambda x, i: F.when(((i + 1) % 2 == 0) & x.rlike(r"^(PASSED|FAILED|ERROR) \S+$"), F.regexp_replace(x, r"^(\S+) (\S+)$", "$2 [32m$1")).otherwise(x))
    return grading.test_states(c.select("call_id", F.array_join(turned, "\n").alias("t")), ["call_id"], "t", ["call_id"], "v2").select("call_id", "test", "status")


test_states_v2.__test__ = False


@query(f"""WITH {_C}, {_PL}, w AS (SELECT run_id, split_part(test, '::', 1) AS t, arg_max(first_status, test) AS want FROM st GROUP BY ALL), g AS (SELECT run_id, split_part(test, '::', 1) AS t, arg_max(status, test) AS got FROM st WHERE status <> 'SKIPPED' GROUP BY ALL)
SELECT coalesce(w.run_id, g.run_id) AS run_id, count(want) AS wanted, count(got) AS observed, bool_and(coalesce(want = got, false)) AS equal FROM w FULL JOIN g ON w.run_id = g.run_id AND w.t = g.t GROUP BY 1""")
def grade_exact_names(spark, d):
    """Test maps by names cut at ' - ', here between a test's file and its function."""
    s = states(spark, d).withColumn("test", F.replace("test", F.lit("::"), F.lit(" - ")))
    return evaluation.grade_exact_names(s.select("run_id", "test", F.col("first_status").alias("status")), s.where("status <> 'SKIPPED'"))


@query(rf"""WITH {_C}, o AS ({_parsed("(SELECT call_id, observation AS t FROM calls1 WHERE observation IS NOT NULL)")}),
e AS (SELECT DISTINCT call_id, 'F2P' AS kind, unnest(regexp_extract_all(observation, '(?m)^FAILED (\S+)', 1)) AS test FROM calls1 UNION SELECT DISTINCT call_id, 'P2P', unnest(regexp_extract_all(observation, '(?m)^PASSED (\S+)', 1)) FROM calls1),
j AS (SELECT e.*, coalesce(o.status = 'PASSED', false) AS ok FROM e LEFT JOIN o ON o.call_id = e.call_id AND o.test = e.test),
g AS (SELECT call_id, count(*) FILTER (WHERE kind = 'F2P' AND ok) AS f2p_passed, count(*) FILTER (WHERE kind = 'F2P' AND NOT ok) AS f2p_failed, count(*) FILTER (WHERE kind = 'P2P' AND ok) AS p2p_passed, count(*) FILTER (WHERE kind = 'P2P' AND NOT ok) AS p2p_failed FROM j GROUP BY call_id)
SELECT *, f2p_passed > 0 AND f2p_failed = 0 AND p2p_failed = 0 AS resolved FROM g""")
def grade_listed(spark, d):
    """Expected tests as JSON lists beside each log."""
    c = calls(spark, d, "observation").where("observation is not null")
    names = lambda s: F.to_json(F.regexp_extract_all("observation", F.lit(rf"(?m)^{s} (\S+)"), F.lit(1)))
    tasks = c.select("call_id", names("FAILED").alias("f2p"), names("PASSED").alias("p2p"))
    return evaluation.grade_listed(tasks, grading.test_states(c, ["call_id"], "observation", ["call_id"]), "call_id")


@query("""SELECT turn_id, CASE WHEN turn_id % 5 = 0 THEN 0.0 WHEN turn_id % 5 = 1 THEN 0.5 WHEN turn_id % 5 = 2 THEN 0.25 ELSE 0.0 END::DOUBLE AS reward, CASE turn_id % 5 WHEN 0 THEN 'not_an_object' WHEN 3 THEN 'not_a_number' WHEN 4 THEN 'no_file' END AS error FROM turns""".replace("FROM turns", "FROM (SELECT DISTINCT turn_id FROM turns)"))
def reward_files(spark, d):
    m = F.col("turn_id") % 5
    json = F.when(m == 0, "[1]").when(m == 1, '{"reward": 0.5, "n": 2}')
    plain = F.when(m == 2, " 0.25\n").when(m == 3, "a few")
    r = evaluation.reward(json, F.trim(F.regexp_replace(plain, r"\s+$", "")))
    return turns(spark, d).select("turn_id", r["reward"].alias("reward"), r["error"].alias("error"))


@query("SELECT doc_id, '/' || coalesce(source, 'none') || '/' || coalesce(lang, 'xx') AS workdir FROM documents")
def workdirs(spark, d):
    text = F.concat(F.lit("FROM base\n# WORKDIR /no\nworkdir away\n  WORKDIR /"), F.coalesce("source", F.lit("none")), F.lit("/\nRUN WORKDIR\nWORKDIR  "), F.coalesce("lang", F.lit("xx")), F.lit("\n"))
    return table(spark, d, "documents").select("doc_id", evaluation.workdir(text).alias("workdir"))


@query(rf"""WITH {_C}, f AS (SELECT call_id, regexp_extract_all(observation, '(?m)^FAILED (\S+)$', 1) AS l FROM calls1 WHERE observation IS NOT NULL) SELECT call_id, CAST(u.i - 1 AS INT) AS no, l[u.i] AS test, 'line ' || u.i AS traceback FROM (SELECT call_id, list_distinct(l) AS d, l, unnest(generate_series(1, len(l))) AS i FROM f WHERE len(l) = len(list_distinct(l)) AND len(l) > 0) u""")
def traceback_pairs(spark, d):
    """Tracebacks of logs made of each call's failed tests, paired with their names by order."""
    tests = F.regexp_extract_all("observation", F.lit(r"(?m)^FAILED (\S+)$"), F.lit(1))
    c = calls(spark, d, "observation").where("observation is not null").select("call_id", tests.alias("l")).where((F.size("l") > 0) & (F.size("l") == F.size(F.array_distinct("l"))))
    bodies = F.array_join(F.transform("l", lambda t, i: F.concat(F.lit("____ "), t, F.lit(" ____\nline "), (i + 1).cast("string"), F.lit("\n"))), "\n")
    summary = F.array_join(F.transform("l", lambda t: F.concat(F.lit("FAILED "), t, F.lit(" - boom"))), "\n")
    log = F.concat(F.lit(grading.START + "\nstart\n===== FAILURES =====\n"), bodies, F.lit("\n===== short test summary =====\n"), summary, F.lit("\n" + grading.END))
    return evaluation.tracebacks(c.select("call_id", log.alias("log")), "call_id", "log")


@query()
def feedback_seeds(spark, d):
    """crc32 of run and step; DuckDB has no such function, a test holds it against zlib."""
    return turns(spark, d, "run_id", "step_idx").select("turn_id", evaluation.seed(F.col("run_id"), F.col("step_idx")).alias("seed"))


@query("""WITH b AS (SELECT repo, CASE WHEN lang = 'en' THEN 'a' ELSE 'b' END AS part, doc_id, n_chars AS size, sum(n_chars) OVER (PARTITION BY repo, CASE WHEN lang = 'en' THEN 'a' ELSE 'b' END ORDER BY doc_id) AS so_far FROM documents WHERE repo IS NOT NULL),
u AS (SELECT repo, coalesce(max(so_far) FILTER (WHERE part = 'a' AND so_far <= 1800), 0) AS ua, coalesce(max(so_far) FILTER (WHERE part = 'b' AND so_far <= 600), 0) AS ub FROM b GROUP BY repo),
ma AS (SELECT b.repo, max(so_far) - max(ua) AS m FROM b JOIN u USING (repo) WHERE part = 'a' AND so_far <= ua + 2400 - ua - ub GROUP BY b.repo),
t AS (SELECT b.repo, part, doc_id, size FROM b JOIN u USING (repo) LEFT JOIN ma ON ma.repo = b.repo WHERE CASE part WHEN 'a' THEN so_far <= 2400 - ub ELSE so_far <= ub + 2400 - ua - ub - coalesce(m, 0) END),
n AS (SELECT repo, min(part) AS part FROM b WHERE repo NOT IN (SELECT repo FROM t WHERE size > 0) GROUP BY repo), f AS (SELECT b.repo, b.part, arg_min(doc_id, doc_id) AS doc_id, arg_min(size, doc_id) AS size FROM b JOIN n ON n.repo = b.repo AND n.part = b.part GROUP BY ALL)
SELECT repo, part, doc_id, CAST(size AS BIGINT) AS size, false AS clipped FROM t UNION ALL SELECT repo, part, doc_id, CAST(2400 AS BIGINT), true FROM f WHERE size > 2400""")
def budget_shares(spark, d):
    """Documents of each repository shown within 2,400 characters, English ones and others three to one, leftovers passed on."""
    x = table(spark, d, "documents").where("repo is not null").select("repo", F.when(F.col("lang") == "en", "a").otherwise("b").alias("part"), "doc_id", "n_chars")
    return evaluation.share_budget(x, "repo", "part", "doc_id", "n_chars", 2400, {"a": 3, "b": 1})


_GRADED = f"""{_EX}, {_SEEN}, j AS (SELECT ex.*, coalesce(ob.status = 'PASSED', false) AS ok FROM ex LEFT JOIN ob ON ob.run_id = ex.run_id AND ob.test = ex.test),
g AS (SELECT run_id, count(*) FILTER (WHERE kind = 'F2P' AND ok) AS f2p_passed, count(*) FILTER (WHERE kind = 'F2P' AND NOT ok) AS f2p_failed, count(*) FILTER (WHERE kind = 'P2P' AND NOT ok) AS p2p_failed FROM j GROUP BY run_id),
bad AS (SELECT *, row_number() OVER (PARTITION BY run_id, kind ORDER BY test) AS nth FROM j WHERE NOT ok)"""


@query(f"""WITH {_C}, {_PL}, {_GRADED}, n AS (SELECT run_id, string_agg('- ' || test, chr(10) ORDER BY test) FILTER (WHERE kind = 'F2P' AND nth <= 3) AS f, string_agg('- ' || test, chr(10) ORDER BY test) FILTER (WHERE kind = 'P2P' AND nth <= 3) AS p FROM bad GROUP BY run_id),
x AS (SELECT g.run_id, concat_ws(chr(10) || chr(10), 'Evaluation summary: ' || CASE WHEN f2p_passed > 0 AND f2p_failed = 0 AND p2p_failed = 0 THEN 'resolved' ELSE 'not resolved' END || '. Target tests (FAIL_TO_PASS) passing: ' || f2p_passed || '/' || (f2p_passed + f2p_failed) || '. Regressions (PASS_TO_PASS now failing): ' || p2p_failed || '.',
 'Target tests still failing (' || f2p_failed || '):' || chr(10) || f, 'Previously-passing tests your change broke (' || p2p_failed || '):' || chr(10) || p, CASE WHEN f2p_passed = 0 THEN '{evaluation.MODES["eval_incomplete"]}' END) AS t FROM g LEFT JOIN n ON n.run_id = g.run_id)
SELECT run_id, CASE WHEN length(t) > 300 THEN left(t, 300) || chr(10) || '{evaluation.CUT_NOTE[1:]}' ELSE t END AS feedback FROM x""")
def feedback_text(spark, d):
    """What each run is told of its tests."""
    s = states(spark, d)
    e, seen = expected(s), s.where("status <> 'SKIPPED'").select("run_id", "test", "status")
    g = grading.grade_strict(e, seen)
    mode = evaluation.failure_mode(F.lit(None).cast("string"), F.lit("diff"), F.lit(False), F.col("f2p_passed") > 0, F.lit(True))
    bad = e.join(seen, ["run_id", "test"], "left").where("coalesce(status, '') <> 'PASSED'")
    return evaluation.feedback(g.withColumn("mode", mode), bad, most=3, cap=300)


@query(f"""WITH {_C}, {_PL}, {_GRADED}, k AS (SELECT run_id, kind, count(*) FILTER (WHERE ok) AS n_success, count(*) FILTER (WHERE NOT ok) AS n_failure FROM j GROUP BY ALL)
SELECT k.*, coalesce((SELECT string_agg(test, ',' ORDER BY test) FROM bad WHERE bad.run_id = k.run_id AND bad.kind = k.kind AND nth <= 4), '') AS failure, greatest(n_failure - 4, 0) AS failure_omitted FROM k""")
def report_buckets(spark, d):
    s = states(spark, d)
    return evaluation.report_buckets(expected(s), s.where("status <> 'SKIPPED'"), most=4)


@query(rf"""WITH {_C}, l AS (SELECT call_id, observation || chr(10) || 'Interrupted: 2 errors during collection' AS t FROM calls1 WHERE regexp_matches(observation, '(?m)^ERROR ')),
m AS (SELECT call_id, t, regexp_extract_all(t, '(?m)^ERROR\s+(\S+)\s+-\s+(.+)$', 1) AS f, regexp_extract_all(t, '(?m)^ERROR\s+(\S+)\s+-\s+(.+)$', 2) AS r FROM l)
SELECT call_id, CASE WHEN len(f) = 0 THEN '{evaluation.ABORT_DEFAULT}' ELSE array_to_string(list_transform(list_zip(f, r)[1:3], lambda z: z[1] || ' (' || trim(z[2]) || ')'), '; ') END AS reason FROM m""")
def abort_reasons(spark, d):
    """Logs whose collection broke off, with files and reasons."""
    c = calls(spark, d, "observation").where(F.col("observation").rlike("(?m)^ERROR "))
    return c.select("call_id", evaluation.collection_abort(F.concat("observation", F.lit("\nInterrupted: 2 errors during collection"))).alias("reason"))


_RESULTS = f"""rs AS (SELECT t.run_id, max(CASE WHEN exit_reason = 'finished' THEN 1 ELSE 0 END) = 1 AS resolved, max(CASE WHEN coalesce(exit_reason, '') NOT IN ('', 'token_limit') THEN 1 ELSE 0 END) = 1 AS completed, any_value(s) AS seconds FROM turns1 t LEFT JOIN (SELECT run_id, sum(execution_time) AS s FROM calls1 GROUP BY 1) c ON c.run_id = t.run_id GROUP BY t.run_id)"""


def _results(spark, d):
    """Per run: resolved, completed, and the seconds its calls took."""
    e = F.coalesce(F.col("exit_reason"), F.lit(""))
    t = turns(spark, d, "run_id", "exit_reason").groupBy("run_id").agg((F.max((e == "finished").cast("int")) == 1).alias("resolved"), (F.max((~e.isin("", "token_limit")).cast("int")) == 1).alias("completed"))
    return t.join(calls(spark, d, "run_id", "execution_time").groupBy("run_id").agg(F.sum("execution_time").alias("seconds")), "run_id", "left")


@query(f"""WITH {_T}, {_C}, {_RESULTS} SELECT count(*) AS total, count(*) FILTER (WHERE resolved) AS resolved, count(*) FILTER (WHERE NOT resolved AND completed) AS wrong_answer, count(*) FILTER (WHERE NOT resolved AND NOT completed) AS time_limit, round(coalesce(avg(seconds), 0), 6) AS mean_seconds, round(CASE WHEN count(*) > 0 THEN 100.0 * count(*) FILTER (WHERE resolved) / count(*) ELSE 0 END, 6) AS rate FROM rs""")
def verify_summary(spark, d):
    """The summary of all runs, with the seconds that their calls took."""
    return grading.verify_summary(_results(spark, d))


@query(f"WITH {_T}, {_C}, {_RESULTS} SELECT run_id, CASE WHEN completed THEN 'wrong_answer' ELSE 'time_limit' END AS kind FROM rs WHERE NOT resolved")
def verify_failures(spark, d):
    return evaluation.failures(_results(spark, d), "run_id")


@query("WITH r AS (SELECT CASE WHEN event_type = 'error' THEN NULL ELSE value / 100 END AS reward FROM events) SELECT count(*) AS total, count(*) FILTER (WHERE reward >= 0.5) AS resolved, round(coalesce(avg(coalesce(reward, 0)), 0), 6) AS mean_reward, round(CASE WHEN count(*) > 0 THEN 100.0 * count(*) FILTER (WHERE reward >= 0.5) / count(*) ELSE 0 END, 6) AS rate FROM r")
def score_summary(spark, d):
    return evaluation.score_summary(table(spark, d, "events").select(F.when(F.col("event_type") != "error", F.col("value") / 100).alias("reward")))


@query(f"""WITH {_C}, r AS (SELECT run_id, step_idx, call_idx, call_id, status = 'ok' AS o, status <> 'ok' AND status <> 'timeout' AS w, status = 'timeout' AS l FROM calls1)
SELECT *, round(100.0 * ok / (ok + wrong + late), 6) AS rate FROM (SELECT run_id, step_idx, call_idx, call_id, sum(o::INT) OVER x AS ok, sum(w::INT) OVER x AS wrong, sum(l::INT) OVER x AS late FROM r WINDOW x AS (PARTITION BY run_id ORDER BY step_idx, call_idx, call_id ROWS UNBOUNDED PRECEDING))""")
def running_tally(spark, d):
    c = calls(spark, d, *PLACE, "status").withColumn("resolved", F.col("status") == "ok").withColumn("completed", F.col("status") != "timeout")
    return evaluation.running_tally(c, "run_id", ["step_idx", "call_idx", "call_id"])


@query("SELECT count(*) AS samples, round(coalesce(avg(coalesce(list_sum(response_logprobs), 0)), 0), 6) AS mean_reward FROM (SELECT DISTINCT * FROM segments)")
def mean_reward(spark, d):
    return evaluation.mean_reward(table(spark, d, "segments").distinct(), "response_logprobs")


@query(f"WITH {_C} SELECT count(*) AS tasks, CAST(sum(n) AS BIGINT) AS rollouts, round(100.0 * avg(share), 6) AS avg_at_n FROM (SELECT run_id, avg(CASE WHEN status = 'ok' THEN 1.0 ELSE 0.0 END) AS share, count(*) AS n FROM calls1 GROUP BY run_id)")
def average_at_n(spark, d):
    return evaluation.average_at_n(calls(spark, d, "run_id", "status").withColumn("passed", F.col("status") == "ok"), "run_id", "passed")
