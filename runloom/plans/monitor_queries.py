"""Queries of run monitoring and keyed state, each with the DuckDB SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import monitor, sequence
from runloom.plans.agent_queries import _T, turns
from runloom.plans.agent_queries import SQL as AGENT_SQL
from runloom.plans.agent_queries import run_status as _run_status
from runloom.plans.registering import collection
from runloom.sources.tables import table
from runloom.streaming import chats

QUERIES, SQL, query = collection()

# Listings made of the log: at each of four scans the lines below a bound; one file is rotated, another goes, some runs end early.
_SCANS = 4


def listings(spark, d):
    """(run_id, scan, path, size, mtime) of the log's files at four scans."""
    lines = table(spark, d, "run_log").where("run_id is not null and source is not null and byte_offset is not null").select("run_id", F.col("source").alias("path"), "byte_offset").distinct()
    at = lines.withColumn("scan", F.explode(F.array(*[F.lit(i) for i in range(_SCANS)]))).where(F.col("byte_offset") < 1500 * (F.col("scan") + 1))
    at = at.where(~((F.col("path") == "eval_verify.log") & (F.col("scan") == 2) & (F.col("byte_offset") < 3000)) & ~((F.col("path") == "sandbox.log") & (F.col("scan") == 2)) & ~(F.col("run_id").endswith("3") & (F.col("scan") == 3)))
    return at.groupBy("run_id", "scan", "path").agg(F.max("byte_offset").alias("size"), (F.count("*") % 5).alias("mtime"))


_L = """ls AS (SELECT run_id, scan, source AS path, max(byte_offset) AS size, count(*) % 5 AS mtime FROM (SELECT DISTINCT run_id, source, byte_offset, scan FROM run_log, range(4) t(scan) WHERE byte_offset < 1500 * (scan + 1) AND run_id IS NOT NULL AND source IS NOT NULL
 AND NOT (source = 'eval_verify.log' AND scan = 2 AND byte_offset < 3000) AND NOT (source = 'sandbox.log' AND scan = 2) AND NOT (ends_with(run_id, '3') AND scan = 3)) GROUP BY ALL)"""


@query(f"""WITH {_L}, e AS (SELECT run_id, max(scan) AS seen FROM ls GROUP BY 1), k AS (SELECT DISTINCT run_id, path FROM ls), g AS (SELECT k.run_id, s.scan, k.path FROM k, range(4) s(scan) JOIN e ON e.run_id = k.run_id WHERE s.scan <= seen),
x AS (SELECT g.*, a.size, a.mtime, b.size AS size0, b.mtime AS mtime0, g.path = 'run.log' OR regexp_matches(g.path, '(verify|eval)') AS follows FROM g LEFT JOIN ls a ON a.run_id = g.run_id AND a.path = g.path AND a.scan = g.scan LEFT JOIN ls b ON b.run_id = g.run_id AND b.path = g.path AND b.scan = g.scan - 1),
y AS (SELECT *, CASE WHEN size IS NULL THEN CASE WHEN size0 IS NOT NULL THEN 'deleted' END WHEN follows THEN CASE WHEN size <> coalesce(size0, 0) AND size > CASE WHEN size0 IS NULL OR size < size0 THEN 0 ELSE size0 END THEN 'log_append' END WHEN size0 IS NULL THEN 'created' WHEN size <> size0 OR mtime <> mtime0 THEN 'modified' END AS type FROM x)
SELECT run_id, CAST(scan AS INT) AS scan, type, path, coalesce(size, 0) AS size, CASE WHEN type = 'log_append' THEN CASE WHEN size0 IS NULL OR size < size0 THEN 0 ELSE size0 END END AS from_byte FROM y WHERE type IS NOT NULL
UNION ALL SELECT run_id, CAST(seen + 1 AS INT), 'run_removed', NULL, 0, NULL FROM e WHERE seen < (SELECT max(seen) FROM e)""")
def file_events(spark, d):
    """What changes between scans of the runs' folders."""
    return monitor.file_events(listings(spark, d))


@query(f"""WITH {_L}, e AS (SELECT *, row_number() OVER (ORDER BY scan, run_id, path) AS id FROM ls) SELECT run_id, CAST(scan AS INT) AS scan, path, id FROM e WHERE id > (SELECT max(id) FROM e) - 50""")
def event_ring(spark, d):
    """Events numbered over all runs, the newest fifty kept."""
    return monitor.numbered_events(listings(spark, d).select("run_id", F.col("scan").cast("int").alias("scan"), "path"), ["scan", "run_id", "path"], 50)


_STATES = """st AS (SELECT run_id, CAST(scan AS INT) AS scan, CASE WHEN max(size) FILTER (WHERE path = 'eval_verify.log') IS NOT NULL THEN 'verify' WHEN max(size) FILTER (WHERE path = 'run.log') > 1000 THEN 'running' ELSE 'queued' END AS status FROM ls GROUP BY ALL)"""


@query(f"WITH {_L}, {_STATES} SELECT a.run_id, a.scan, a.status FROM st a LEFT JOIN st b ON b.run_id = a.run_id AND b.scan = a.scan - 1 WHERE a.status <> coalesce(b.status, 'queued')")
def status_changes(spark, d):
    """Scans at which a run's state is another than before."""
    size = lambda p: F.max(F.when(F.col("path") == p, F.col("size")))
    s = listings(spark, d).groupBy("run_id", "scan").agg(F.when(size("eval_verify.log").isNotNull(), "verify").when(size("run.log") > 1000, "running").otherwise("queued").alias("status"))
    return monitor.status_changes(s)


@query("SELECT DISTINCT source AS path, CASE WHEN source = 'run.log' THEN 'Run log' WHEN contains(source, 'verify') OR contains(source, 'eval') THEN 'Verify log' ELSE source END AS label, source = 'run.log' OR contains(source, 'verify') OR contains(source, 'eval') AS followed FROM run_log WHERE source IS NOT NULL")
def log_labels(spark, d):
    p = F.col("source")
    return table(spark, d, "run_log").where("source is not null").select("source").distinct().select(p.alias("path"), monitor.label(p).alias("label"), monitor.streamable(p).alias("followed"))


_RUNS = f"""rr AS ({AGENT_SQL["run_status"]}), ru AS (SELECT rr.run_id, status, lines, files, coalesce(created_at, 0) AS created_at, coalesce(last_update, 0) AS last_update FROM rr LEFT JOIN (SELECT run_id, string_agg(DISTINCT source, ' ' ORDER BY source) AS files FROM run_log GROUP BY 1) f ON f.run_id = rr.run_id
 LEFT JOIN (SELECT run_id, epoch_us(min(started_at)) AS created_at, epoch_us(max(started_at)) AS last_update FROM turns GROUP BY 1) t ON t.run_id = rr.run_id)"""


def _runs(spark, d):
    """Runs with state, files and times (microseconds)."""
    files = table(spark, d, "run_log").groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("source")), " ").alias("files"))
    us = F.unix_micros(F.col("started_at").cast("timestamp"))
    times = table(spark, d, "turns").groupBy("run_id").agg(F.min(us).alias("created_at"), F.max(us).alias("last_update"))
    r = _run_status(spark, d).join(files, "run_id", "left").join(times, "run_id", "left")
    return r.withColumn("created_at", F.coalesce("created_at", F.lit(0))).withColumn("last_update", F.coalesce("last_update", F.lit(0)))


@query(f"WITH {_RUNS} SELECT run_id, status, created_at FROM ru WHERE contains(lower(run_id), 'r0') AND status = 'verify'")
def dashboard_snapshot(spark, d):
    return monitor.snapshot(_runs(spark, d), "R0", "verify").select("run_id", "status", "created_at")


@query(f"WITH {_RUNS} SELECT count(*) AS total, count(*) FILTER (WHERE status IN ('running', 'verify')) AS active, coalesce(max(last_update), 0) AS last_update FROM ru WHERE contains(lower(run_id), 'r0')")
def dashboard_snapshot_stats(spark, d):
    return monitor.snapshot_stats(_runs(spark, d), "R0")


@query(f"WITH {_RUNS}, f AS (SELECT 'files' AS mode, * FROM ru WHERE contains(files, 'gateway') AND contains(files, 'run.') UNION ALL SELECT 'all', * FROM ru WHERE contains(lower(run_id || ' ' || status || ' ' || files), 'completed')) SELECT mode, run_id, row_number() OVER (PARTITION BY mode ORDER BY status = 'completed', created_at, run_id) - 1 AS place FROM f")
def dashboard_modes(spark, d):
    """Searches over files and over everything, completed runs last."""
    r = _runs(spark, d).withColumn("log", F.lit(""))
    one = lambda q, mode: monitor.search_by(r, q, mode).select(F.lit(mode).alias("mode"), "run_id", "place")
    return one("Gateway run.", "files").unionByName(one("completed", "all"))


@query("SELECT run_id, source, min(byte_offset) AS start, max(byte_offset + strlen(coalesce(text, '')) + 1) AS \"end\", min(byte_offset) > 0 AS has_more FROM run_log WHERE byte_offset >= 1000 AND byte_offset + strlen(coalesce(text, '')) + 1 <= 3000 GROUP BY ALL")
def log_page_bounds(spark, d):
    return monitor.page_bounds(table(spark, d, "run_log"), 3000, 2000)


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'click' AS click, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), i AS (SELECT *, k - row_number() OVER (PARTITION BY user_id, click ORDER BY event_id) AS g FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, click, g ORDER BY event_id) AS nth FROM i) SELECT user_id, event_id, click, sum(CASE WHEN (nth - 1) % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS batch FROM n""")
def micro_batches(spark, d):
    """Requests of a user in batches of three, clicks never beside others."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "click").alias("click"))
    return monitor.micro_batches(e, "user_id", ["event_id"], "click", 3)


def chat_messages(spark, d):
    """First deliveries of chat messages, numbered in their chat."""
    e = table(spark, d, "chat_events").where("chat_id is not null").select("chat_id", "delivery_id", "content")
    return sequence.numbered(e, "chat_id", ("delivery_id",), "seq").select("chat_id", "seq", "content")


@query("""WITH e AS (SELECT chat_id, row_number() OVER (PARTITION BY chat_id ORDER BY delivery_id) AS seq, trim(coalesce(content, '')) <> '' AS good FROM chat_events WHERE chat_id IS NOT NULL)
SELECT chat_id, seq, CAST(least(coalesce(sum(good::INT) OVER (PARTITION BY chat_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS INT) AS remembered, NOT good AS failed FROM e""")
def chat_memory(spark, d):
    return chats.memory(chat_messages(spark, d), 6)


@query(f"""WITH {_T}, e AS (SELECT run_id, started_at AS t0, coalesce(exit_reason, '') <> '' AS ends FROM turns1 WHERE run_id IS NOT NULL), s AS (SELECT run_id AS session_id, round((epoch_us(min(t0) FILTER (WHERE ends)) - epoch_us(min(t0))) / 1e6, 6) AS waited_s FROM e GROUP BY run_id) SELECT session_id, waited_s, coalesce(waited_s, 1e18) > 1800 AS timed_out FROM s""")
def session_timeouts(spark, d):
    """Runs that take longer than half an hour to end, or never do."""
    e = turns(spark, d, "run_id", "started_at", "exit_reason").where("run_id is not null")
    return chats.completion_times(e.select(F.col("run_id").alias("session_id"), F.col("started_at").alias("at"), F.when(F.coalesce("exit_reason", F.lit("")) != "", "complete").otherwise("request").alias("event")), 1800.0)
