"""Runs as a dashboard shows them: states, search, statistics, log pages, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Texts in a log by which a run's state is told.
VERIFYING = ("reward_spec", "Eval report:", "Beginning environment shutdown", "Environment shutdown completed", "num_turns:")
RUNNING = ("Beginning environment startup", "Runtime initialized", "STEP ", "MODEL INPUT", "ACTION:")


def run_status(lines: DataFrame, finished: DataFrame | None = None) -> DataFrame:
    """(run_id, status, lines): completed if in ``finished``, else verify or running by the texts of its lines, else queued. Combined map-side."""
    t = F.coalesce("text", F.lit(""))
    has = lambda words: F.max(F.greatest(*[t.contains(w).cast("int") for w in words]))
    s = lines.groupBy("run_id").agg(has(VERIFYING).alias("v"), has(RUNNING).alias("r"), F.count("*").alias("lines"))
    state = F.when(F.col("v") == 1, "verify").when(F.col("r") == 1, "running").otherwise("queued")
    if finished is None:
        return s.select("run_id", state.alias("status"), "lines")
    done = finished.select("run_id").distinct().withColumn("done", F.lit(True))
    return s.join(done, "run_id", "left").select("run_id", F.when(F.col("done"), "completed").otherwise(state).alias("status"), "lines")


def label(path: Column) -> Column:
    """What a log file is called: Run log, Verify log, else its name."""
    low = F.lower(path)
    return F.when(low == "run.log", "Run log").when(low.contains("verify") | low.contains("eval"), "Verify log").otherwise(F.substring_index(path, "/", -1))


def streamable(path: Column) -> Column:
    """Whether a file is followed as it grows: run.log, and logs and texts of verification and evaluation."""
    low = F.lower(path)
    return (low == "run.log") | (low.rlike(r"\.(log|txt)$") & (low.contains("verify") | low.contains("eval")))


def stats(runs: DataFrame) -> DataFrame:
    """One row: runs per state, active ones, lines."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return runs.agg(F.count("*").alias("total"), n("completed"), n("verify"), n("running"), n("queued"), F.count_if(F.col("status").isin("running", "verify")).alias("active"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


def snapshot(runs: DataFrame, query: str = "", status: str = "all") -> DataFrame:
    """``runs`` (run_id, status, created_at, ...) whose id holds the query, whatever its case, and whose state is the one asked for, by creation and id."""
    out = runs.where(F.contains(F.lower("run_id"), F.lit(query.lower()))) if query else runs
    return (out if status == "all" else out.where(F.col("status") == status)).orderBy("created_at", "run_id")


def snapshot_stats(runs: DataFrame, query: str = "", status: str = "all") -> DataFrame:
    """One row on the runs that ``snapshot`` shows: runs, active ones, the latest update (0 without any)."""
    r = snapshot(runs, query, status)
    return r.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("running", "verify")).alias("active"), F.coalesce(F.max("last_update"), F.lit(0)).alias("last_update"))


def search(runs: DataFrame, query: str, blob: Column) -> DataFrame:
    """Runs whose blob holds every word of the query, whatever its case."""
    words = [w for w in query.lower().split() if w]
    keep = F.lit(True)
    for w in words:
        keep = keep & F.lower(blob).contains(w)
    return runs.where(keep)


def search_by(runs: DataFrame, query: str, mode: str) -> DataFrame:
    """``search`` over a run's id, its status, its files, its log or all of these, with place: completed runs last, else by creation and id.

    ``runs`` has run_id, status, created_at, files, log."""
    from runloom.operators.order import with_index

    blobs = {"run_id": ["run_id"], "status": ["status"], "files": ["files"], "logs": ["log"], "all": ["run_id", "status", "files", "log"]}
    if mode not in blobs:
        raise ValueError(f"no mode {mode!r}; there are {sorted(blobs)}")
    found = search(runs, query, F.concat_ws(" ", *blobs[mode])).withColumn("late", F.col("status") == "completed")
    return with_index(found, "late", "created_at", "run_id", name="place").drop("late")


def _page(lines: DataFrame, before: int, size: int) -> DataFrame:
    ends = F.col("byte_offset") + F.octet_length(F.coalesce("text", F.lit(""))) + 1
    return lines.where((F.col("byte_offset") >= before - size) & (F.col("byte_offset") < before)).where(ends <= before)


def page_back(lines: DataFrame, before: int, size: int) -> DataFrame:
    """The lines of each file that lie wholly, line break included, in the ``size`` bytes before byte ``before``: (run_id, source, byte_offset, text), copies once."""
    return _page(lines, before, size).dropDuplicates(["run_id", "source", "byte_offset"]).select("run_id", "source", "byte_offset", "text")


def page_bounds(lines: DataFrame, before: int, size: int) -> DataFrame:
    """(run_id, source, start, end, has_more) of such a page: where its first line begins and its last one ends, and whether there are lines before it."""
    ends = F.col("byte_offset") + F.octet_length(F.coalesce("text", F.lit(""))) + 1
    page = _page(lines, before, size).groupBy("run_id", "source").agg(F.min("byte_offset").alias("start"), F.max(ends).alias("end"))
    return page.select("run_id", "source", "start", "end", (F.col("start") > 0).alias("has_more"))


def newest(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The n newest rows of each key (a bounded buffer)."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rn") <= n)


def events_after(events: DataFrame, cursor: int) -> DataFrame:
    return events.where(F.col("event_id") > cursor)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(run_id, path, change): created, modified (size or time differs) or deleted files between two listings."""
    a = before.select("run_id", "path", F.struct("size", "mtime_ns").alias("old"))
    b = after.select("run_id", "path", F.struct("size", "mtime_ns").alias("new"))
    j = a.join(b, ["run_id", "path"], "full_outer")
    return j.where(~F.col("old").eqNullSafe(F.col("new"))).select("run_id", "path", F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").otherwise("modified").alias("change"))


def file_events(listings: DataFrame) -> DataFrame:
    """(run_id, scan, type, path, size, from_byte) of listings (run_id, scan, path, size, mtime), scans numbered from 0 without holes.

    Logs that are followed give log_append with the byte their new text begins at: where the scan before ended, 0 for one that has
    become shorter; a log without new bytes gives none. Other files give created, or modified if size or time differ. A file that is
    gone gives deleted, and counts as new when it comes back. A run that is gone gives run_removed at the scan after its last,
    and no deletions. The stream over the same listings gives the same rows."""
    at = listings.select("run_id", F.col("scan").cast("int").alias("scan"), "path", F.col("size").cast("long").alias("size"), "mtime").distinct()
    last = at.agg(F.max("scan").alias("end"))  # one row
    seen = at.groupBy("run_id").agg(F.max("scan").alias("seen")).crossJoin(F.broadcast(last))
    was = at.select("run_id", (F.col("scan") + 1).alias("scan"), "path", F.col("size").alias("size0"), F.col("mtime").alias("mtime0"))
    j = at.join(was, ["run_id", "scan", "path"], "full_outer")
    follows, new = streamable(F.col("path")), F.col("size0").isNull()
    begin = F.when(new | (F.col("size") < F.col("size0")), F.lit(0)).otherwise(F.col("size0"))
    kind = F.when(F.col("size").isNull(), "deleted").when(follows, F.when((F.col("size") != F.coalesce("size0", F.lit(0))) & (F.col("size") > begin), "log_append")).when(new, "created").when((F.col("size") != F.col("size0")) | (F.col("mtime") != F.col("mtime0")), "modified")
    out = j.select("run_id", "scan", kind.alias("type"), "path", F.coalesce("size", F.lit(0)).alias("size"), F.when(kind == "log_append", begin).alias("from_byte")).where("type is not null")
    alive = out.join(seen, "run_id").where(F.col("scan") <= F.col("seen")).select("run_id", "scan", "type", "path", "size", "from_byte")
    gone = seen.where(F.col("seen") < F.col("end")).select("run_id", (F.col("seen") + 1).cast("int").alias("scan"), F.lit("run_removed").alias("type"), F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("from_byte"))
    return alive.unionByName(gone)


def status_changes(states: DataFrame) -> DataFrame:
    """(run_id, scan, status) wherever a run's state (run_id, scan, status) differs from the scan before; a run begins as queued."""
    was = states.select("run_id", (F.col("scan") + 1).alias("scan"), F.col("status").alias("was"))
    return states.select("run_id", "scan", "status").join(was, ["run_id", "scan"], "left").where(F.col("status") != F.coalesce("was", F.lit("queued"))).select("run_id", "scan", "status")


def numbered_events(events: DataFrame, order: list[str], keep: int) -> DataFrame:
    """``events`` with id, from 1 in the order given; the newest ``keep`` only."""
    from runloom.operators.order import with_index

    rows = with_index(events, *order, name="_pos")
    newest_id = rows.agg(F.max("_pos").alias("_last"))  # one row
    return rows.crossJoin(F.broadcast(newest_id)).where(F.col("_pos") > F.col("_last") - keep).withColumn("id", F.col("_pos") + 1).drop("_pos", "_last")


def micro_batches(requests: DataFrame, key: str, order: list[str], mode: str, cap: int) -> DataFrame:
    """``requests`` (key, order, mode) with batch, from 1: neighbours of one mode together, at most ``cap`` of them."""
    from runloom.operators.blocks import place, scan, unplace
    from runloom.operators.sequence import split_on_change
    from runloom.session import checkpoint

    runs = split_on_change(requests.select(key, *order, mode), [mode], key, tuple(order)).withColumnRenamed("trajectory", "island")
    x = scan(place(runs, [key, "island"], order[0]), order, sums={"nth": F.lit(1).cast("long")})
    x = checkpoint(unplace(x).withColumn("opens", ((F.col("nth") - 1) % cap == 0).cast("long")))
    x = scan(place(x, [key], order[0]), order, sums={"batch": F.col("opens")})
    return x.select(key, *order, mode, "batch")
