"""Growing and changing files of runs as events, on a stream of listings; ``monitor.file_events`` is the twin in batch."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.shipping import by_value
from runloom.streaming.in_order import keyed

by_value(sys.modules[__name__])

_COLUMNS = ["run_id", "scan", "type", "path", "size", "from_byte"]


def _follows(path: str) -> bool:
    low = path.lower()
    return low == "run.log" or low.endswith((".log", ".txt")) and ("verify" in low or "eval" in low)


def step(state: dict, event: dict) -> tuple[dict, list[dict]]:
    """One scan of a run: ``event`` has scan and files, JSON {path: [size, mtime]}."""
    import json

    before, now = state.get("files", {}), json.loads(event["files"])
    rows = []

    def add(kind: str, path: str, size: int, begin: int | None = None) -> None:
        rows.append({"scan": event["scan"], "type": kind, "path": path, "size": size, "from_byte": begin})

    for path, (size, mtime) in sorted(now.items()):
        old = before.get(path)
        if _follows(path):
            begin = 0 if old is None or size < old[0] else old[0]
            if size != (old[0] if old else 0) and size > begin:
                add("log_append", path, size, begin)
        elif old is None:
            add("created", path, size)
        elif old != [size, mtime]:
            add("modified", path, size)
    for path in sorted(set(before) - set(now)):
        add("deleted", path, 0)
    return {"files": now}, rows


def file_events(listings: DataFrame) -> DataFrame:
    """(run_id, scan, type, path, size, from_byte) on a stream of whole listings (run_id, scan, files), one row per run and scan, in any order.

    A scan waits for those before it, from 0. Runs that are gone send nothing, so their removal is the batch twin's to tell."""
    rows = listings.select("run_id", F.col("scan").cast("long").alias("scan"), "files")
    return keyed(rows, "run_id", "scan", step, {}, "run_id string, scan int, type string, path string, size long, from_byte long", _COLUMNS, first=0)


def status_step(state: dict, event: dict) -> tuple[dict, list[dict]]:
    was = state.get("status", "queued")
    rows = [] if event["status"] == was else [{"scan": event["scan"], "status": event["status"]}]
    return {"status": event["status"]}, rows


def status_changes(states: DataFrame) -> DataFrame:
    """(run_id, scan, status) on a stream of states, where they differ from the scan before; a run begins as queued."""
    rows = states.select("run_id", F.col("scan").cast("long").alias("scan"), "status")
    return keyed(rows, "run_id", "scan", status_step, {}, "run_id string, scan int, status string", ["run_id", "scan", "status"], first=0)
