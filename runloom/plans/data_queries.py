"""Queries of the general data operators (log entries, repeated messages)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runloom.operators import dedup, loglines
from runloom.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Log entries."""
    return loglines.entries(table(spark, d, "run_log"), False).drop("lines")


def p4_entries(spark: SparkSession, d: str) -> DataFrame:
    """Log entries with their messages."""
    return loglines.entries(table(spark, d, "run_log"))


def p4_unplaced(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each log file, and how many of them belong to no entry."""
    return loglines.unplaced(table(spark, d, "run_log"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries that are not the ones to keep."""
    return dedup.found(table(spark, d, "chat_events"))


def p5_messages(spark: SparkSession, d: str) -> DataFrame:
    """One delivery of each message, whole."""
    return dedup.deduplicate(table(spark, d, "chat_events"))


def p5_batches(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries and copies of each batch."""
    return dedup.copies_by_batch(table(spark, d, "chat_events"))


QUERIES = {f.__name__: f for f in (p4_found, p4_entries, p4_unplaced, p5_found, p5_messages, p5_batches)}

_IDS = r"""WITH n AS (
  SELECT *, nullif(regexp_replace(message_id, '^\s+|\s+$', '', 'g'), '') AS mid FROM chat_events),
r AS (SELECT *, CASE WHEN mid IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY mid ORDER BY received_at NULLS LAST, delivery_id) END AS k FROM n)
"""
SQL = {
    "p5_found": _IDS + "SELECT delivery_id FROM r WHERE k > 1",
    "p5_messages": _IDS + "SELECT delivery_id, batch_id, received_at, chat_id, message_id, sender_id, chat_type, message_type, content, create_time FROM r WHERE k = 1",
    "p5_batches": _IDS + "SELECT batch_id, count(*) AS deliveries, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS copies FROM r GROUP BY batch_id",
}

# The log layouts again, as SQL: a cascade over cleaned lines, the most frequent layout of a file, entries by a running maximum.
_LV = "(DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL|FATAL)"
_HEAD = {
    1: rf"^\d\d\d\d-\d\d-\d\d \d\d:\d\d:\d\d([.,]\d+)? \| [^|]*? *\| {_LV} *\| ?",
    2: rf"^\d\d\d\d-\d\d-\d\d \d\d:\d\d:\d\d[.,]\d+ - \S+ - {_LV} - ?",
    3: rf"^\d\d\d\d/\d\d/\d\d \d\d:\d\d:\d\d(\.\d+)? {_LV} \[[^\]]+\] ?",
    4: rf"^\[\d+(\.\d+)?\] {_LV} \S+ -- ?",
    5: r"^\[\d\d\d\d-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z?\] \[[^/\]]+/[A-Za-z]+\] ?",
    6: r"^(time|level)=\S+ (time|level)=\S+ component=",
    7: r"^[DIWEF]\d\d\d\d \d\d:\d\d:\d\d\.\d+ +\d+ [^:\s]+:\d+\] ?",
    8: r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ \d]\d \d\d:\d\d:\d\d \S+ [^\s\[:]+(\[\d+\])?: ?",
    9: rf"^{_LV}:[A-Za-z_][\w.\-]*:",
    10: r'^\{("(timestamp|severity|logger)": ?.*)?$',
}
_CASE = " ".join(f"WHEN regexp_matches(line, '{p}') THEN {i}" for i, p in _HEAD.items())
_EPOCH = "strftime(make_timestamp(CAST(floor(CAST({} AS DOUBLE)) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S')"
_ENTRIES = rf"""WITH l AS (
  SELECT DISTINCT run_id, source, byte_offset, regexp_replace(coalesce(text, ''), '\x1b\[[0-9;?]*[A-Za-z]|\r', '', 'g') AS line FROM run_log WHERE byte_offset IS NOT NULL),
h AS (SELECT *, CASE {_CASE} END AS hit FROM l),
c AS (SELECT run_id, source, hit, count(*) AS n, min(byte_offset) AS b FROM h WHERE hit IS NOT NULL GROUP BY ALL),
s AS (SELECT *, n * CASE WHEN b = min(b) OVER (PARTITION BY run_id, source) THEN 1.6 ELSE 1 END AS score FROM c),
f AS (SELECT run_id, source, hit AS layout FROM s QUALIFY row_number() OVER (PARTITION BY run_id, source ORDER BY score DESC, b) = 1),
m AS (SELECT h.*, layout, lead(regexp_matches(line, '^\s+"(timestamp|severity|logger|message|pid)":')) OVER (PARTITION BY h.run_id, h.source ORDER BY byte_offset) AS nb FROM h JOIN f USING (run_id, source)),
o AS (SELECT *, hit IS NOT NULL AND hit = layout AND (hit <> 10 OR regexp_matches(line, '"timestamp": ?[0-9]') OR coalesce(nb, true)) AS opens FROM m),
e AS (SELECT *, max(CASE WHEN opens THEN byte_offset END) OVER (PARTITION BY run_id, source ORDER BY byte_offset ROWS UNBOUNDED PRECEDING) AS entry FROM o)"""
_FIELDS = rf""", p AS (SELECT *,
  CASE WHEN layout = 10 THEN nullif(regexp_extract(line, '"timestamp": ?([0-9]+(\.[0-9]+)?)', 1), '')
       WHEN NOT opens THEN NULL
       WHEN layout = 6 THEN regexp_extract(line, '(^| )time=(\S+)', 2)
       WHEN layout = 4 THEN regexp_extract(line, '^\[(\d+(\.\d+)?)\]', 1)
       WHEN layout = 5 THEN regexp_extract(line, '^\[(.{{19}})', 1)
       WHEN layout = 7 THEN substr(line, 2, 13) WHEN layout = 8 THEN substr(line, 1, 15) WHEN layout = 9 THEN '' ELSE substr(line, 1, 19) END AS raw,
  CASE WHEN layout = 10 THEN nullif(regexp_extract(line, '"severity": ?"([A-Za-z]+)"', 1), '')
       WHEN NOT opens THEN NULL
       WHEN layout = 6 THEN regexp_extract(line, '(^| )level=(\S+)', 2)
       WHEN layout = 7 THEN substr(line, 1, 1) WHEN layout = 8 THEN ''
       WHEN layout = 5 THEN regexp_extract(line, '^\[[^\]]*\] \[[^/\]]+/([A-Za-z]+)\]', 1)
       WHEN layout = 1 THEN regexp_extract(line, '\| {_LV} *\|', 1) WHEN layout = 2 THEN regexp_extract(line, ' - {_LV} - ?', 1)
       WHEN layout = 9 THEN regexp_extract(line, '^([A-Z]+):', 1) ELSE regexp_extract(line, ' {_LV} ', 1) END AS sev,
  CASE WHEN layout = 10 THEN nullif(regexp_extract(line, '"logger": ?"([^"]*)"', 1), '')
       WHEN NOT opens THEN NULL
       WHEN layout = 6 THEN regexp_extract(line, ' component=(\S+)', 1)
       WHEN layout = 7 THEN regexp_extract(line, '^\S+ \S+ +\d+ ([^:\s]+):', 1)
       WHEN layout = 8 THEN regexp_extract(line, '^.{{15}} \S+ ([^\s\[:]+)', 1)
       WHEN layout = 9 THEN regexp_extract(line, '^[A-Z]+:([^:]*):', 1)
       WHEN layout = 5 THEN regexp_extract(line, '^\[[^\]]*\] \[([^/\]]+)/', 1)
       WHEN layout = 4 THEN regexp_extract(line, '^\S+ \S+ (\S+)', 1)
       WHEN layout = 3 THEN regexp_extract(line, '\[([^\]]+)\]', 1)
       WHEN layout = 2 THEN regexp_extract(line, '^\S+ \S+ - (\S+) - ', 1)
       ELSE regexp_extract(line, '^[^|]*\| ([^|]*?) *\|', 1) END AS comp
  FROM e WHERE entry IS NOT NULL),
g AS (SELECT run_id, source, entry, any_value(layout) AS layout, max(byte_offset) AS last_offset,
  coalesce(arg_min(raw, byte_offset) FILTER (WHERE raw IS NOT NULL), '') AS raw, upper(coalesce(arg_min(sev, byte_offset) FILTER (WHERE sev IS NOT NULL), '')) AS sev,
  coalesce(arg_min(comp, byte_offset) FILTER (WHERE comp IS NOT NULL), '') AS comp@MORE FROM p GROUP BY run_id, source, entry)
SELECT run_id, source, entry AS first_offset, last_offset,
  CASE WHEN raw = '' THEN '' WHEN layout IN (4, 10) THEN {_EPOCH.format("raw")}
       WHEN layout = 6 THEN strftime(CAST(substr(raw, 1, 19) AS TIMESTAMP) - CASE WHEN raw LIKE '%Z' THEN INTERVAL 0 MINUTE
         ELSE to_minutes(CAST((CASE WHEN substr(raw, 20, 1) = '-' THEN -1 ELSE 1 END) * (CAST(substr(raw, 21, 2) AS INT) * 60 + CAST(right(raw, 2) AS INT)) AS BIGINT)) END, '%Y-%m-%d %H:%M:%S')
       WHEN layout = 7 THEN '2026-' || substr(raw, 1, 2) || '-' || substr(raw, 3, 2) || substr(raw, 5)
       WHEN layout = 8 THEN '2026-' || lpad(CAST((instr('JanFebMarAprMayJunJulAugSepOctNovDec', substr(raw, 1, 3)) + 2) // 3 AS VARCHAR), 2, '0') || '-' || lpad(trim(substr(raw, 5, 2)), 2, '0') || substr(raw, 7)
       WHEN layout = 3 THEN replace(raw, '/', '-') ELSE replace(raw, 'T', ' ') END AS ts_utc,
  CASE sev WHEN 'WARN' THEN 'WARNING' WHEN 'W' THEN 'WARNING' WHEN 'FATAL' THEN 'CRITICAL' WHEN 'F' THEN 'CRITICAL' WHEN 'D' THEN 'DEBUG' WHEN 'I' THEN 'INFO' WHEN 'E' THEN 'ERROR' ELSE sev END AS severity, comp AS component@MORE_OUT
FROM g"""
_MESSAGE = rf"""CASE WHEN NOT opens THEN line WHEN layout = 10 THEN regexp_extract(line, '"message": ?"((?:[^"\\]|\\.)*)"', 1) WHEN layout = 6 THEN regexp_extract(line, ' msg="((?:[^"\\]|\\.)*)"', 1)
  {" ".join(f"WHEN layout = {i} THEN regexp_replace(line, '{p}', '')" for i, p in _HEAD.items() if i not in (6, 10))} END"""
SQL["p4_found"] = _ENTRIES + _FIELDS.replace("@MORE_OUT", "").replace("@MORE", "")
SQL["p4_entries"] = _ENTRIES + _FIELDS.replace("@MORE_OUT", ", lines, message").replace("@MORE", f", count(*) AS lines, string_agg({_MESSAGE}, chr(10) ORDER BY byte_offset) AS message")
SQL["p4_unplaced"] = _ENTRIES + "SELECT run_id, source, count(*) AS lines, count(*) FILTER (WHERE entry IS NULL) AS unplaced FROM e GROUP BY run_id, source"
