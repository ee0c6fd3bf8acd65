"""Semi-structured log lines into entries with timestamp, severity, component and message.

Every line is held against an ordered cascade of header expressions before any shuffle; a file's layout is the one most
of its headers follow; lines that follow it open an entry and all others continue the entry before them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.session import checkpoint

_LEVEL = "DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL|FATAL"


@dataclass(frozen=True)
class Layout:
    """A header expression with the groups of its fields (0: the layout has no such field) and how its time is written."""

    name: str
    header: str
    time: int
    severity: int
    component: int
    clock: str  # plain | slash | epoch | offset | month | mmdd | none


# Layouts in the order in which they are tried. Every header ends where the message begins.
LAYOUTS = (
    Layout("pipe", rf"^(\d{{4}}-\d\d-\d\d \d\d:\d\d:\d\d)(?:[.,]\d+)? \| ([^|]*?) *\| ({_LEVEL}) *\| ?", 1, 3, 2, "plain"),
    Layout("dash", rf"^(\d{{4}}-\d\d-\d\d \d\d:\d\d:\d\d)[.,]\d+ - (\S+) - ({_LEVEL}) - ?", 1, 3, 2, "plain"),
    Layout("slash", rf"^(\d{{4}}/\d\d/\d\d \d\d:\d\d:\d\d)(?:\.\d+)? ({_LEVEL}) \[([^\]]+)\] ?", 1, 2, 3, "slash"),
    Layout("epoch", rf"^\[(\d{{9,11}}(?:\.\d+)?)\] ({_LEVEL}) (\S+) -- ?", 1, 2, 3, "epoch"),
    Layout("bracket", r"^\[(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.\d+)?Z?\] \[([^/\]]+)/([A-Za-z]+)\] ?", 1, 3, 2, "plain"),
    Layout("pairs", r"^(?:time|level)=\S+ (?:time|level)=\S+ component=", 0, 0, 0, "offset"),
    Layout("glog", r"^([DIWEF])(\d{4} \d\d:\d\d:\d\d)\.\d+ +\d+ ([^:\s]+):\d+\] ?", 2, 1, 3, "mmdd"),
    Layout("syslog", r"^((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ \d]\d \d\d:\d\d:\d\d) \S+ ([^\s\[:]+)(?:\[\d+\])?: ?", 1, 0, 2, "month"),
    Layout("named", rf"^({_LEVEL}):([A-Za-z_][\w.\-]*):", 0, 1, 2, "none"),
    Layout("json", r'^\{(?:"(?:timestamp|severity|logger)": ?.*)?$', 0, 0, 0, "epoch"),
    # any other line that begins with a full time, with or without a level behind it; only files without a header of those above have it
    Layout("other", rf"^[\[(]?(\d{{4}}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?)[\])]?[ :|,-]*(?:\[?({_LEVEL})\b\]?[ :|,-]*)?", 1, 2, 0, "offset"),
)
JSON, PAIRS, OTHER = (next(i for i, x in enumerate(LAYOUTS, 1) if x.name == n) for n in ("json", "pairs", "other"))
#: Bytes of a file that one task orders at a time.
BLOCK = 1 << 22
#: The layout of a file's first header counts this much more: quoted output stands inside entries.
FIRST_BONUS = 1.6
YEAR = 2026


def clean(text: Column) -> Column:
    """A line without colour codes and carriage returns."""
    return F.regexp_replace(text, "\u001b\\[[0-9;?]*[A-Za-z]|\r", "")


def _seconds_to_text(s: Column) -> Column:
    """Seconds since 1970 as UTC text, whatever the session's time zone."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    rest = F.pmod(s, F.lit(86400))
    day = F.date_from_unix_date(F.floor(s / 86400).cast("int"))
    return F.concat(day.cast("string"), F.lit(" "), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(F.pmod(rest, F.lit(3600)) / 60)), F.lit(":"), two(F.pmod(rest, F.lit(60))))


def _offset_to_text(t: Column) -> Column:
    """An ISO time with Z or an offset as UTC text."""
    part = lambda a, n: F.substring(t, a, n).cast("int")
    zone = F.regexp_extract(t, r"([+-]\d\d):?(\d\d)$", 1)
    minutes = F.when(zone == "", 0).otherwise(F.when(zone.startswith("-"), -1).otherwise(1) * (F.abs(zone.cast("int")) * 60 + F.regexp_extract(t, r"([+-]\d\d):?(\d\d)$", 2).cast("int")))
    s = F.unix_date(F.substring(t, 1, 10).cast("date")).cast("long") * 86400 + part(12, 2) * 3600 + part(15, 2) * 60 + part(18, 2) - minutes * 60
    return _seconds_to_text(s)


def _clock(raw: Column, kind: str) -> Column:
    if kind == "plain":
        return F.replace(raw, F.lit("T"), F.lit(" "))
    if kind == "slash":
        return F.replace(raw, F.lit("/"), F.lit("-"))
    if kind == "epoch":
        return _seconds_to_text(F.floor(raw.cast("double")).cast("long"))
    if kind == "offset":
        return _offset_to_text(F.replace(raw, F.lit("/"), F.lit("-")))
    if kind == "month":
        month = F.floor((F.position(F.substring(raw, 1, 3), F.lit("JanFebMarAprMayJunJulAugSepOctNovDec")) + 2) / 3)
        return F.concat(F.lit(f"{YEAR}-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(F.trim(F.substring(raw, 5, 2)), 2, "0"), F.substring(raw, 7, 9))
    if kind == "mmdd":
        return F.concat(F.lit(f"{YEAR}-"), F.substring(raw, 1, 2), F.lit("-"), F.substring(raw, 3, 2), F.substring(raw, 5, 9))
    return F.lit("")


def _severity(raw: Column) -> Column:
    up = F.upper(raw)
    return F.when(up.isin("WARN", "W"), "WARNING").when(up.isin("FATAL", "F"), "CRITICAL").when(up == "D", "DEBUG").when(up == "I", "INFO").when(up == "E", "ERROR").otherwise(up)


def _field(layout: Column, line: Column) -> tuple[Column, Column, Column, Column]:
    """(ts_utc, severity, component, message) of a header line by its layout."""
    ts = severity = component = message = None
    for i, x in enumerate(LAYOUTS, 1):
        is_it = layout == i
        if i == JSON:
            stamp, level, name, text = (F.regexp_extract(line, p, 1) for p in (r'"timestamp": ?([0-9]+(?:\.[0-9]+)?)', r'"severity": ?"([A-Za-z]+)"', r'"logger": ?"([^"]*)"', r'"message": ?"((?:[^"\\]|\\.)*)"'))
        elif i == PAIRS:
            stamp, level, name, text = (F.regexp_extract(line, p, 1) for p in (r"(?:^| )time=(\S+)", r"(?:^| )level=(\S+)", r" component=(\S+)", r' msg="((?:[^"\\]|\\.)*)"'))
        else:
            stamp, level, name = (F.regexp_extract(line, x.header, g) if g else F.lit("") for g in (x.time, x.severity, x.component))
            text = F.regexp_replace(line, x.header, "")
        stamp = F.when(stamp != "", _clock(stamp, x.clock)).otherwise("")
        add = lambda so_far, v: F.when(is_it, v) if so_far is None else so_far.when(is_it, v)
        ts, severity, component, message = add(ts, stamp), add(severity, _severity(level)), add(component, name), add(message, text)
    return ts, severity, component, message


def _layout(line: Column) -> Column:
    out = None
    for i, x in enumerate(LAYOUTS, 1):
        hit = line.rlike(x.header)
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


_FILE = ["run_id", "source"]


def assign(run_log: DataFrame, keep_text: bool = False) -> DataFrame:
    """Every line with the entry it belongs to: run_id, source, byte_offset, entry_offset (null before a file's first entry), layout, ts_utc, severity, component and, if asked for, line and message.

    Copies of a line (equal file and byte_offset) count once, of unequal ones the first by text; null text reads as an empty line; null byte_offset
    has no place in a file and is left out; null run_id or source are files of their own. Fields are empty where a layout
    or line has none, null on continuation lines. An empty table gives an empty result.

    A file that has no line in any of the layouts is held against a general one, any line that begins with a full time; where
    it has none of these either, it has no entry, and ``unplaced`` counts its lines.

    Files are ordered in blocks of BLOCK bytes, so one file of any size spreads over many tasks. A block learns the
    file's layout and the entry it begins in from one summary row per block.
    """
    line = clean(F.coalesce(F.col("text"), F.lit("")))
    cell = [*_FILE, "block"]
    lines = run_log.where("byte_offset is not null").select(*_FILE, F.col("byte_offset").cast("long").alias("byte_offset"), F.expr(f"cast(byte_offset div {BLOCK} as long)").alias("block"), line.alias("line"))
    lines = lines.withColumn("hit", _layout(F.col("line")))
    body = F.col("line").rlike(r'^\s+"(?:timestamp|severity|logger|message|pid)":')
    ts, severity, component, message = _field(F.col("hit"), F.col("line"))
    parsed = lines.select(*cell, "byte_offset", "hit", ts.alias("ts"), severity.alias("sev"), component.alias("comp"), body.alias("body"), F.when(body, F.col("line")).otherwise("").alias("json_line"), *([F.col("line"), message.alias("message")] if keep_text else []))
    # every line is read once; copies go before the shuffle
    once = checkpoint(parsed.distinct())

    # layout and carry: one row per block of a file
    heads = once.where("hit is not null").groupBy(*_FILE, "block", "hit").agg(F.count("*").alias("n"), F.min("byte_offset").alias("first"), F.max("byte_offset").alias("last"))
    whole = W.partitionBy(*_FILE, "hit")
    by_file = W.partitionBy(*_FILE)
    heads = heads.withColumn("total", F.sum("n").over(whole)).withColumn("begins", F.min("first").over(whole)).withColumn("opens", F.min("first").over(by_file))
    opens_file = F.when(F.col("begins") == F.col("opens"), FIRST_BONUS).otherwise(1.0)
    heads = heads.withColumn("score", F.when(F.col("hit") == OTHER, 0.0).otherwise(F.col("total") * opens_file))
    best = F.max_by("hit", F.struct("score", -F.col("begins"))).over(by_file)
    chosen = heads.withColumn("layout", best).where("hit = layout").select(*_FILE, "layout", "block", "last")
    blocks = once.select(*_FILE, "block").distinct()
    key = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in _FILE]
    on = key("b", "c") + [F.col("b.block") == F.col("c.block")]
    state = blocks.alias("b").join(chosen.alias("c"), on, "left").select("b.run_id", "b.source", "b.block", "c.layout", "c.last")
    so_far = W.partitionBy(*_FILE).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    state = state.withColumn("layout", F.max("layout").over(by_file)).withColumn("carry", F.last("last", ignorenulls=True).over(so_far))

    on = key("p", "s") + [F.col("p.block") == F.col("s.block")]
    placed = once.alias("p").join(state.alias("s"), on, "left").select("p.*", "s.layout", "s.carry")
    within = W.partitionBy(*cell).orderBy("byte_offset", *(["line"] if keep_text else ["hit", "ts", "sev", "comp", "json_line"]))
    placed = placed.withColumn("again", F.coalesce(F.lag("byte_offset").over(within) == F.col("byte_offset"), F.lit(False))).where("not again").drop("again")
    opens = (F.col("hit") == F.col("layout")) & ((F.col("hit") != JSON) | (F.col("ts") != "") | F.coalesce(F.lead("body").over(within), F.lit(True)))
    placed = placed.withColumn("entry", F.when(opens, F.col("byte_offset")))
    placed = placed.withColumn("entry_offset", F.coalesce(F.last("entry", ignorenulls=True).over(within), "carry"))
    # fields of an object printed over several lines stand on its continuation lines
    spread = (F.col("layout") == JSON) & F.col("entry").isNull()
    jts, jsev, jcomp, _ = _field(F.lit(JSON), F.col("json_line"))
    own = lambda a, b: F.when(F.col("entry").isNotNull(), F.nullif(F.col(a), F.lit(""))).when(spread, F.nullif(b, F.lit("")))
    return placed.select(*_FILE, "byte_offset", "entry_offset", "layout", own("ts", jts).alias("ts_utc"), own("sev", jsev).alias("severity"), own("comp", jcomp).alias("component"), *([F.col("line"), F.when(F.col("entry").isNotNull(), F.col("message")).otherwise(F.col("line")).alias("message")] if keep_text else []))


def entries(run_log: DataFrame, with_message: bool = True) -> DataFrame:
    """One row per log entry: run_id, source, first_offset, last_offset, ts_utc, severity, component, lines and, if asked for, message with the continuation lines.

    Cases are those of ``assign``. A message holds all lines of its entry, so it is as long as they are.
    """
    a = assign(run_log, with_message).where("entry_offset is not null")
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("byte_offset"))), F.lit("")).alias(c)
    text = [F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("byte_offset", "message"))), lambda x: x["message"])).alias("message")] if with_message else []
    out = a.groupBy(*_FILE, "entry_offset").agg(F.max("byte_offset").alias("last_offset"), first("ts_utc"), first("severity"), first("component"), F.count("*").alias("lines"), *text)
    return out.select(*_FILE, F.col("entry_offset").alias("first_offset"), "last_offset", "ts_utc", "severity", "component", "lines", *(["message"] if with_message else []))


def unplaced(run_log: DataFrame) -> DataFrame:
    """(run_id, source, lines, unplaced) of each file: its lines, and those of them that belong to no entry."""
    return assign(run_log).groupBy(*_FILE).agg(F.count("*").alias("lines"), F.count_if(F.col("entry_offset").isNull()).alias("unplaced"))
