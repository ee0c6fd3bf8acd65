"""Log layouts, continuation lines, quoted output, objects over several lines."""

from runloom.operators import loglines

FILES = {
    "a.log": ["  a rest", "2026-03-22 01:04:26,926 - rex.upload - \x1b[32mINFO\x1b[0m - one\r", "more", "", "2026-03-22 01:04:27,000 - rex.shell - ERROR - two", "Observation:", "[1772455018.133] INFO listener -- quoted"],
    "b.log": ["I0507 19:59:28.804030    9936 drain.cc:465] x", "F0507 19:59:29.000001    9936 drain.cc:1] y"],
    "c.log": ['{"timestamp": 1772043802.826612, "severity": "warn", "logger": "scan", "message": "m"}', "{", '  "logger": "sse",', '  "severity": "DEBUG",', '  "message": "x",', '  "timestamp": 1773656497.880737', "}"],
    "d.log": ["time=2026-03-13T01:38:29-05:00 level=info component=url_index took=1ms msg=\"a\"", "level=fatal time=2026-03-13T08:38:31+02:00 component=ivf msg=\"b\""],
    "e.log": ["Mar  8 15:12:59 box-36 conmon[3974]: There", "INFO:eval.apply:no"],
    "f.log": ["INFO:eval.harness:ok", "tail"],
    "g.log": ["[2026-02-18T07:18:10.096Z] [gateway.manager/warn] hello"],
    "h.log": ["2026/04/08 07:58:26.945 FATAL [tools_mgr] x"],
    "i.log": ["2026-04-16 12:41:54 | condenser    | WARNING  | x", "2026-04-17 nightly of sore: no header"],
    "j.log": ["no header at all"],
    "k.log": ["[1772455018.133] INFO listener -- x"],
}
WANT = {
    ("a.log", 1, 3, "2026-03-22 01:04:26", "INFO", "rex.upload"),
    ("a.log", 4, 6, "2026-03-22 01:04:27", "ERROR", "rex.shell"),
    ("b.log", 0, 0, "2026-05-07 19:59:28", "INFO", "drain.cc"),
    ("b.log", 1, 1, "2026-05-07 19:59:29", "CRITICAL", "drain.cc"),
    ("c.log", 0, 0, "2026-02-25 18:23:22", "WARNING", "scan"),
    ("c.log", 1, 6, "2026-03-16 10:21:37", "DEBUG", "sse"),
    ("d.log", 0, 0, "2026-03-13 06:38:29", "INFO", "url_index"),
    ("d.log", 1, 1, "2026-03-13 06:38:31", "CRITICAL", "ivf"),
    ("e.log", 0, 1, "2026-03-08 15:12:59", "", "conmon"),
    ("f.log", 0, 1, "", "INFO", "eval.harness"),
    ("g.log", 0, 0, "2026-02-18 07:18:10", "WARNING", "gateway.manager"),
    ("h.log", 0, 0, "2026-04-08 07:58:26", "CRITICAL", "tools_mgr"),
    ("i.log", 0, 1, "2026-04-16 12:41:54", "WARNING", "condenser"),
    ("k.log", 0, 0, "2026-03-02 12:36:58", "INFO", "listener"),
}


def frame(spark, scale=1):
    rows = [("r", f, i * scale, t) for f, lines in FILES.items() for i, t in enumerate(lines)]
    return spark.createDataFrame(rows + rows[:4], "run_id string, source string, byte_offset long, text string")


def test_layouts(spark):
    got = {tuple(r)[1:7] for r in loglines.entries(frame(spark), False).drop("lines").collect()}
    assert got == WANT


def test_blocks_do_not_matter(spark):
    """With every line in a block of its own the entries are the same."""
    s = loglines.BLOCK
    got = {(r[1], r[2] // s, r[3] // s, r[4], r[5], r[6]) for r in loglines.entries(frame(spark, s), False).collect()}
    assert got == WANT


def test_messages(spark):
    m = {(r["source"], r["first_offset"]): r["message"] for r in loglines.entries(frame(spark)).collect()}
    assert m["a.log", 1] == "one\nmore\n"
    assert m["e.log", 0] == "There\nINFO:eval.apply:no"


def test_a_file_in_no_layout_is_held_against_times_and_else_counted(spark):
    lines = {
        "x.log": ["boot", "2026/03/04 05:06:07.5Z worker: starts", "  more", "[2026-03-04T05:06:09+02:00] ERROR lost"],
        "y.log": ["no header", "none at all"],
        "z.log": ["2026-03-04 05:06:07 quoted before", "INFO:eval.apply:yes"],
    }
    df = spark.createDataFrame([("r", f, i, t) for f, some in lines.items() for i, t in enumerate(some)], "run_id string, source string, byte_offset long, text string")
    got = {tuple(r)[1:7] for r in loglines.entries(df, False).drop("lines").collect()}
    assert got == {("x.log", 1, 2, "2026-03-04 05:06:07", "", ""), ("x.log", 3, 3, "2026-03-04 03:06:09", "ERROR", ""), ("z.log", 1, 1, "", "INFO", "eval.apply")}
    assert {tuple(r)[1:] for r in loglines.unplaced(df).collect()} == {("x.log", 4, 1), ("y.log", 2, 2), ("z.log", 2, 1)}
