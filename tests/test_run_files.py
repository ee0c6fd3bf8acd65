"""Files of runs: what is read back, how many files there are, what is missed."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from runloom.plans import source_queries
from runloom.sources import files

RUNS = [None, "", "a=b/c", "x%3Dy", "..", "größer", "q'\"[x]", "plain"]
SCHEMA = "severity string, n long, text string"


def found(df):
    return sorted((str(r["run_id"]), r["severity"], r["n"], r["text"]) for r in df.collect())


def test_run_files_read_back(spark, tmp_path):
    rows = [(r, s, i, t) for i, r in enumerate(RUNS) for s, t in (("error", "one\ntwo {\"x\": 1}"), ("click", None), ("view", "not kept"), (None, "nor this"))]
    lines = spark.createDataFrame(rows, "run_id string, severity string, n long, text string")
    path = f"{tmp_path}/runs of a day"
    files.write_runs(lines.where("n = 0").withColumn("run_id", F.lit("gone")), path, ["error"])
    files.write_runs(lines, path, ["error", "click"])
    want = sorted((str(r), s, n, t) for r, s, n, t in rows if s in ("error", "click"))
    assert found(files.read_runs(spark, path, SCHEMA)) == want
    # as any reader of partitions by run_id sees it, to whom an empty id is none
    assert found(spark.read.schema(f"{SCHEMA}, run_id string").json(path)) == sorted((r or "None", *x) for r, *x in want)
    assert found(spark.read.schema(f"{SCHEMA}, run_id string").json(path).where("run_id = 'a=b/c'")) == [x for x in want if x[0] == "a=b/c"]


def test_run_files_are_few(spark, tmp_path):
    lines = spark.range(20_000).repartition(40).select((F.col("id") % 50).alias("run_id"), F.lit("error").alias("severity"), F.col("id").alias("n"))
    files.write_runs(lines, str(tmp_path / "runs"), ["error"])
    names = list(Path(tmp_path / "runs").glob("run_id=*/*.json"))
    assert len({p.parent for p in names}) == 50 and len(names) <= 60
    assert not [p for p in Path(tmp_path / "runs").glob("run_id=*/*") if p not in names and not p.name.endswith(".crc")]
    names[0].unlink()
    with pytest.raises(Exception, match="run_id="):
        files.read_runs(spark, str(tmp_path / "runs"), "severity string, n long").collect()


def test_run_files_of_a_run_with_most_lines(spark, tmp_path):
    """A run with nearly all lines is written by several tasks, in files that are each there once, and longer than what is held at once."""
    lines = spark.range(60_000).select(F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(-1).cast("string").alias("run_id"), F.lit("error").alias("severity"), F.col("id").alias("n"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 8).alias("text"))
    files.write_runs(lines, str(tmp_path / "runs"), ["error"])
    assert len(list(Path(tmp_path / "runs/run_id=-1").glob("*.json"))) > 1
    got = files.read_runs(spark, str(tmp_path / "runs"), SCHEMA)
    assert got.exceptAll(lines.select("run_id", "severity", "n", "text")).count() == 0 and got.count() == 60_000


def test_run_files_query(spark, tmp_path):
    e = spark.range(3000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 500).alias("user_id"), F.element_at(F.array(*map(F.lit, ["error", "click", "view"])), (F.col("id") % 3 + 1).cast("int")).alias("event_type"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r["run_id"], r["event_id"]) for r in source_queries.run_files(spark, str(tmp_path)).collect())
    assert got == sorted((str(i % 500), i) for i in range(3000) if i % 7 > 0 and i % 3 < 2)
    e.where("event_id < 0").write.mode("overwrite").parquet(f"{tmp_path}/none/events.parquet")
    assert source_queries.run_files(spark, f"{tmp_path}/none").count() == 0
