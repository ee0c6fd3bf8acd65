"""Files as tables: JSON arrays or lines, task folders, growing logs, event lines; and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.shipping import by_value
from runloom.sources import run_kernel

by_value(run_kernel)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or JSON lines, told apart by the first character that is not blank; rows that don't parse are left out."""
    first = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.trim("value"), 1, 1)).first()
    multi = bool(first) and first[0] == "["
    return spark.read.schema(schema).option("multiLine", multi).option("mode", "DROPMALFORMED").json(path)


def event_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """One event per line of JSON; blank, broken and non-object lines are skipped. Works on streams."""
    good = F.trim(column).startswith("{")
    e = lines.where(good).select(F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("e"), F.try_parse_json(column).alias("v"))
    return e.where("v is not null").select("e.*")


def task_folders(spark: SparkSession, root: str, marker: str = "task.toml") -> DataFrame:
    """(task, path, content) of all files below folders that hold the marker file."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    return tasks(f.select(rel.alias("path"), "content"), marker)


def tasks(files: DataFrame, marker: str = "task.toml", skip: tuple[str, ...] = (), expected: int | None = None) -> DataFrame:
    """(task, path, content) of files (path below the root, content) in folders that hold the marker file, by task; tasks to skip are left
    out after it has been checked that there are as many as ``expected``."""
    f = files.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("task"), F.substring_index("path", "/", -1).alias("_file"), "path", "content")
    marked = f.where((F.col("_file") == marker) & F.col("path").contains("/")).select("task").distinct()
    if expected is not None and (n := marked.count()) != expected:
        raise ValueError(f"{n} tasks where {expected} are expected")
    wanted = marked.where(~F.col("task").isin(list(skip))) if skip else marked
    return f.join(wanted, "task", "left_semi").drop("_file").orderBy("task", "path")


def corpus(lines: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """(id, url, text) of a corpus whose rows bring their own numbers: lines of files have no number that stays. A missing or repeated id is an error."""
    c = lines.select(F.col(id_col).cast("long").alias("id"), F.nullif(url_col, F.lit("")).alias("url"), F.col(text_col).alias("text"))
    bad = c.groupBy("id").count().where(F.col("id").isNull() | (F.col("count") > 1)).limit(1).count()
    if bad:
        raise ValueError("every line of a corpus needs an id of its own")
    return c


def shards(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(id text, v) of embedding shards (id, embedding); a file that cannot be read is skipped, and a folder without any is empty."""
    rows = spark.read.schema(f"id {id_type}, embedding array<float>").option("ignoreCorruptFiles", True).parquet(path)
    return rows.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("v"))


#: An entry of an Atom feed, as far as it is read.
ENTRY = "title string, id string, summary string, published string, updated string, author array<struct<name:string>>, link array<struct<_title:string,_href:string>>"


def feed_entries(entries: DataFrame, column: str, most_summary: int = 1000) -> DataFrame:
    """(title, summary, published, updated, authors, abs_url, pdf_url) of ``<entry>`` texts; those without title or id are dropped."""
    flat = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    e = entries.select(F.from_xml(column, ENTRY).alias("e"), *[c for c in entries.columns if c != column])
    names = F.filter(F.transform("e.author", lambda a: flat(a["name"])), lambda n: n != "")
    pdf = F.get(F.filter("e.link", lambda x: x["_title"] == "pdf"), F.lit(0))["_href"]
    rest = [c for c in entries.columns if c != column]
    out = e.select(
        *rest, flat(F.col("e.title")).alias("title"), F.left(flat(F.col("e.summary")), F.lit(most_summary)).alias("summary"), flat(F.col("e.published")).alias("published"), flat(F.col("e.updated")).alias("updated"),
        F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit("(unknown authors)")).alias("authors"), flat(F.col("e.id")).alias("abs_url"), F.coalesce(F.nullif(pdf, F.lit("")), F.lit("(no pdf url)")).alias("pdf_url"),
    )
    return out.where("title <> '' and abs_url <> ''")


def front_matter(content: Column, folder: Column) -> Column:
    """struct(name, description, body) of a skill file: fields of its head between --- lines, without quotes around them; the folder's name for a
    missing one. A file without a whole head is all body."""
    head = F.regexp_extract(content, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    field = lambda n: F.nullif(F.regexp_replace(F.trim(F.regexp_extract(head, rf"(?m)^{n}:[ \t]*(.*)$", 1)), r"""^["'](.*)["']$""", "$1"), F.lit(""))
    body = F.when(head == "", content).otherwise(F.regexp_replace(content, r"(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", ""))
    return F.struct(F.coalesce(field("name"), folder).alias("name"), F.coalesce(field("description"), F.lit("")).alias("description"), body.alias("body"))


def transcript(content: Column) -> Column:
    """The messages, as JSON each, of a file that holds a JSON list; none of a missing file or any other."""
    v = F.try_parse_json(content)
    listed = F.when(F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False)), F.try_variant_get(v, "$", "array<variant>"))
    return F.coalesce(F.transform(listed, lambda m: F.to_json(m)), F.array().cast("array<string>"))


def decode(content: Column) -> Column:
    """Bytes as text: UTF-8 where valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("compression", "gzip").json(path)


def segment_grids(segments: DataFrame, key: str = "run_id") -> DataFrame:
    """What is stored of the segments of runs that have more than one: four fields, copies once."""
    s = segments.select(key, "segment_index", "prompt_ids", "response_ids", "response_mask", "turn_spans").dropDuplicates([key, "segment_index"])
    several = s.groupBy(key).count().where("count > 1").select(key)
    return s.join(several, key, "left_semi")


def write_index(vectors: DataFrame, path: str) -> None:
    """Vectors (id, v, cell) with their ids, a folder a cell, so that no row is known by its place."""
    vectors.write.mode("overwrite").partitionBy("cell").parquet(path)


def _root(spark: SparkSession, path: str) -> tuple:
    """The Hadoop path and its whole URI."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs, root, fs.makeQualified(root).toUri().toString()


#: Which runs were written, to which files: read in place of a listing of all folders. Readers of the files skip it.
_WRITTEN = "_runs"


def write_runs(lines: DataFrame, path: str, levels: list[str]) -> None:
    """Log lines (run_id, severity, ...) of the given severities as JSON, a folder a run, named as ``partitionBy`` does. A run's lines are in one
    file, unless they are many or lie on a border between tasks."""
    spark = lines.sparkSession
    fs, root, uri = _root(spark, path)
    fs.delete(root, True)
    kept = lines.where(F.col("severity").isin(levels)).select(F.col("run_id").cast("string").alias("run_id"), F.to_json(F.struct(*[c for c in lines.columns if c != "run_id"])).alias("line"))
    placed = kept.repartitionByRange("run_id", F.xxhash64("line")).sortWithinPartitions("run_id")
    placed.mapInArrow(run_kernel.writer(uri), "run_id string, file string, rows long").write.parquet(f"{path.rstrip('/')}/{_WRITTEN}")


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_runs`` wrote: run_id and the columns of ``schema``."""
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    written = spark.read.schema("run_id string, file string, rows long").parquet(f"{path.rstrip('/')}/{_WRITTEN}").repartition(tasks, "file")
    rows = written.mapInArrow(run_kernel.reader(_root(spark, path)[2]), "run_id string, line string")
    return rows.select("run_id", F.from_json("line", schema).alias("e")).select("run_id", "e.*")


def archive(files: Column) -> Column:
    """A tar archive of files, an array of struct(path, content); equal files give equal bytes, whatever their order."""
    from runloom.functions.udf import tar_bytes

    return tar_bytes(files)
