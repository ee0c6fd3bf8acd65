"""Queries of sources and sinks; what is written goes below the shared folder and is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.functions import udf
from runloom.operators import monitor, retrieval
from runloom.plans.agent_queries import vectors
from runloom.plans.registering import collection
from runloom.session import scratch
from runloom.sources import files
from runloom.sources.tables import table

QUERIES, SQL, query = collection()


@query("SELECT doc_id, lang, n_chars FROM documents")
def json_lines(spark, d):
    """Documents written as compressed JSON lines and read back."""
    path = scratch(spark, "json-lines")
    files.write_json(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), path)
    return files.json_rows(spark, path, "doc_id long, lang string, n_chars long")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr') UNION ALL SELECT doc_id, 'xx' FROM documents WHERE lang = 'es'")
def partitions_replaced(spark, d):
    """Partitions by language, of which one is written anew and the others stay."""
    path, x = scratch(spark, "by-lang"), table(spark, d, "documents").select("doc_id", "lang").where("lang in ('de', 'fr', 'es')")
    files.write_partitions(x.withColumn("what", F.col("lang")), path, "lang")
    files.write_partitions(x.where("lang = 'es'").withColumn("what", F.lit("xx")), path, "lang")
    return spark.read.schema("doc_id long, what string, lang string").parquet(path).select("doc_id", F.col("what").alias("lang"))


@query("WITH s AS (SELECT DISTINCT run_id, segment_index, len(response_ids) AS n FROM segments) SELECT run_id, segment_index, CAST(n AS INT) AS tokens FROM s WHERE run_id IN (SELECT run_id FROM s GROUP BY run_id HAVING count(*) > 1)")
def segment_grids(spark, d):
    path = scratch(spark, "grids")
    files.segment_grids(table(spark, d, "segments")).write.parquet(path)
    return spark.read.parquet(path).select("run_id", "segment_index", F.when(F.col("response_ids").isNotNull(), F.size("response_ids")).alias("tokens"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, len(embedding) AS width FROM embeddings")
def index_written(spark, d):
    """Vectors written by cell and read back with their ids."""
    path, v = scratch(spark, "index"), vectors(spark, d)
    files.write_index(retrieval.assign_cells(v, retrieval.centroids_by_label(v)).withColumnRenamed("v", "embedding"), path)
    return files.shards(spark, path).select("id", F.size("v").cast("long").alias("width"))


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, event_id FROM events WHERE event_type IN ('error', 'click') AND user_id IS NOT NULL")
def run_files(spark, d):
    """Events of some kinds written to a folder for each user and read back."""
    path, e = scratch(spark, "runs"), table(spark, d, "events").where("user_id is not null")
    files.write_runs(e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("severity"), "event_id"), path, ["error", "click"])
    return files.read_runs(spark, path, "severity string, event_id long").select("run_id", "event_id")


@query("SELECT event_id, event_type FROM events WHERE event_id > 5000")
def events_after(spark, d):
    """What a reader who has seen 5,000 events gets."""
    return monitor.events_after(table(spark, d, "events"), 5000).select("event_id", "event_type")


@query("SELECT doc_id, repo AS url, text FROM documents WHERE doc_id IS NOT NULL")
def corpus_scan(spark, d):
    return files.corpus(table(spark, d, "documents").where("doc_id is not null").withColumn("url", F.coalesce("repo", F.lit(""))), "doc_id", "url", "text").withColumnRenamed("id", "doc_id")


@query("SELECT doc_id, n_chars AS n FROM documents WHERE doc_id % 4 = 0")
def event_lines(spark, d):
    """Lines of JSON, a quarter each good, blank, broken and no objects."""
    n, m = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    line = F.when(m == 0, F.concat(F.lit(' {"doc_id": '), n, F.lit(', "n": '), F.col("n_chars").cast("string"), F.lit("}"))).when(m == 1, "  ").when(m == 2, '{"doc_id": ').otherwise("[1]")
    return files.event_lines(table(spark, d, "documents").select(line.alias("value")), "doc_id long, n long")


@query("SELECT doc_id, 'Paper ' || doc_id AS title, 'A, B' AS authors, 'http://x/' || doc_id AS abs_url, CASE WHEN doc_id % 3 = 1 THEN 'http://x/' || doc_id || '.pdf' ELSE '(no pdf url)' END AS pdf_url FROM documents WHERE doc_id % 3 > 0")
def feed_entries(spark, d):
    """Entries of a feed; a third has no title."""
    n, m = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    pdf = F.when(m == 1, F.concat(F.lit('<link title="pdf" href="http://x/'), n, F.lit('.pdf"/>'))).otherwise("")
    title = F.when(m > 0, F.concat(F.lit("<title>Paper\n  "), n, F.lit("</title>"))).otherwise("<title> </title>")
    x = F.concat(F.lit("<entry>"), title, F.lit("<id>http://x/"), n, F.lit('</id><author><name>A</name></author><author><name> B </name></author><link href="http://x"/><link title="doi" href="http://d"/>'), pdf, F.lit("</entry>"))
    return files.feed_entries(table(spark, d, "documents").select("doc_id", x.alias("x")), "x").select("doc_id", "title", "authors", "abs_url", "pdf_url")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'skill ' || doc_id ELSE 'folder' END AS name, CASE doc_id % 3 WHEN 0 THEN 'What: it does' WHEN 1 THEN '' ELSE '' END AS description, CASE doc_id % 3 WHEN 0 THEN '# Body' || chr(10) WHEN 1 THEN 'x' ELSE '---' || chr(10) || 'name: broken' || chr(10) || 'no end' END AS body FROM documents")
def skill_files(spark, d):
    """Skill files with a whole head, one without a name, and one that never ends."""
    n, m = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    text = F.when(m == 0, F.concat(F.lit('---\nname: "skill '), n, F.lit("\"\ndescription: What: it does\nother: 1\n---\n# Body\n"))).when(m == 1, "---\nother: y\n---\nx").otherwise("---\nname: broken\nno end")
    s = files.front_matter(text, F.lit("folder"))
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", "s.name", "s.description", "s.body")


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS INT) AS messages, CASE WHEN doc_id % 3 = 0 THEN '{\"role\":\"user\"}' END AS first FROM documents")
def transcripts(spark, d):
    m = F.col("doc_id") % 3
    t = files.transcript(F.when(m == 0, '[{"role": "user"}, {"role": "assistant"}]').when(m == 1, '{"role": "user"}'))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("messages"), F.get(t, F.lit(0)).alias("first"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'größer ' || doc_id ELSE 'é' || doc_id END AS text FROM documents")
def decoded_bytes(spark, d):
    """Bytes in UTF-8, or else in Latin-1."""
    n = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode(F.concat(F.lit("größer "), n), "UTF-8")).otherwise(F.encode(F.concat(F.lit("é"), n), "ISO-8859-1"))
    return table(spark, d, "documents").select("doc_id", files.decode(raw).alias("text"))


@query("SELECT 't' || (doc_id // 3) AS task, doc_id FROM documents WHERE (doc_id // 3) % 2 = 0 AND doc_id // 3 <> 4")
def task_folders(spark, d):
    """Files in folders, every other one with a task file, one to skip."""
    folder = F.floor(F.col("doc_id") / 3)
    name = F.when((F.col("doc_id") % 3 == 0) & (folder % 2 == 0), "task.toml").otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string")))
    x = table(spark, d, "documents").select(F.concat(F.lit("t"), folder.cast("string"), F.lit("/"), name).alias("path"), F.col("doc_id").alias("content"))
    whole = x.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("t")).agg(F.max(F.col("path").endswith("task.toml")).alias("m"))
    return files.tasks(x.join(whole.where("m"), F.split_part("path", F.lit("/"), F.lit(1)) == F.col("t"), "left_semi"), skip=("t4",)).select("task", F.col("content").alias("doc_id"))


@query("SELECT doc_id, true AS equal, CAST(2 AS INT) AS merged, CAST(3 AS INT) AS names FROM documents")
def archives_and_overlays(spark, d):
    """Archives of the same files in another order, settings laid over others, outlines of code."""
    n = F.col("doc_id").cast("string")
    one = F.struct(F.lit("a").alias("path"), n.cast("binary").alias("content"))
    two = F.struct(F.lit("b/c").alias("path"), F.lit("x").cast("binary").alias("content"))
    code = F.concat(F.lit("class A:\n    def f(self):\n        pass\n\ndef g"), n, F.lit("():\n    return 1\n"))
    x = table(spark, d, "documents").select("doc_id", F.array(one, two).alias("p"), F.array(two, one).alias("q"), F.concat(F.lit('{"a": {"x": 1, "y": '), n, F.lit('}, "b": [1]}')).alias("low"), F.lit('{"a": {"x": null, "z": {}}, "b": [2, 3], "c": {}}').alias("high"), code.alias("code"))
    x = x.select("doc_id", (files.archive(F.col("p")) == files.archive(F.col("q"))).alias("equal"), udf.overlay_json("low", "high").alias("o"), udf.python_outline("code").alias("l"), n.alias("n"))
    right = F.col("o") == F.concat(F.lit('{"a":{"x":null,"y":'), F.col("n"), F.lit(',"z":{}},"b":[2,3],"c":{}}'))
    return x.select("doc_id", "equal", F.when(right, 2).otherwise(0).alias("merged"), F.size(F.filter("l", lambda e: e["depth"] <= 1)).alias("names"))
