"""Queries of the operators for model training data; every one runs over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import event_runs, leakage, mixing, mojibake, packing, truncation
from runloom.operators.sequence import numbered
from runloom.sources.tables import spread, table

#: The rank file of a public tokenizer that the mixture is measured with, read on the driver.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_truncated(spread(truncation.texts(table(spark, d, "turns"), table(spark, d, "tool_results"))))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose end is missing."""
    return _judged(spark, d).where("truncated").select("field", "record_id").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.report(_judged(spark, d))


def p2_pack(spark: SparkSession, d: str) -> DataFrame:
    """Each segment's container of every capacity, with the container's fill."""
    return packing.pack(packing.items_of_segments(table(spark, d, "segments")), table(spark, d, "pack_limits"))


def p2_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and fill per capacity."""
    return packing.fill_report(p2_pack(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of two or more neighbouring calls that are the same."""
    return event_runs.collapse(table(spark, d, "tool_results")).where("calls > 1").select("run_id", "first_call_id", "last_call_id")


def p3_events(spark: SparkSession, d: str) -> DataFrame:
    """All calls as events with count and duration."""
    return event_runs.collapse(table(spark, d, "tool_results"))


def p3_near(spark: SparkSession, d: str) -> DataFrame:
    """Calls as events, nearly equal ones together: seven in ten words, at most ten minutes apart."""
    return event_runs.collapse(table(spark, d, "tool_results"), 0.7, 600.0)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an evaluation item or a passage of it."""
    return leakage.find_leaks(spread(table(spark, d, "documents")), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, into how many documents."""
    hits = leakage.find_leaks(spread(table(spark, d, "documents")), table(spark, d, "eval_items"))
    return hits.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("tokens").alias("most_tokens"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixture of sources, shuffled."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), TOKENIZER)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares that the mixture reaches."""
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"), TOKENIZER)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents."""
    return mojibake.repair(spread(table(spark, d, "documents"))).select("doc_id").distinct()


def p8_repair(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents with their restored texts."""
    return mojibake.repair(spread(table(spark, d, "documents")))


# Checks of whole results that SQL can make.


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts that were judged, by field and source."""
    return p1_report(spark, d).select("field", "source", "texts")


def p1_planted(spark: SparkSession, d: str) -> DataFrame:
    """One sentence for each document, of which every twentieth is cut somewhere inside a word; those found."""
    head = F.concat(F.lit("The parser of module "), F.col("doc_id").cast("string"), F.lit(" keeps its "))
    left = F.expr("3 + doc_id div 20 % 9").cast("int")
    text = F.concat(head, F.when(F.col("doc_id") % 20 == 0, F.left(F.lit("configuration"), left)).otherwise("configuration under load."))
    x = table(spark, d, "documents").select(F.lit("text").alias("field"), F.col("doc_id").alias("record_id"), F.lit("made").alias("source"), text.alias("text"))
    return truncation.find_truncated(x).where("truncated").select(F.col("record_id").alias("doc_id")).distinct()


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    """Pieces and tokens of each kind of container, that none is overfull, and that room for less than one in a hundred is unused but in the last."""
    p = p2_pack(spark, d)
    c = p.groupBy("container", "capacity", "container_no").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("used").alias("used"))
    t = c.groupBy("container", "capacity").agg(F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.max(F.greatest("tokens", "used")).alias("most"))
    tight = F.col("n") - 1 <= F.ceil(1.01 * F.col("tokens") / F.col("capacity"))
    return t.select("container", F.col("capacity").cast("int").alias("capacity"), "pieces", "tokens", (F.col("most") <= F.col("capacity")).alias("none_overfull"), tight.alias("tight"))


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    """Calls of each run over all its events, its first and last call, and that no event has the tool, text and state of the one before."""
    e = p3_events(spark, d).withColumn("same", F.struct("tool_name", "status", F.coalesce("action", F.lit(""))))
    e = numbered(e, "run_id", ("first_step", "first_call_id"), "nth")
    before = e.select("run_id", (F.col("nth") + 1).alias("nth"), F.col("same").alias("before"))
    j = e.join(before, ["run_id", "nth"], "left")
    out = j.groupBy("run_id").agg(F.sum("calls").alias("calls"), F.min("first_step").alias("first_step"), F.max("last_step").alias("last_step"), F.max(F.coalesce(F.col("same") == F.col("before"), F.lit(False))).alias("again"))
    return out.select("run_id", "calls", "first_step", "last_step", (~F.col("again")).alias("none_again"))


def p6_contained(spark: SparkSession, d: str) -> DataFrame:
    """Of the pairs found those whose document holds the item's text word for word, whatever its case and blanks."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    j = p6_found(spark, d).join(docs.select("doc_id", flat("text").alias("t")), "doc_id").join(items.select("item_id", flat("text").alias("i")), "item_id")
    return j.where(F.contains("t", F.col("i"))).select("doc_id", "item_id")


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """Of each target its documents, that none is taken too often, and that its share is met, of the targets that have documents, within a twentieth."""
    docs, goals = table(spark, d, "documents"), table(spark, d, "mix_targets")
    s = p7_shares(spark, d)
    have = docs.groupBy("source").agg(F.count("*").alias("available"))
    total = s.where("available_tokens > 0").agg(F.sum("target_share").alias("goal"))
    most = p7_mix(spark, d).groupBy("source").agg((F.max("copy") + 1).alias("most"))
    j = s.join(have, "source", "left").join(most, "source", "left").crossJoin(F.broadcast(total))  # one row
    met = F.when(F.col("available_tokens") > 0, F.abs(F.col("actual_share") - F.col("target_share") / F.col("goal")) < 0.05).otherwise(F.col("actual_share") == 0)
    return j.join(goals.select("source"), "source").select("source", F.coalesce("available", F.lit(0)).alias("available"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"), met.alias("share_met"))


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A sentence for each document, read in the wrong encoding once or twice, restored."""
    n = F.col("doc_id").cast("string")
    wrong = lambda x: F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")
    once = wrong(F.concat(F.lit("Die Prüfung der Größe "), n, F.lit(" läuft über Nacht.")))
    x = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, once).otherwise(wrong(once)).alias("text"))
    return mojibake.repair(x).select("doc_id", "restored_text")


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_texts, p1_planted, p2_pack, p2_fill, p2_totals, p3_found, p3_events, p3_near, p3_totals, p6_found, p6_items, p6_contained, p7_mix, p7_shares, p7_limits, p8_found, p8_repair, p8_roundtrip)}
SQL = {
    "p1_texts": """SELECT 'response' AS field, source, count(DISTINCT turn_id) AS texts FROM turns WHERE trim(response, ' ') <> '' GROUP BY ALL UNION ALL SELECT 'observation', source, count(DISTINCT call_id) FROM tool_results WHERE trim(observation, ' ') <> '' GROUP BY ALL""",
    "p1_planted": "SELECT DISTINCT doc_id FROM documents WHERE doc_id % 20 = 0",
    "p8_roundtrip": "SELECT doc_id, 'Die Prüfung der Größe ' || doc_id || ' läuft über Nacht.' AS restored_text FROM documents",
    "p2_totals": """WITH s AS (SELECT coalesce(len(prompt_ids), 0) + coalesce(len(response_ids), 0) AS n FROM segments) SELECT container, capacity, CAST(sum(greatest(ceil(n / capacity), 1)) AS BIGINT) AS pieces, CAST(sum(n) AS BIGINT) AS tokens, true AS none_overfull, true AS tight FROM s, pack_limits GROUP BY ALL""",
    "p3_totals": """SELECT run_id, count(DISTINCT call_id) AS calls, min(step_idx) AS first_step, max(step_idx) AS last_step, true AS none_again FROM tool_results WHERE run_id IS NOT NULL GROUP BY run_id""",
    "p6_contained": r"""WITH d AS (SELECT DISTINCT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents), i AS (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS i FROM eval_items) SELECT DISTINCT doc_id, item_id FROM d, i WHERE contains(t, i)""",
    "p7_limits": """SELECT m.source, count(d.doc_id) AS available, true AS within_cap, true AS share_met FROM mix_targets m LEFT JOIN documents d ON d.source = m.source GROUP BY m.source""",
}
