"""The test tables' schemas, and tables of them that are empty or hold nulls, repeats and clashing columns."""

SCHEMAS = {
    "turns": "turn_id bigint, run_id string, step_idx int, tokens int, response string, thought string, finish_reason string, done boolean, exit_reason string, source string, started_at timestamp_ntz, ingested_at timestamp_ntz",
    "tool_results": "call_id bigint, run_id string, step_idx int, call_idx int, tool_call_id string, tool_name string, action string, observation string, status string, execution_time double, source string, started_at timestamp_ntz, ingested_at timestamp_ntz",
    "segments": "run_id string, segment_index int, prompt_ids array<int>, response_ids array<int>, response_mask array<tinyint>, response_logprobs array<double>, turn_spans array<struct<step:int,span_start:int,span_end:int>>",
    "run_log": "run_id string, source string, byte_offset bigint, text string",
    "chat_events": "delivery_id bigint, batch_id bigint, received_at timestamp_ntz, chat_id string, message_id string, sender_id string, chat_type string, message_type string, content string, create_time string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, repo string, title string, created_at timestamp_ntz",
    "eval_items": "item_id bigint, suite string, text string",
    "mix_targets": "source string, target_share double, max_repeats int",
    "pack_limits": "container string, capacity int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
#: Columns that operators use inside, as further columns of every input.
CLASH = "n bigint, t string, u double, w bigint, s bigint, rn int, rank int, kind string, bucket bigint, kept boolean, salt int, piece int, tokens_ string, steps string, entry bigint, layout int, copies int"


def write(spark, root, rows=None):
    """Tables under ``root``: empty, or of ``rows`` {table: [dict]} with nulls for what a dict leaves out."""
    for name, schema in SCHEMAS.items():
        names = {c.split(" ")[0] for c in schema.replace("struct<step:int,span_start:int,span_end:int>", "x").split(", ")}
        extra = ", ".join(c for c in CLASH.split(", ") if c.split(" ")[0] not in names)
        full = spark.createDataFrame([], f"{schema}, {extra}").schema
        data = [tuple(r.get(f.name) for f in full) for r in (rows or {}).get(name, [])]
        spark.createDataFrame(data, full).coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}.parquet")
    return str(root)


def nulls():
    """Two equal all-null rows of every table, and a few that are nearly so."""
    rows = {name: [{}, {}] for name in SCHEMAS}
    rows["turns"] += [{"turn_id": 1, "run_id": "r", "step_idx": 1, "response": ""}, {"turn_id": 2, "run_id": "r", "response": "x" * 200_000, "source": "s"}]
    rows["tool_results"] += [{"call_id": 1, "run_id": "r"}, {"call_id": 1, "run_id": "r"}, {"call_id": 2, "run_id": "r", "action": "", "observation": " "}]
    rows["segments"] += [{"run_id": "r", "segment_index": 0, "response_ids": []}]
    rows["run_log"] += [{"run_id": "r", "source": "f", "byte_offset": 0}, {"run_id": "r", "source": "f", "byte_offset": 0}, {"byte_offset": 5, "text": ""}]
    rows["chat_events"] += [{"delivery_id": 1, "message_id": " "}, {"delivery_id": 2, "message_id": "m"}, {"delivery_id": 2, "message_id": "m"}]
    rows["documents"] += [{"doc_id": 1, "text": ""}, {"doc_id": 2, "text": "é" * 100_000, "source": "a"}]
    rows["eval_items"] += [{"item_id": 1, "text": ""}]
    rows["mix_targets"] += [{"source": "a", "target_share": 1.0, "max_repeats": 2}]
    rows["pack_limits"] += [{"container": "c", "capacity": 8}, {"container": "d", "capacity": 0}]
    return rows
