"""Texts that were decoded with the wrong character encoding: found and, where possible, restored."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm import encoding_kernel as kernel
from runloom.llm._ship import by_value

by_value(kernel, sys.modules[__name__])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, rows = b.column(0).to_pylist(), []
        for i, text in zip(ids, b.column(1).to_pylist()):
            garbled, fixed, steps, before, after = kernel.judge(text)
            if garbled:
                rows.append((i, fixed, steps, round(before, 3), round(after, 3), bool(steps) and after < kernel.LEAST_DROP))
        columns = list(zip(*rows)) if rows else [[]] * 6
        types = (b.schema.field(0).type, pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "restored_text", "steps", "cost_before", "cost_after", "restored"])


def repair(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Garbled documents only: id, restored_text, steps (wrong>right encodings in the order tried), costs, restored.

    A text is re-encoded under candidate legacy encodings and strictly decoded as the encoding meant, as a whole, by
    line, by sentence, by word and by character, layer after layer, and a reading is accepted when a garbling cost
    drops. Texts whose cost stays (characters lost for good) are garbled with restored = false. Null, empty and ASCII
    texts are never garbled and don't leave the JVM. One row per input row: equal ids or texts are each judged.
    """
    type_of = documents.schema[id_col].dataType.simpleString()
    some = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.octet_length("text") != F.char_length("text"))
    return some.mapInArrow(_judge, f"doc_id {type_of}, restored_text string, steps string, cost_before double, cost_after double, restored boolean")
