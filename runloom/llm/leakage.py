"""Evaluation items whose text leaked into documents, by spaced-seed hashing."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm import leak_kernel as kernel
from runloom.llm._ship import by_value
from runloom.session import checkpoint

by_value(kernel, sys.modules[__name__])

#: Tokens of evaluation items in one block. Each block is sent to all executors (about 100 bytes a token) and takes one pass.
BLOCK_TOKENS = 2_000_000


def tokens(text: Column) -> Column:
    """Hashes of a text's words and numbers, lower case, whatever stands between them."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values.view(np.uint64), offsets - offsets[0]


def find_leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id, tokens, rare_tokens): documents that hold an item or a passage of it.

    Seeds of all items are joined to the seeds of all documents; each document-item pair that meets is aligned whole, tolerant
    of replaced, added and missing words. A passage is 20 tokens, 4 of them rare (held by at most two items, or 2 % of them),
    or all of an item that has fewer. One row per pair and per document row. Documents or items with null or empty text have
    no row. Items of equal tokens are one class while searched, and each has its row; items reworded into more than two (or
    2 %) others share their words with them, which then count as common. Which tokens are common is counted over all items;
    then they are taken in blocks of BLOCK_TOKENS tokens, one pass over the documents each, so no size of the evaluation set
    is too large to send and blocks don't change what is found.
    """
    items = eval_items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    items = checkpoint(items)
    classes = items.groupBy("t").agg(F.min("item_id").alias("class_id"))
    many, total = classes.agg(F.count("*"), F.coalesce(F.sum(F.size("t")), F.lit(0))).first()
    df = classes.select(F.explode(F.array_distinct("t")).alias("token")).groupBy("token").count().where(F.col("count") > kernel.common_above(many))
    # at most 1 / COMMON_SHARE times the distinct tokens of a middling item
    common = np.sort(np.array([r[0] for r in df.select("token").collect()], np.int64)).view(np.uint64)
    blocks = max(1, -(-total // BLOCK_TOKENS))
    docs = documents.where(F.col("text").isNotNull()).select("doc_id", tokens(F.col("text")).alias("t"))
    type_of = documents.schema["doc_id"].dataType.simpleString()
    out = None
    for k in range(blocks):
        part = classes if blocks == 1 else classes.where(F.pmod(F.xxhash64("class_id"), F.lit(blocks)) == k)
        rows = part.select("class_id", "t").orderBy("class_id").collect()  # at most about BLOCK_TOKENS tokens
        index = kernel.SeedIndex.build([r[0] for r in rows], [np.array(r[1], np.int64).view(np.uint64) for r in rows], common)
        sent = documents.sparkSession.sparkContext.broadcast(index.arrays())

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = kernel.SeedIndex(*sent.value)
            for b in batches:
                flat, offsets = _flat(b.column(1))
                doc_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                found = [(d, int(index.ids[i]), *v) for (d, i), v in index.overlaps(flat, doc_of, offsets).items()]
                ids = b.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([f[c] for f in found], pa.int64()) for c in (1, 2, 3)]], names=["doc_id", "class_id", "tokens", "rare_tokens"])

        hits = docs.mapInArrow(search, f"doc_id {type_of}, class_id long, tokens long, rare_tokens long")
        out = hits if out is None else out.unionByName(hits)
    members = items.join(classes, "t").select("class_id", "item_id")
    return out.join(members, "class_id").select("doc_id", "item_id", "tokens", "rare_tokens")
