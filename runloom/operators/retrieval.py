"""Vector retrieval: exact and cell-probed top-k, deduplicated results, look-ups by address."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors in a block of the index, and queries in a block; two blocks are multiplied in one task.
ROWS, ASKED = 4096, 512


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    n = F.sqrt(inner(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def _blocks(df: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (id, v) gathered in blocks of about ``size``, by a hash of the id, so that a block never grows with the table."""
    n = max(1, -(-df.count() // size))
    return df.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias(name)).agg(F.collect_list("id").alias(name + "_ids"), F.flatten(F.collect_list("v")).alias(name + "_v"))


def _scores(k: int):
    """Over rows of two blocks, query ids and vectors and vector ids and vectors: the k best of the block for each query, and ties with them."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                get = lambda c: one.column(c).flatten().to_numpy(zero_copy_only=False)
                qi, bi = get("q_ids"), get("b_ids")
                s = np.round(get("q_v").astype(np.float64).reshape(len(qi), -1) @ get("b_v").astype(np.float64).reshape(len(bi), -1).T, 6)
                m = min(k, len(bi))
                cut = -np.partition(-s, m - 1, axis=1)[:, m - 1 : m]
                at = np.nonzero(s >= cut)  # ties at the border stay until ids decide
                yield pa.RecordBatch.from_arrays([pa.array(qi[at[0]], pa.int64()), pa.array(bi[at[1]], pa.int64()), pa.array(s[at])], names=["query_id", "vec_id", "score"])

    return score


def _best(pairs: DataFrame, k: int) -> DataFrame:
    found = pairs.select("q_ids", "q_v", "b_ids", "b_v").mapInArrow(_scores(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def exact_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k vectors of largest inner product, ties by id, scores rounded to 6 places.

    Both sides have id and v (unit vectors of one width; rows with null vectors are left out). The stated queries meet all
    vectors block by block; a task holds one block of either and passes on k rows a query."""
    q, b = _blocks(queries.where("v is not null"), ASKED, "q"), _blocks(vectors.where("v is not null"), ROWS, "b")
    return _best(b.crossJoin(q), k)  # blocks, not rows


def dedup_results(results: DataFrame, address: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, url, score, rank): of results (query_id, vec_id, score) the best per url, then the first k. Results without url are dropped."""
    r = results.select("query_id", "vec_id", "score").join(address.where("url is not null").select("vec_id", "url"), "vec_id")
    best = F.row_number().over(W.partitionBy("query_id", "url").orderBy(F.desc("score"), "vec_id"))
    once = r.withColumn("b", best).where("b = 1").drop("b")
    return once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def centroids_by_label(vectors: DataFrame) -> DataFrame:
    """(cell, c): the mean vector of each label."""
    e = vectors.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    return e.groupBy(F.col("label").alias("cell")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))


#: Bytes of centroids that are sent to the executors at most.
CENTROID_BYTES = 1 << 28


def _sent_centroids(vectors: DataFrame, centroids: DataFrame):
    rows = centroids.where("cell is not null and c is not null").orderBy("cell").collect()  # as many as the index has cells
    if rows and len(rows) * len(rows[0]["c"]) * 8 > CENTROID_BYTES:
        raise ValueError(f"{len(rows)} centroids of {len(rows[0]['c'])} numbers are more than {CENTROID_BYTES} bytes")
    cells = np.array([r["cell"] for r in rows], np.int64)
    return vectors.sparkSession.sparkContext.broadcast((cells, np.array([r["c"] for r in rows], np.float64).reshape(len(rows), len(rows[0]["c"]) if rows else 0)))


def _nearest(vectors: DataFrame, centroids: DataFrame, n: int) -> DataFrame:
    """(id, v, cell) of each vector's n nearest centroids by inner product, rounded to 6 places, ties to the smaller cell. Vectors that are null have none."""
    sent = _sent_centroids(vectors, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, c = sent.value
        for b in batches:
            if not b.num_rows or not len(cells):
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            m = min(n, len(cells))
            # a stable sort keeps cells in order where scores are equal
            at = np.argsort(-np.round(v @ c.T, 6), axis=1, kind="stable")[:, :m]
            row = pa.array(np.repeat(np.arange(b.num_rows), m))
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(cells[at.ravel()].astype(np.int32))], names=["id", "v", "cell"])

    kind = vectors.schema["v"].dataType.simpleString()
    return vectors.where("v is not null").select("id", "v").mapInArrow(assign, f"id long, v {kind}, cell int")


def assign_cells(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, v, cell): each vector with the cell of its nearest centroid. Centroids are sent to every task, at most CENTROID_BYTES."""
    return _nearest(vectors, centroids, 1)


def probe_topk(queries: DataFrame, vectors: DataFrame, centroids: DataFrame, nprobe: int, k: int) -> DataFrame:
    """Top-k among the vectors of each query's nprobe nearest cells: blocks of a cell's vectors meet blocks of the queries that probe it.

    A cell with any number of vectors is many blocks, so no cell is gathered in one task."""
    b = _cell_blocks(assign_cells(vectors, centroids), ROWS, "b")
    q = _cell_blocks(_nearest(queries, centroids, nprobe), ASKED, "q")
    return _best(b.join(q, "cell"), k)


def _cell_blocks(df: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (id, v, cell) gathered by cell in blocks of about ``size`` or less: as many to a cell as its share of the largest one asks for."""
    largest = df.groupBy("cell").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    n = max(1, -(-largest // size))
    return df.groupBy("cell", F.pmod(F.xxhash64("id"), F.lit(n)).alias(name)).agg(F.collect_list("id").alias(name + "_ids"), F.flatten(F.collect_list("v")).alias(name + "_v"))


def train_cells(vectors: DataFrame, cells: int, sample: int = 100_000, seed: int = 7) -> DataFrame:
    """(cell, c): k-means centres fitted on at most about ``sample`` vectors (a bounded fit; every vector is then assigned)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = vectors.where("v is not null")
    n = vectors.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "cell int, c array<double>")
    some = vectors if n <= sample else vectors.sample(fraction=sample / n, seed=seed)
    model = KMeans(k=cells, seed=seed, maxIter=15).fit(some.select(array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("features")))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cell int, c array<double>")


def crawl(requests: DataFrame, passages: DataFrame) -> DataFrame:
    """(pos, url, passages, message) for each request in order: ids of the passages at a url, a message where there are none."""
    index = passages.where("url is not null and url <> ''").groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("passages"))
    out = requests.join(index, "url", "left")
    return out.select("pos", "url", F.coalesce("passages", F.lit("")).alias("passages"), F.when(F.col("passages").isNull(), F.concat(F.lit("No passages found for URL: "), F.col("url"))).otherwise("").alias("message"))


def fetch_filter_limit(df: DataFrame, order: list[Column], fetch: int, keep: Column, k: int) -> DataFrame:
    """The first k of those among the first ``fetch`` rows that ``keep`` holds for (the order of the two limits matters)."""
    return df.orderBy(*order).limit(fetch).where(keep).orderBy(*order).limit(k)


def format_results(results: DataFrame) -> DataFrame:
    """(query_id, text) of results (query_id, rank, url, title, content, text, snippet, score): a numbered list by rank, each with the first of content,
    text and snippet that is not empty. Lists of queries are k long."""
    shown = F.coalesce(F.nullif("content", F.lit("")), F.nullif("text", F.lit("")), F.nullif("snippet", F.lit("")), F.lit("No snippet provided"))
    score = F.when(F.col("score").isNotNull(), F.concat(F.lit("Score: "), F.col("score").cast("string"), F.lit("\n"))).otherwise("")
    body = F.concat(F.lit(". url: "), F.coalesce("url", F.lit("No URL provided")), F.lit("\nTitle: "), F.coalesce("title", F.lit("No title provided")), F.lit("\n"), score, F.lit("Snippet: "), shown, F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct("rank", body.alias("body"))))
    lines = F.transform(rows, lambda r, i: F.concat((i + 1).cast("string"), r["body"]))
    return results.groupBy("query_id").agg(F.trim(F.concat_ws("\n", F.concat(F.lit("Found "), F.count("*").cast("string"), F.lit(" results:")), F.array_join(lines, "\n")), F.lit("\n ")).alias("text"))


def query_text(model: Column, text: Column, is_query: bool) -> Column:
    """A text with the instruction that an encoder's family wants before it."""
    name = F.lower(model)
    other = F.when(name.contains("bge") & F.lit(is_query), F.concat(F.lit("Represent this sentence for searching relevant passages: "), text)).otherwise(text)
    return F.when(name.contains("e5"), F.concat(F.lit("query: " if is_query else "passage: "), text)).when(name.contains("bge-m3"), text).otherwise(other)


def pooled(tokens: Column, mask: Column) -> Column:
    """The mean of the token vectors that the mask keeps, at length 1; a zero vector where it keeps none."""
    n = F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int"))
    width = F.size(F.get(tokens, F.lit(0)))
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(F.zip_with(tokens, mask, lambda t, m: F.struct(t.alias("t"), m.alias("m"))), zero, lambda a, x: F.when(x["m"] > 0, F.zip_with(a, x["t"], lambda p, q: p + q.cast("double"))).otherwise(a))
    return unit(F.transform(total, lambda x: x / F.greatest(n, F.lit(1))))
