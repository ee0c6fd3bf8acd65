"""Messages delivered at least once, reduced to one copy each by a Bloom filter per time bucket and exact verification.

Ids are stored by time bucket, one row per bucket and id. Each bucket has a Bloom filter, kept as rows of 64-bit words, so
neither building nor asking it gathers more than a word in one place. An id whose bits no earlier bucket holds is new
beyond doubt; the others are verified exactly in the storage of the nearest earlier bucket whose filter holds them, then, where that
was mistaken, in the one before it, and in no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.session import checkpoint

#: Seconds of received_at in one bucket; bits that an id sets in its word; ids of all buckets to a word. Filters are as long as all
#: ids together need and stored without their empty words, so neither what an id asks nor how often it is mistaken grows with the number of buckets.
BUCKET_S, BITS, IDS_PER_WORD = 6 * 3600, 4, 5
#: Parts, at least, into which the deliveries of one id and bucket are split when they are marked; an eighth of the shuffle partitions if that is more.
SALTS = 16
#: Bucket of deliveries without received_at, after all others.
NO_TIME = 1 << 60


def normal_id(message_id: Column) -> Column:
    """An id without blanks at either end; null for an empty one, which repeats no other."""
    return F.nullif(F.regexp_replace(message_id, r"^[\s\u00a0\u200b\ufeff\u2000-\u200a\u3000]+|[\s\u00a0\u200b\ufeff\u2000-\u200a\u3000]+$", ""), F.lit(""))


def _mask(h: Column) -> Column:
    """BITS bits of a word, from the upper part of a hash."""
    out = F.lit(0).cast("long")
    for i in range(BITS):
        out = out.bitwiseOR(F.expr(f"shiftleft(1L, cast(shiftright(h, {20 + 6 * i}) & 63 as int))"))
    return out


def mark(events: DataFrame, id_col: str = "message_id", time_col: str = "received_at", delivery_col: str = "delivery_id", bucket_s: int = BUCKET_S) -> DataFrame:
    """(delivery_id, bucket, message_id without blanks, kept) of every delivery.

    Ids are equal if they are so without blanks at either end; case matters. Of equal ids the earliest received_at is kept, then
    the smallest delivery_id; deliveries without a time come after those with one. Null and empty ids never repeat: all
    are kept. Rows equal in id, time and delivery_id are one delivery and share their verdict. An empty table gives an
    empty result.
    """
    rows = events.select(F.col(delivery_col).alias("delivery_id"), normal_id(F.col(id_col)).alias("message_id"), F.unix_micros(F.col(time_col).cast("timestamp")).alias("at"))
    rows = rows.withColumn("bucket", F.coalesce(F.floor(F.col("at") / (bucket_s * 1_000_000)), F.lit(NO_TIME)))

    # exact storage: one row per bucket and id, combined before the shuffle, so a hot id costs one row per task
    store = rows.where("message_id is not null").groupBy("bucket", "message_id").agg(F.min(F.struct(F.coalesce("at", F.lit(1 << 62)).alias("at"), "delivery_id")).alias("first"), F.count("*").alias("n"))
    store = checkpoint(store.withColumn("h", F.xxhash64("message_id")))
    words = max(16, store.count() // IDS_PER_WORD)
    bits = store.select("bucket", "message_id", "first", F.pmod("h", F.lit(words)).alias("word"), _mask(F.col("h")).alias("mask"))

    # the filters: per word the buckets that set bits in it, in order; each id meets the word of its hash once per bucket
    filters = bits.groupBy("word", "bucket").agg(F.bit_or("mask").alias("set"))
    filters = filters.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("bucket", "set"))).alias("buckets"))
    asked = bits.join(filters, "word").select("bucket", "message_id", F.transform(F.filter("buckets", lambda b: (b["bucket"] < F.col("bucket")) & (b["set"].bitwiseAND(F.col("mask")) == F.col("mask"))), lambda b: b["bucket"]).alias("maybe"))
    maybe = asked.where(F.size("maybe") > 0)
    # exact check in the storage of the nearest bucket named, and only there; a second round is for filters that were mistaken
    kept_ids = store.select(F.col("bucket").alias("seen_in"), "message_id", F.lit(True).alias("seen"))
    verified = None
    while True:
        nearest = maybe.select("bucket", "message_id", F.element_at("maybe", -1).alias("seen_in"), F.slice("maybe", F.lit(1), F.size("maybe") - 1).alias("maybe"))
        checked = checkpoint(nearest.join(kept_ids, ["seen_in", "message_id"], "left"))
        right = checked.where("seen").select("bucket", "message_id")
        verified = right if verified is None else verified.unionByName(right)
        maybe = checked.where(F.col("seen").isNull() & (F.size("maybe") > 0)).select("bucket", "message_id", "maybe")
        if maybe.isEmpty():
            break

    # ids with something to mark: repeated inside their bucket, or seen in an earlier one
    known = verified.withColumn("seen", F.lit(True))
    marks = store.join(known, ["bucket", "message_id"], "left").where("n > 1 or seen").select("bucket", "message_id", F.col("first.delivery_id").alias("first_id"), F.col("first.at").alias("first_at"), F.coalesce("seen", F.lit(False)).alias("seen"))
    salts = max(SALTS, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    marks = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("delivery_id"), F.lit(salts)).cast("int"))
    out = salted.join(marks, ["bucket", "message_id", "salt"], "left")
    is_first = (F.col("first_id") == F.col("delivery_id")) & (F.col("first_at") == F.coalesce("at", F.lit(1 << 62)))
    return out.select("delivery_id", "bucket", "message_id", (F.col("first_id").isNull() | (~F.col("seen") & is_first)).alias("kept"))


def found(events: DataFrame) -> DataFrame:
    """delivery_id of each delivery that is not the one to keep."""
    return mark(events).where("not kept").select("delivery_id").distinct()


def deduplicate(events: DataFrame, delivery_col: str = "delivery_id") -> DataFrame:
    """The deliveries to keep, whole: every column of ``events``, exactly one delivery per message id.

    A delivery_id stands for one row; where the table holds copies of a delivery's row, all of them are kept or none."""
    gone = mark(events, delivery_col=delivery_col).where("not kept").select(F.col("delivery_id").alias("_gone")).distinct()
    return events.join(gone, F.col(delivery_col) == F.col("_gone"), "left_anti")


def copies_by_batch(events: DataFrame) -> DataFrame:
    """Per batch: deliveries, copies dropped, and messages."""
    m = mark(events).groupBy("delivery_id").agg(F.min("kept").alias("kept"))
    return events.select("delivery_id", "batch_id").join(m, "delivery_id").groupBy("batch_id").agg(F.count("*").alias("deliveries"), F.sum(F.when(F.col("kept"), 0).otherwise(1)).cast("long").alias("copies"))
