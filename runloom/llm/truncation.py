"""Texts that lost their end (field limits, broken transfers), found by word trigrams in SQL.

A trigram that is frequent inside texts and hardly ever ends one is no place where a text ends. Trigrams are counted
over all texts in two spellings: with rare words (which a cut word nearly always becomes) replaced by their shape, and
with every word replaced by its shape, kept apart by how texts of that layout begin. The last trigram of each text is
joined to these counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.session import checkpoint

#: One token: a run of letters and digits, or any other character but space (CJK characters among them).
TOKEN = r"[A-Za-z0-9À-ÖØ-῿]+|\S"
#: A token that begins with a letter. Plain ranges match several times faster than negated classes.
WORD = r"[A-Za-zÀ-ÖØ-῿][A-Za-z0-9À-ÖØ-῿]*"
#: What may stand in a lost end's place; U+FFFD is what a limit in bytes leaves of a character that it cut.
MARKER = r"(?i)\uFFFD*\s*(?:[\[<(][^\[\]<>()\n]{0,40}\b(?:cut|truncated|clipped|omitted|trimmed|shortened|snip)\b[^\[\]<>()\n]{0,40}[\])>]|\.\.\.|…)\s*$|\uFFFD+\s*$"
#: A remark by the tool after the text's own end.
REMARK = r"\s*<NOTE>[^<]*</NOTE>\s*$"


@dataclass(frozen=True)
class TruncationParams:
    """rare: a word is rare below so many occurrences a text, or beyond the ``vocabulary`` most frequent words of its field.
    support: occurrences that a trigram's rate needs. least_ends: ends that a trigram of words needs to speak for itself.
    usual: rate of ends from which a trigram is a usual end. rate: share of a trigram's occurrences that are ends, below
    which an end is no end; *_rate: the same after an ellipsis, and after a marker in words.

    The rates were read off the counts of sf0.1, where cuts end at 0.0355 and below and usual ends begin at 0.037; an
    ellipsis or a marker stands behind whole texts too, which end at 0.2 and more, and at 0.6 and more."""

    rare: float = 0.02
    vocabulary: int = 20_000
    support: int = 20
    usual: float = 0.05
    least_ends: int = 3
    rate: float = 0.036
    ellipsis_rate: float = 0.12
    marker_rate: float = 0.5


def _shape(t: Column) -> Column:
    """A small number for a token's shape: 1 lower case, 2 upper case, 3 digits, 4 CJK, 5 many digits and letters, 6 other letters;
    for other characters 64 + code point."""
    c = F.ascii(t)
    return (
        F.when((c >= 97) & (c <= 122), 1)
        .when((c >= 65) & (c <= 90), 2)
        .when((c >= 48) & (c <= 57), F.when(F.length(t) > 6, 5).otherwise(3))
        .when((c >= 0x3040) & (c <= 0x9FFF), 4)
        .when((c >= 0xC0) & (c < 0x3040) & (c != 0xD7) & ~c.between(0x2000, 0x2FFF), 6)
        .otherwise(64 + c)
    ).cast("long")


def _pack(*ids: Column) -> Column:
    out = F.lit(0).cast("long")
    for i in ids:
        out = out * F.lit(1 << 20) + i
    return out


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _kind(first: Column) -> Column:
    """A number for how a text begins: the shapes of its first four tokens."""
    return F.xxhash64(*[F.coalesce(_shape(F.get(first, F.lit(i))), F.lit(0)) for i in range(4)])


def _body(df: DataFrame) -> DataFrame:
    """``df`` with body (text without blanks, remarks and markers at its end) and marker (3 a lost character, 2 in words, 1 an ellipsis, 0 none).

    A marker in words is one bracket of up to 40 characters before and after its word; a longer one is part of the text."""
    own = F.rtrim(F.when(F.rtrim("text").endswith("</NOTE>"), F.regexp_replace("text", REMARK, "")).otherwise(F.col("text")))
    out = df.select("field", "record_id", "source", own.alias("own")).withColumn("end", F.right("own", F.lit(128)))
    out = out.withColumn("found", F.when(F.col("end").rlike(r"[\])>…]$|\uFFFD\s*$|\.\.\.$"), F.regexp_extract("end", MARKER, 0)).otherwise(""))
    marker = F.when(F.col("found") == "", 0).when(F.startswith("found", F.lit("\ufffd")), 3).when(F.trim("found").isin("...", "…"), 1).otherwise(2)
    return out.select("field", "record_id", "source", marker.alias("marker"), F.substring("own", F.lit(1), F.length("own") - F.length("found")).alias("body"))


def texts(turns: DataFrame | None, tool_results: DataFrame | None) -> DataFrame:
    """(field, record_id, source, text) of the texts that can lose their end; null and blank texts are left out."""
    parts = []
    if turns is not None:
        parts.append(turns.select(F.lit("response").alias("field"), F.col("turn_id").cast("long").alias("record_id"), "source", F.col("response").alias("text")))
    if tool_results is not None:
        parts.append(tool_results.select(F.lit("observation").alias("field"), F.col("call_id").cast("long").alias("record_id"), "source", F.col("observation").alias("text")))
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return df.where(F.trim("text") != "")


def find_truncated(df: DataFrame, params: TruncationParams = TruncationParams()) -> DataFrame:
    """The ends of ``df`` (field, record_id, source, text, any others ignored) judged: field, record_id, source, ends_at_rate, truncated.

    One row per record and end: copies with equal ends have one, null or blank texts none. A null source counts as a
    source of its own. A text that ends in U+FFFD has lost its last character, whatever else ends so; one that is nothing
    but a marker or U+FFFD has no trigram, and is cut only for U+FFFD. With few texts, trigrams lack the support that a
    verdict needs and shorter contexts decide. An empty table gives an empty result.

    Two passes over the texts: one for the frequent words, one in which the trigrams inside are counted and the last ones kept with
    their records; everything else works on what that pass leaves.
    """
    p = params
    base = _body(df)
    start = F.lit("\x02")

    # the most frequent words, a bounded number a field
    words_of = base.select("field", F.explode(F.regexp_extract_all("body", F.lit(WORD), F.lit(0))).alias("w")).select("field", F.xxhash64("w").alias("h"), _shape(F.col("w")).alias("shape"))
    words_of = words_of.where(F.col("shape").isin(1, 2, 6)).groupBy("field", "h").count()
    n_texts = base.groupBy("field").agg(F.count("*").alias("n"))
    frequent = words_of.join(F.broadcast(n_texts), "field").where(F.col("count") >= F.greatest(F.lit(5), p.rare * F.col("n")))
    place = F.row_number().over(W.partitionBy("field").orderBy(F.desc("count"), "h"))
    vocab: dict[str, list[int]] = {}
    for field, h in frequent.withColumn("place", place).where(F.col("place") <= p.vocabulary).select("field", "h").collect():
        vocab.setdefault(field, []).append(h)

    def frequent_word(h: str) -> Column:
        some = [f"(field = '{name.replace(chr(39), chr(92) + chr(39))}' AND {h} IN ({', '.join(f'{x}L' for x in hs)}))" for name, hs in sorted(vocab.items())]
        return F.expr(" OR ".join(some)) if some else F.lit(False)

    def numbered(x: DataFrame) -> DataFrame:
        """Columns a, b, c as w (words, shapes for rare ones), s (shapes) and rare (whether c is a rare word)."""
        for c in "abc":
            x = x.withColumn("h" + c, F.xxhash64(c)).withColumn("s" + c, _shape(F.col(c)))
        for c in "abc":
            x = x.withColumn("f" + c, frequent_word("h" + c))
        w = F.xxhash64(*[F.when(F.col("f" + c), F.col("h" + c)).otherwise(F.col("s" + c)) for c in "abc"])
        keep = [c for c in x.columns if c[0] not in "abchsf" or len(c) > 2]
        return x.select(*keep, w.alias("w"), _pack(F.col("sa"), F.col("sb"), F.col("sc")).alias("s"), (~F.col("fc") & F.col("sc").isin(1, 2, 6)).alias("rare"))

    # no filter here: it would be pushed below and split every text twice; texts without a token have their marker alone
    tok = base.select("field", "record_id", "source", "marker", F.concat(F.array(start, start), _tokens(F.col("body"))).alias("q")).select("field", "record_id", "source", "marker", "q", F.greatest(F.size("q") - 2, F.lit(1)).alias("n"), _kind(F.slice("q", F.lit(3), F.lit(4))).alias("kind"))
    zipped = F.arrays_zip(F.slice("q", F.lit(1), F.col("n")), F.slice("q", F.lit(2), F.col("n")), F.slice("q", F.lit(3), F.col("n")))
    last = F.col("at") == F.col("n") - 1
    of_last = [F.when(last, F.col(c)).alias(c) for c in ("record_id", "source", "marker")]
    exploded = tok.select("field", "record_id", "source", "marker", "kind", "n", F.posexplode(zipped).alias("at", "g")).select("field", *of_last, "kind", F.col("g.0").alias("a"), F.col("g.1").alias("b"), F.coalesce("g.2", start).alias("c"), last.alias("last"))
    counted = checkpoint(numbered(exploded).groupBy("field", "kind", "w", "s", "rare", "last", "record_id", "source", "marker").agg(F.count("*").alias("n")))
    words = counted.select("field", "kind", "w", "s", "rare", F.when(F.col("last"), F.col("n")).otherwise(0).alias("ends"), F.col("n").alias("all"))

    # Ends in a frequent word or sign that often stand at the end account for themselves. What shapes say about a rare last
    # word, which may be a cut one, leaves them out.
    by_word = words.groupBy("field", "w").agg(F.sum("ends").alias("e"), F.sum("all").alias("n")).where((F.col("e") >= p.least_ends) & (F.col("n") >= p.support))
    by_word = by_word.select("field", "w", (F.col("e") / F.col("n")).alias("r_word"))
    known = words.join(by_word, ["field", "w"], "left").select(
        "field", "kind", "w", "s", "rare", F.pmod("s", F.lit(1 << 40)).alias("s2"), F.pmod("s", F.lit(1 << 20)).alias("s1"), "ends", "all", "r_word",
        F.when(~F.col("rare") & (F.coalesce("r_word", F.lit(0.0)) >= p.usual), 0).otherwise(F.col("ends")).alias("open"),
    )

    sums = [F.sum(c).alias(c) for c in ("ends", "open", "all")]
    by_shape = known.groupBy("field", "s", "s2", "s1").agg(*sums)

    def rate(of: DataFrame, keys: list[str], name: str) -> DataFrame:
        r = of.groupBy("field", *keys).agg(*sums).where((F.col("ends") > 0) & (F.col("all") >= p.support))
        few = F.col("all") * p.rate <= 1  # one end is a usual one here
        return r.select("field", *keys, F.struct(*[F.struct((F.col(c) / F.col("all")).alias("rate"), (few & (F.col(c) <= 1)).alias("own")).alias(c) for c in ("ends", "open")]).alias(name))

    ends = known.where("ends > 0").select("field", "kind", "w", "s", "rare", "s2", "s1", "r_word").distinct()
    for of, keys, name in ((known, ["kind", "s"], "r_kind"), (by_shape, ["s"], "r_three"), (by_shape, ["s2"], "r_two"), (by_shape, ["s1"], "r_one")):
        ends = ends.join(rate(of, keys, name), ["field", *keys], "left")
    contexts = [F.col(c) for c in ("r_kind", "r_three", "r_two", "r_one")]

    def rate_at(shapes: Callable[[str], Column]) -> Column:
        found = F.when(F.col("rare"), shapes("open")).otherwise(F.greatest(F.coalesce("r_word", F.lit(0.0)), F.coalesce(shapes("ends"), F.lit(0.0))))
        return F.coalesce(found, F.lit(1.0))

    # a text's own end, alone among few uses, would acquit itself: a wider context of two tokens or more is asked then
    marked = rate_at(lambda c: F.coalesce(*contexts)[c]["rate"])
    others = rate_at(lambda c: F.coalesce(*[F.when(~x[c]["own"], x[c]["rate"]) for x in contexts[:3]], F.coalesce(*contexts)[c]["rate"]))
    ends = ends.select("field", "kind", "w", "s", "rare", others.alias("others"), marked.alias("marked"))

    least = F.when(F.col("marker") == 2, p.marker_rate).when(F.col("marker") == 1, p.ellipsis_rate).otherwise(p.rate)
    judged = counted.where("last").join(ends, ["field", "kind", "w", "s", "rare"], "left").withColumn("rate", F.when(F.col("marker") == 0, F.col("others")).otherwise(F.col("marked")))
    cut = (F.col("marker") == 3) | ((F.col("rate") < least) & (F.pmod("s", F.lit(1 << 20)) != EMPTY))
    return judged.select("field", "record_id", "source", F.col("rate").alias("ends_at_rate"), F.coalesce(cut, F.lit(False)).alias("truncated"))


#: The shape of the sign that stands before a text: the last token of a text without tokens.
EMPTY = 64 + 2


def report(judged: DataFrame) -> DataFrame:
    """How often each source truncates: field, source, texts, truncated, share. Copies of a record count once."""
    once = judged.groupBy("field", "source", "record_id").agg(F.max("truncated").alias("truncated"))
    out = once.groupBy("field", "source").agg(F.count("*").alias("texts"), F.sum(F.col("truncated").cast("long")).alias("truncated"))
    return out.withColumn("share", F.round(F.col("truncated") / F.col("texts"), 6))
