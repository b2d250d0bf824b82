"""Document fingerprints: bottom-k sketches of hashed word shingles, in DataFrame functions only.

A sketch is the sorted array of the ``k`` smallest distinct hashes (48 bits) of a text's shingles: ``SHINGLE`` words
in a row, or the whole sequence if it is shorter. Sketches of parts merge into the sketch of the whole, and
two sketches estimate resemblance, containment and the number of distinct shingles; below ``k`` shingles all of it is exact.

Words are lower-cased (A-Z) and separated by white space. Null text counts as empty: an empty sketch, which is like
another empty sketch (1.0) and unlike any other (0.0). Equal texts have equal sketches; repeated rows give repeated rows, an empty
table gives no rows, texts of any length are taken whole, and extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import words_of

SHINGLE, K = 5, 128
SPAN = 1 << 48


def with_sketch(df: DataFrame, text_col: str, out: str, k: int = K, words: int = SHINGLE) -> DataFrame:
    """Add the sketch of a text column. Narrow; steps are columns of their own so that none is computed twice."""
    df = df.withColumn("__h", F.transform(words_of(F.col(text_col)), lambda w: F.xxhash64(w)))
    h, n = F.col("__h"), F.size("__h")
    long = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(words))).bitwiseAND(SPAN - 1))
    short = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h).bitwiseAND(SPAN - 1)))
    df = df.withColumn("__s", F.when(n >= words, long).otherwise(short))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct("__s")), 1, k)).drop("__h", "__s")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A or B|: the share of the union's k smallest hashes that both have."""
    both = F.size(F.array_intersect(F.array_intersect(merge(a, b, k), a), b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(merge(a, b, k)), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k, else (k - 1) / the k-th smallest hash as a share of the hash range."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(SPAN) / F.greatest(F.element_at(a, -1), F.lit(1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A|."""
    j = resemblance(a, b, k)
    both = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / F.greatest(distinct_shingles(a, k), F.lit(1.0))))


def as_text(a: Column) -> Column:
    """Twelve hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 12, "0"))), "")


def with_bucket(rows: DataFrame, rows_per_bucket: int, ranges: int = 512) -> DataFrame:
    """Add bucket: rows with a higher one come first in descending order of ids (null ids last, rows of one id by text hash).

    Ids are cut at ``ranges`` approximate quantiles, and each range into equal widths of about ``rows_per_bucket`` rows, so
    however ids lie, a bucket has little more than one in ``ranges`` of the rows. Ids that are quantiles more than once, and null, have
    very many rows each: these are cut by their texts' hashes."""
    n, nulls, low, high, found = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()
    each, found = max(1.0, (n - nulls) / ranges / rows_per_bucket), found or []
    cuts = sorted(set(found))
    hot = {c: math.ceil((found.count(c) + 1) * each) for c in cuts if found.count(c) > 1}
    lows, highs = [low or 0, *cuts], [*cuts, high or 0]
    width = [max(1, math.ceil((y - x + 1) / each)) for x, y in zip(lows, highs, strict=True)]
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs)) if xs else F.array().cast("array<long>")
    df = rows.withColumn("__r", F.size(F.filter(longs(cuts), lambda x: x <= F.col("doc_id"))))
    df = df.withColumn("__hot", F.col("doc_id").isNull() | F.col("doc_id").isin(*hot) if hot else F.col("doc_id").isNull())
    parts = F.when(F.col("doc_id").isNull(), F.lit(math.ceil(nulls / rows_per_bucket) or 1)).otherwise(F.element_at(longs([1, *(hot.get(c, 1) for c in cuts)]), F.col("__r") + 1)).cast("long")
    df = df.withColumn("__parts", parts)
    by_hash = F.col("__parts") - 1 - F.shiftright((F.shiftright(F.xxhash64("text"), 33) + (1 << 30)) * F.col("__parts"), 31)
    at = F.col("__r") + 1
    by_width = F.floor((F.col("doc_id") - F.element_at(longs(lows), at)) / F.element_at(longs(width), at))
    first = F.when(F.col("doc_id").isNull(), 0).otherwise(2 * F.col("__r") + F.when(F.col("__hot"), 2).otherwise(3)).cast("long")
    return df.withColumn("bucket", F.shiftleft(first, 40) + F.when(F.col("__hot"), by_hash).otherwise(by_width).cast("long")).drop("__r", "__hot", "__parts")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 256) -> DataFrame:
    """doc_id, text and next_text: the text of the next row by descending id (null ids last, equal ids by text hash, then text), after
    the last row the first.

    Rows are dealt to buckets that follow each other; only each bucket's first row looks outside its bucket. Nothing is
    ordered as a whole: buckets are ordered in two levels."""
    rows = with_bucket(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")), rows_per_bucket)
    inside = W.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")
    first = rows.withColumn("nth", F.row_number().over(inside)).filter("nth = 1").select("bucket", F.col("text").alias("first_text"))
    follows = next_bucket(rows.select("bucket").distinct())
    after = follows.join(first.withColumnRenamed("bucket", "next_bucket"), "next_bucket").select("bucket", "first_text")
    led = rows.withColumn("within", F.lead("text").over(inside))
    return led.join(after, "bucket", "left").select("doc_id", "text", F.coalesce("within", "first_text").alias("next_text"))


def next_bucket(buckets: DataFrame, fan: int = 4096) -> DataFrame:
    """bucket and next_bucket: the next lower one, after the lowest the highest; one row for each distinct bucket."""
    b = buckets.withColumn("group", F.expr(f"bucket div {fan}L"))
    within = F.lead("bucket").over(W.partitionBy("group").orderBy(F.desc("bucket")))
    tops = b.groupBy("group").agg(F.max("bucket").alias("top"))
    whole = W.orderBy(F.desc("group"))  # one row for each fan * rows_per_bucket rows of the input
    around = F.first("top").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    tops = tops.withColumn("next_top", F.coalesce(F.lead("top").over(whole), around))
    return b.withColumn("within", within).join(tops, "group").select("bucket", F.coalesce("within", "next_top").alias("next_bucket"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text, of its edited text (its last third replaced from the next document) and their likeness."""
    rows = with_next(docs, id_col, text_col)
    n = F.char_length("text")
    third = F.floor(n / 3)
    rows = rows.withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    for text, sketch in (("text", "a"), ("edited", "b"), ("next_text", "c")):
        rows = with_sketch(rows, text, sketch, k)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("a")).alias("fingerprint"),
        as_text(F.col("b")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("b"), k).alias("near_edited"),
        resemblance(F.col("a"), F.col("c"), k).alias("near_next"),
        distinct_shingles(F.col("a"), k).alias("n_shingles"),
        containment(F.col("a"), F.col("b"), k).alias("kept"),
    )
