"""Sharding by extendible hashing, in DataFrame functions only.

A row's hash has 60 bits, from the md5 of its id and text. A directory is indexed by hash-prefix bits; a bucket
that is over the byte limit is split on one more bit, others stay, so several directory entries may point to
one bucket. Bytes are summed once for each entry of a directory that is a few bits deeper than the data
needs; all levels above follow from those sums, and only what is still over the limit goes on to a deeper directory.

A shard is over the limit only if it is one row that is over it alone. Whole repeats of a row are one row with a count until the
end. They have one hash, so no bit divides them; they are dealt to numbered parts that fit. Null text counts as empty, null ids
are ids like another; an empty table gives no rows; texts of any length are taken whole; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import checkpointed

BITS = 60


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, bytes, hash and n: how often the row is there."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("bytes"), F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long").alias("hash"))
    return rows.groupBy("doc_id", "bytes", "hash").agg(F.count("*").alias("n"))


def prefix(bits) -> F.Column:
    """The first ``bits`` bits of the hash."""
    return F.expr(f"shiftright(hash, {BITS - bits})") if isinstance(bits, int) else F.call_function("shiftright", F.col("hash"), F.lit(BITS) - bits)


def directory(rows: DataFrame, base: int, depth: int, byte_limit: int) -> DataFrame:
    """entry (a prefix of ``depth`` bits), bits and first (the bucket's prefix length and value), bytes, rows, whole (it
    can stay), alike (all its rows have one hash). Buckets have at least ``base`` bits."""
    cells = rows.groupBy(prefix(depth).alias("entry")).agg(F.sum(F.col("bytes") * F.col("n")).alias("bytes"), F.sum("n").alias("rows"), F.min("hash").alias("low"), F.max("hash").alias("high"))
    up = cells.withColumn("bits", F.explode(F.sequence(F.lit(base), F.lit(depth))))
    up = up.withColumn("first", F.call_function("shiftright", "entry", F.lit(depth) - F.col("bits")))
    nodes = up.groupBy("bits", "first").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))
    nodes = nodes.withColumn("alike", F.col("low") == F.col("high")).withColumn("whole", (F.col("bytes") <= byte_limit) | F.col("alike"))
    parents = nodes.filter(~F.col("whole") & (F.col("bits") < depth)).select((F.col("bits") + 1).alias("bits"), F.explode(F.array(F.col("first") * 2, F.col("first") * 2 + 1)).alias("first"))
    split = nodes.join(parents, ["bits", "first"], "left_semi").unionByName(nodes.filter(F.col("bits") == base))
    leaves = split.filter(F.col("whole") | (F.col("bits") == depth))
    span = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(depth) - F.col("bits"))
    entries = F.sequence(F.col("first") * span, (F.col("first") + 1) * span - 1)
    return leaves.select(F.explode(entries).alias("entry"), "bits", "first", "bytes", "rows", "whole", "alike")


def repeated(rows: DataFrame, at_once: int = 4096) -> DataFrame:
    """Each row n times, with its number i; a row that is there very often is dealt to several tasks."""
    few = rows.filter(F.col("n") <= at_once).withColumn("i", F.explode(F.expr("sequence(0L, n - 1)")))
    many = rows.filter(F.col("n") > at_once).withColumn("lot", F.explode(F.expr(f"sequence(0L, (n - 1) div {at_once}L)"))).repartition("doc_id", "hash", "lot")
    return few.unionByName(many.withColumn("i", F.explode(F.expr(f"sequence(lot * {at_once}L, least(n, (lot + 1) * {at_once}L) - 1)"))).drop("lot"))


def assign(docs: DataFrame, byte_limit: int, id_col: str = "doc_id", text_col: str = "text", spare_bits: int = 4) -> DataFrame:
    """One row per input row: doc_id, bytes, bits, shard (the bucket's prefix as 0 and 1), part, shard_bytes, shard_rows."""
    rest = checkpointed(hashed(docs, id_col, text_col))
    total = rest.agg(F.sum(F.col("bytes") * F.col("n"))).first()[0] or 0
    step = min(24, max(1, math.ceil(math.log2(max(1, total / byte_limit)))) + spare_bits)
    base, done = 0, []
    while True:
        depth = min(BITS, base + step)
        found = checkpointed(directory(rest, base, depth, byte_limit))
        dealt = rest.withColumn("entry", prefix(depth)).join(found.withColumnsRenamed({"bytes": "shard_bytes", "rows": "shard_rows"}), "entry")
        done.append(dealt.filter("whole"))
        if depth == BITS or found.filter("NOT whole").isEmpty():
            break
        rest = checkpointed(dealt.filter("NOT whole").select("doc_id", "bytes", "hash", "n"))
        base, step = depth, spare_bits
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    rows = rows.withColumn("shard", F.when(F.col("bits") == 0, "").otherwise(F.lpad(F.bin("first"), F.col("bits"), F.lit("0"))))
    # repeats of one row that are over the limit together: as many copies to a part as fit
    over = F.col("alike") & (F.col("shard_bytes") > byte_limit) & (F.col("shard_rows") > 1)
    room = F.when(over, F.greatest(F.lit(1), F.expr(f"{int(byte_limit)}L div bytes"))).otherwise(F.col("shard_rows"))
    rows = repeated(rows.withColumn("room", room)).withColumn("part", F.when(over, F.expr("i div room")).otherwise(F.lit(0).cast("long")))
    held = F.when(over, F.least("room", F.col("shard_rows") - F.col("part") * F.col("room"))).otherwise(F.col("shard_rows"))
    size = F.when(over, held * F.col("bytes")).otherwise(F.col("shard_bytes"))
    return rows.select("doc_id", "bytes", "bits", "shard", "part", size.alias("shard_bytes"), held.alias("shard_rows"))


def write_shards(docs: DataFrame, byte_limit: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents to one folder per shard and part. Ids must be unique here, as rows are matched by id."""
    where = assign(docs, byte_limit, id_col, text_col).select(F.col("doc_id").alias(id_col), F.concat_ws("-", F.concat(F.lit("s"), "shard"), "part").alias("shard"))
    docs.join(where, id_col).repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)
