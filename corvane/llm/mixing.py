"""Mixing sources to target weights.

Each source's texts, one after another, are packed into blocks of ``block_words`` words. A target share for each
source becomes a number of slots; slots are dealt to output shards by multinomial draws from what each source still
has to give, so each source ends at its number exactly. A source's slot j takes the block that a pseudorandom
permutation of the source's block indices gives for j (a new permutation whenever all blocks were taken), and
slots meet blocks in a join by index. Everything follows from ``seed``: reruns agree.

Sources go by code point, null last. Up to ``MOST_SOURCES`` of them are drawn on the driver, which then holds a row for each source and shard.
More are numbered, weighed and capped in DataFrames (the driver gets sums and a row for each ``PER_GROUP`` sources): a group's slots are drawn first, then
its sources' within it, which is the same distribution.

A null text has no words, a document without words takes no part and gets 0; repeated rows are documents of their own, and those that
tie in a source's order are equal in id, text and size. Texts of any length are taken whole. An empty table gives no rows; extra columns
are ignored, or kept by ``drawn_texts``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import checkpointed
from corvane.session import text_batches

WORD = r"[^\x20\x09-\x0D]+"
MOST_SOURCES = 10_000
PER_GROUP = 5_000
#: Slots of a source that one row stands for until they are told apart.
SLOTS = 100_000


def targets(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Share the sum of all sizes by weight; a source stops at ``cap`` times its size and the excess is shared anew."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight > cap * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def draw(quotas: np.ndarray, shards: int, seed: int, sizes: np.ndarray | None = None) -> np.ndarray:
    """[shard, source] slots: multinomial draws from what is left of the quotas, which the last shard completes. ``sizes``: slots of each shard,
    which make up the quotas; else shards are alike."""
    rng = np.random.Generator(np.random.Philox(seed))
    left, out = quotas.astype(np.int64).copy(), np.zeros((shards, len(quotas)), dtype=np.int64)
    for s in range(shards):
        n = int(sizes[s]) if sizes is not None else int(left.sum()) if s == shards - 1 else int(round(left.sum() / (shards - s)))
        while n > 0:  # what a draw gives beyond a source's rest is drawn again
            got = np.minimum(rng.multinomial(n, left / left.sum()), left)
            out[s] += got
            left -= got
            n -= int(got.sum())
            if not left.sum():
                break
    return out


SOURCES = "src int, source string, source_size long, target double, blocks long, quota long, dealt array<long>"


def few_sources(per: DataFrame, weights: list[float] | None, block_words: int, shards: int, seed: int, cap: float) -> DataFrame:
    """SOURCES of at most MOST_SOURCES sources (source, size): number, target, blocks, slots and the slots of the first 1, 2, ... shards."""
    rows = sorted(per.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["size"] for r in rows]
    goals = targets(sizes, weights or [float(i % 3 + 1) for i in range(len(rows))], cap)
    blocks = [-(-s // block_words) for s in sizes]
    quotas = [min(int(cap * b), round(t / (s / b))) if s else 0 for t, s, b in zip(goals, sizes, blocks, strict=True)]
    dealt = np.cumsum(draw(np.array(quotas, dtype=np.int64), shards, seed), axis=0)
    return per.sparkSession.createDataFrame([(i, r["source"], r["size"], t, b, q, dealt[:, i].tolist()) for i, (r, t, b, q) in enumerate(zip(rows, goals, blocks, quotas, strict=True))], SOURCES)


def numbered(per: DataFrame) -> DataFrame:
    """Add src: the place of a source by code point, null last. Ranges are ordered, and counted, apart."""
    ranged = checkpointed(per.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()))
    first, at = {}, 0
    for r in sorted(ranged.groupBy("part").count().collect()):  # a row for each range
        first[r["part"]], at = at, at + r["count"]
    starts = per.sparkSession.createDataFrame(list(first.items()), "part int, first long")
    nth = F.row_number().over(W.partitionBy("part").orderBy(F.asc_nulls_last("source")))
    return ranged.join(starts, "part").withColumn("src", (F.col("first") + nth - 1).cast("int")).drop("part", "first")


def many_sources(per: DataFrame, weights: list[float] | None, block_words: int, shards: int, seed: int, cap: float) -> DataFrame:
    """The same for any number of sources."""
    spark, rows = per.sparkSession, numbered(per)
    if weights:
        rows = rows.join(spark.createDataFrame(list(enumerate(map(float, weights))), "src int, weight double"), "src")
    else:
        rows = rows.withColumn("weight", (F.col("src") % 3 + 1).cast("double"))
    rows = checkpointed(rows)
    total, level = float(rows.agg(F.sum("size")).first()[0]), 0.0
    while True:  # words for a unit of weight: rises as sources stop at their cap
        over = F.col("weight") * level > cap * F.col("size")
        used, weight = rows.agg(F.sum(F.when(over, cap * F.col("size")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        after = (total - used) / weight if weight else level
        if after <= level:
            break
        level = after
    rows = rows.withColumn("target", F.least(F.col("weight") * level, cap * F.col("size"))).withColumn("blocks", F.ceil(F.col("size") / block_words).cast("long"))
    mean = F.col("size") / F.greatest(F.col("blocks"), F.lit(1))
    quota = F.when(F.col("size") > 0, F.least(F.floor(cap * F.col("blocks")), F.rint(F.col("target") / mean))).otherwise(0).cast("long")
    rows = checkpointed(rows.withColumn("quota", quota).withColumn("g", F.expr(f"src div {PER_GROUP}L")))
    groups = sorted((r["g"], r["q"]) for r in rows.groupBy("g").agg(F.sum("quota").alias("q")).collect())
    drawn = draw(np.array([q for _, q in groups], dtype=np.int64), shards, seed)
    by_group = spark.createDataFrame([(g, drawn[:, i].tolist()) for i, (g, _) in enumerate(groups)], "g long, sizes array<long>")
    schema = T.StructType.fromDDL(SOURCES)
    names = schema.names

    def within(table: pa.Table) -> pa.Table:
        table = table.sort_by("src")
        sizes, g = table.column("sizes")[0].as_py(), table.column("g")[0].as_py()
        dealt = np.cumsum(draw(table.column("quota").to_numpy(), shards, seed + 1 + g, np.array(sizes)), axis=0)
        return table.append_column("dealt", pa.array(dealt.T.tolist(), pa.list_(pa.int64()))).select(names)

    whole = rows.withColumnRenamed("size", "source_size").select("g", *names[:-1]).join(by_group, "g")
    return checkpointed(whole.groupBy("g").applyInArrow(within, schema))


def permute(j: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Index j of range(n) under a keyed permutation: a four-round Feistel network with cycle walking."""
    half = np.maximum(1, np.ceil(np.ceil(np.log2(np.maximum(2, n))) / 2)).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    x, todo = j.astype(np.uint64), np.ones(len(j), dtype=bool)
    while todo.any():
        left, right = x[todo] >> half[todo], x[todo] & low[todo]
        for r in range(4):
            f = (right + key[todo] + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & low[todo])
        x[todo] = (left << half[todo]) | right
        todo[todo] = x[todo] >= n[todo].astype(np.uint64)
    return x.astype(np.int64)


class Mix:
    """Targets and draws for the documents of a table, and the DataFrames that follow from them."""

    def __init__(self, docs: DataFrame, weights: list[float] | None = None, block_words: int = 64, shards: int = 64, seed: int = 1, cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows_per_bucket: int = 4000):
        self.block_words, self.seed = block_words, seed
        spark = docs.sparkSession
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text_col).alias("hash"))
        per = checkpointed(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
        count, n = per.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        form = few_sources if count <= MOST_SOURCES else many_sources
        self.sources = form(per.select("source", "size"), weights, block_words, shards, seed, cap)
        info = self.sources.select("src", "source", "source_size", "target")
        buckets = max(1, n // rows_per_bucket)
        rows = rows.join(info, rows["source"].eqNullSafe(info["source"]), "left").drop(info["source"])
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(buckets)))
        before = F.sum("size").over(W.partitionBy("src", "bucket").orderBy("doc_id", "hash", "size").rowsBetween(W.unboundedPreceding, -1))
        rows = rows.withColumn("inside", F.coalesce(before, F.lit(0)))
        sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("all")) if buckets > 1 else None
        if sums is None:
            rows = rows.withColumn("start", F.col("inside"))
        else:
            offset = F.coalesce(F.sum("all").over(W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            rows = rows.join(sums.select("src", "bucket", offset.alias("offset")), ["src", "bucket"]).withColumn("start", F.col("offset") + F.col("inside"))
        #: doc_id, source, size, hash (of the text), src, source_size, target, start (words of the source before this document)
        self.rows = checkpointed(rows.drop("bucket", "inside", "offset"))
        self.spark, self.docs, self.id_col, self.text_col, self.source_col = spark, docs, id_col, text_col, source_col

    def segments(self) -> DataFrame:
        """src, block, start, from_word, to_word: the parts of documents that lie in each block (words from the document's first)."""
        b = self.block_words
        whole = self.rows.filter("size > 0").select("src", "start", "size", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")).alias("block"))
        return whole.select("src", "block", "start", F.greatest(F.lit(0), F.col("block") * b - F.col("start")).alias("from_word"), F.least("size", (F.col("block") + 1) * b - F.col("start")).alias("to_word"))

    def slots(self) -> DataFrame:
        """src, block, pass, shard: one row for each slot of the mixture.

        Spark takes these rows for as few as the sources that they come from: joins with them say that nothing is to be broadcast."""
        seed = self.seed
        total = self.sources.agg(F.sum("quota")).first()[0] or 0
        rows = self.sources.filter("quota > 0").withColumn("low", F.explode(F.expr(f"sequence(0L, quota - 1, {SLOTS}L)")))
        rows = rows.select("src", "blocks", "low", F.least("quota", F.col("low") + SLOTS).alias("high"), "dealt").repartition(max(1, min(100_000, total // 500_000)), "src", "low")

        def told(src: np.ndarray, blocks: np.ndarray, low: np.ndarray, high: np.ndarray, dealt: list[np.ndarray]) -> pa.RecordBatch:
            size = high - low
            of = np.repeat(np.arange(len(src)), size)
            j = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[of]
            shard = np.concatenate([np.searchsorted(d, np.arange(lo, hi), side="right") for d, lo, hi in zip(dealt, low, high, strict=True)])
            n, source = blocks[of], src[of]
            turn = j // n
            key = (np.uint64(seed) << np.uint64(40)) ^ (source.astype(np.uint64) << np.uint64(8)) ^ turn.astype(np.uint64)
            block = permute(j % n, n, key * np.uint64(0xD6E8FEB86659FD93))
            return pa.RecordBatch.from_arrays([pa.array(source, pa.int32()), pa.array(block, pa.int64()), pa.array(turn, pa.int32()), pa.array(shard, pa.int32())], ["src", "block", "pass", "shard"])

        def run(batches):
            for batch in batches:
                columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
                at = np.r_[0, np.flatnonzero(np.diff(np.cumsum(columns[3] - columns[2]) // (4 * SLOTS))) + 1, batch.num_rows]
                for lo, hi in zip(at[:-1], at[1:], strict=True):
                    if hi > lo:
                        yield told(*(c[lo:hi] for c in columns[:4]), list(columns[4][lo:hi]))

        return rows.mapInArrow(run, "src int, block long, pass int, shard int")

    def taken(self) -> DataFrame:
        """One row per document: doc_id, size, source_size, target, taken, source."""
        times = self.slots().groupBy("src", "block").agg(F.count("*").alias("times"))
        got = self.segments().join(times.hint("merge"), ["src", "block"]).groupBy("src", "start").agg(F.sum(F.col("times") * (F.col("to_word") - F.col("from_word"))).alias("taken"))
        some = self.rows.filter("size > 0").join(got, ["src", "start"], "left")
        none = self.rows.filter("size = 0").withColumn("taken", F.lit(None).cast("long"))
        return some.unionByName(none, allowMissingColumns=True).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")

    def drawn_texts(self) -> DataFrame:
        """The input's columns once for each document and pass that took something of it; the text is cut to what was
        taken. Neighbouring parts keep what stands between their words, others are joined by a newline."""
        text_batches(self.docs.sparkSession)
        part = F.struct("from_word", "to_word")
        got = self.slots().hint("merge").join(self.segments().hint("merge"), ["src", "block"]).groupBy("src", "start", "pass").agg(F.array_sort(F.collect_list(part)).alias("parts"))
        texts = self.docs.withColumn("__hash", F.xxhash64(self.text_col)).withColumn("__copy", F.lit(0))
        rows = self.rows.select("src", "start", "size", "source", F.col("doc_id").alias("__id"), "hash", F.lit(0).alias("copy"))
        same = ["__id", "hash", "source"]
        if not rows.groupBy(*same).count().filter("count > 1").isEmpty():  # whole repeats: number them on both sides
            rows = rows.withColumn("copy", F.row_number().over(W.partitionBy(*same).orderBy("start")))
            own = W.partitionBy(self.id_col, "__hash", self.source_col).orderBy(F.lit(0))
            texts = texts.withColumn("__copy", F.row_number().over(own))
        names = {"__id": "__id", "hash": "__thash", "copy": "__tcopy", "source": "__source", "size": "__size", "pass": "__pass", "parts": "__parts"}
        taken = rows.join(got, ["src", "start"]).select(*(F.col(c).alias(n) for c, n in names.items()))
        match = F.col("__id").eqNullSafe(F.col(self.id_col)) & (F.col("__thash") == F.col("__hash")) & (F.col("__tcopy") == F.col("__copy")) & F.col("__source").eqNullSafe(F.col(self.source_col))
        cut = F.pandas_udf(_cut, T.StringType())
        words = F.aggregate("__parts", F.lit(0).cast("long"), lambda n, p: n + p["to_word"] - p["from_word"])
        out = texts.join(taken, match).withColumn("__whole", words == F.col("__size"))
        text = F.when(F.col("__whole"), F.col(self.text_col)).otherwise(cut(F.when(~F.col("__whole"), F.col(self.text_col)), F.when(~F.col("__whole"), F.col("__parts"))))
        return out.withColumn(self.text_col, text).select(*self.docs.columns)


def _cut(texts, parts):
    import re

    import pandas as pd

    word, out = re.compile(r"[^ \t-\r]+"), []
    for text, some in zip(texts, parts, strict=True):
        if text is None or some is None:
            out.append(None)
            continue
        runs: list[list[int]] = []
        for p in some:
            a, b = p["from_word"], p["to_word"]
            if runs and runs[-1][1] == a:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        spans = [m.span() for m in word.finditer(text)]
        out.append("\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs))
    return pd.Series(out, dtype=object)


# typing only: pandas_udf infers its kind from hints of the pandas types
def _hints():
    import pandas as pd

    _cut.__annotations__ = {"texts": pd.Series, "parts": pd.Series, "return": pd.Series}


_hints()
