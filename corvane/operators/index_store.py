"""A chunk index kept up to date in place: Parquet folders by hash bucket, of which a change rewrites only those it touches.

A document of a course is one key (courseid, contenthash); its chunks lie in one bucket. Rows of touched buckets are read, changed and written
back by dynamic partition overwrite, so files of other buckets stay as they are. Every change is a function of the store's rows and the given
ones: done twice, it leaves the same rows, so a batch that was lost half-way is done again. A bucket holds one row without key, so that one
which loses all its chunks is still overwritten."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import checkpointed

KEY = ["courseid", "contenthash"]
META = ["filename", "citable"]
SCHEMA = "courseid long, contenthash string, filename string, citable boolean, version long, chunkindex long, content string, embedding array<double>, embeddingmodel string, sweep long"
Chunker = Callable[[DataFrame], DataFrame]


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = 64) -> ChunkStore:
        """An empty store. About as many rows of text as fit a task should fall in a bucket at the size the index will have."""
        store = cls(spark, path, buckets)
        store._write(spark.range(buckets).select(F.col("id").cast("int").alias("bucket")), spark.createDataFrame([], SCHEMA))
        return store

    def bucket(self):
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def stored(self) -> DataFrame:
        return self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(self.path)

    def read(self) -> DataFrame:
        """All chunks."""
        return self.stored().filter("contenthash IS NOT NULL").drop("bucket")

    def _write(self, touched: DataFrame, rows: DataFrame) -> None:
        marks = touched.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields), "bucket")
        whole = rows.withColumn("bucket", self.bucket()).unionByName(marks)
        whole.repartition(min(self.buckets, 1024), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def _touched(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys: numbers, as many as there are buckets at most."""
        return [r["bucket"] for r in keys.select(self.bucket().alias("bucket")).distinct().collect()]

    def _rewrite(self, touched: list[int], change: Callable[[DataFrame], DataFrame]) -> None:
        if touched:
            old = self.stored().filter(F.col("bucket").isin(touched) & F.col("contenthash").isNotNull()).drop("bucket")
            self._write(self.spark.createDataFrame([(b,) for b in touched], "bucket int"), change(old))

    def documents(self) -> DataFrame:
        """courseid, contenthash, filename, citable and version of what is indexed: reads no text."""
        return self.read().filter("chunkindex = 0").select(*KEY, *META, "version")

    def changes(self, files: DataFrame, version: int, whole: bool) -> DataFrame:
        """The given files (of each key one) with their action: add, rebuild (cut by another version), update (other metadata), delete (marked by a
        column ``gone``; with ``whole``, also what is indexed and not given) or keep."""
        gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in files.columns else F.lit(False)
        new = files.select(*KEY, *META, "text", gone.alias("gone"))
        old = self.documents().select(*KEY, *(F.col(c).alias(f"old_{c}") for c in META), F.col("version").alias("had"))
        both = new.withColumn("given", F.lit(True)).join(old, KEY, "full" if whole else "left")
        same = F.lit(True)
        for c in META:
            same &= F.col(c).eqNullSafe(F.col(f"old_{c}"))
        absent = F.col("given").isNull() | F.col("gone")
        action = F.when(absent, F.when(F.col("had").isNull(), "keep").otherwise("delete")).when(F.col("had").isNull(), "add").when(F.col("had") != version, "rebuild").when(same, "keep").otherwise("update")
        return both.select(*KEY, *META, "text", action.alias("action"))

    def apply(self, files: DataFrame, chunker: Chunker, version: int, whole: bool = False) -> None:
        """Bring the index up to date with changed files, or with the ``whole`` listing. ``chunker``: files to their (courseid, contenthash,
        chunkindex, content); where it leaves the other columns, chunks aren't joined with them. Vectors of chunks that stay are kept, also where metadata change."""
        todo = checkpointed(self.changes(files, version, whole).filter("action <> 'keep'"))
        cut = todo.filter("action IN ('add', 'rebuild')")
        fresh = chunker(cut.select(*KEY, *META, "text"))
        if not set(META) <= set(fresh.columns):
            fresh = fresh.join(cut.select(*KEY, *META), KEY)
        none = {"embedding": "array<double>", "embeddingmodel": "string", "sweep": "long"}
        fresh = fresh.withColumn("version", F.lit(version).cast("long")).withColumns({c: F.lit(None).cast(t) for c, t in none.items()})

        def change(old: DataFrame) -> DataFrame:
            marked = old.join(todo.select(*KEY, "action", *(F.col(c).alias(f"new_{c}") for c in META)), KEY, "left")
            stay = marked.filter("action IS NULL OR action = 'update'")
            meta = {c: F.when(F.col("action").isNull(), F.col(c)).otherwise(F.col(f"new_{c}")) for c in META}
            return stay.withColumns(meta).select(*old.columns).unionByName(fresh.select(*old.columns))

        self._rewrite(self._touched(todo), change)

    def sink(self, chunker: Chunker, version: int):
        """For foreachBatch: files that arrive (with ``gone`` for deleted ones). A batch that is done again changes nothing."""
        return lambda batch, batch_id: self.apply(batch, chunker, version)

    def pending(self, model: str) -> DataFrame:
        return self.read().filter(F.col("embedding").isNull() | ~F.col("embeddingmodel").eqNullSafe(F.lit(model)))

    def sweep(self, vectors: DataFrame, model: str, run: int, most: int = 50) -> int:
        """Give vectors (courseid, contenthash, chunkindex, vector; rounded to six decimals) to pending chunks of the first ``most`` courses that
        have any, in their order; the next run goes on with what is then pending. Returns how many courses were taken.
        Rows that ``vectors`` reads from the store itself must be read anew for every run."""
        due = self.pending(model)
        courses = [r["courseid"] for r in due.select("courseid").distinct().orderBy("courseid").limit(most).collect()]
        taken = F.col("courseid").isin(courses)
        new = vectors.filter(taken).select(*KEY, "chunkindex", F.transform("vector", lambda x: F.round(x.cast("double"), 6)).alias("new"))

        def change(old: DataFrame) -> DataFrame:
            # chunks of other courses meet no vector: their content isn't shuffled for one
            of = F.coalesce(taken, F.lit(False))
            rows = old.filter(of).join(new, [*KEY, "chunkindex"], "left").unionByName(old.filter(~of), allowMissingColumns=True)
            use = F.col("new").isNotNull() & (F.col("embedding").isNull() | ~F.col("embeddingmodel").eqNullSafe(F.lit(model)))
            given = {"embedding": F.col("new"), "embeddingmodel": F.lit(model), "sweep": F.lit(run).cast("long")}
            return rows.withColumns({c: F.when(use, v).otherwise(F.col(c)) for c, v in given.items()}).select(*old.columns)

        if courses:
            self._rewrite(self._touched(due.filter(taken).select(*KEY).distinct()), change)
        return len(courses)
