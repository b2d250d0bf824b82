"""The same figures as streams. State is keyed and bounded by watermarks; sinks are folders that every executor shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.day_store import DayStore
from corvane.operators.rollup import write_rollup


def read_folder(spark: SparkSession, folder: str, schema, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(stream: DataFrame, sink, checkpoint: str) -> None:
    """Process what is there and stop. ``sink`` gets (batch DataFrame, batch id) and must be idempotent in the id."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def to_folder(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is final to a folder, exactly once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def rollup_sink(facts: str, rollup: str, build, key: str = "messageid"):
    """Add each batch's facts to a day store, then rebuild the days it touches, late ones included, from all their facts.

    Writing a batch twice changes nothing. ``build``: facts (column daterecorded) to rollup rows."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        store = DayStore(batch.sparkSession, facts, batch.schema, key)
        if days := store.append(batch, batch_id):
            write_rollup(build(store.read(days[0], days[-1]).filter(F.col("daterecorded").isin(days))), rollup)

    return sink


def window_counts(events: DataFrame, keys: list[str], size: str, late: str = "1 hour", ts: str = "timecreated") -> DataFrame:
    """Events of each key and tumbling window; works on streams and tables."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(F.col(ts), size)
    return source.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def distinct_tickets(tickets: DataFrame, hours: int, keys: tuple[str, ...] = ("courseid", "userid", "summaryhash")) -> DataFrame:
    """A stream of tickets without those that repeat one within ``hours``."""
    return tickets.withWatermark("timecreated", f"{hours} hours").dropDuplicatesWithinWatermark(list(keys))


def index_files(files: DataFrame, store, chunker, version: int, vectors, model: str, checkpoint: str, most: int = 50) -> None:
    """Bring a chunk store up to date with the files that have arrived, and after each batch give vectors to the pending chunks of the first
    ``most`` courses that have any. ``vectors``: the store to a table of vectors."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        store.apply(batch, chunker, version)
        store.sweep(vectors(store), model, batch_id, most)

    run_available(files, sink, checkpoint)


def sessions(events: DataFrame, user: str, gap: str, ts: str = "timecreated") -> DataFrame:
    """Runs of a user's events with no gap as long as ``gap``."""
    w = F.session_window(ts, gap)
    return events.groupBy(user, w.alias("s")).agg(F.count("*").alias("n")).select(user, F.col("s.start").alias("start"), "n")
