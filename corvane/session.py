"""Session helpers shared by entry points, bench and tests."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "16g") -> SparkSession:
    """A local session with the settings every job expects (UTC, AQE, dynamic overwrite)."""
    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corvane")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_code(spark: SparkSession) -> None:
    """Let Python workers of a session that was started elsewhere import this package."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)


#: Spark's bound on the bytes of an Arrow batch, and what texts keep to.
BATCH_BYTES, TEXT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20)


def text_batches(spark: SparkSession) -> None:
    """Texts go to Python workers some 2 MB at a time, unless the session has a bound of its own: Spark's 10,000 rows or 64 MB would lie
    in the JVM and in the worker of each task at once."""
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, TEXT_BATCH)


@contextmanager
def counted_batches(spark: SparkSession):
    """For an action on many rows of few bytes: Arrow batches end by their number of rows only. Spark would measure a batch after each row, which takes
    far longer than such a row."""
    given = spark.conf.get(BATCH_BYTES) if BATCH_BYTES in spark.conf.getAll else None
    spark.conf.set(BATCH_BYTES, str(2**31 - 1))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, given) if given is not None else spark.conf.unset(BATCH_BYTES)


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """The session's ``spark.checkpoint.dir``, which driver and executors share. Where it is unset a local session gets a temporary
    folder; on a cluster that would be no shared folder, so it is an error there."""
    if folder := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix=prefix)


#: Tables of long texts: work on a row takes far longer than its reading.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def spread(df):
    """A table that makes no more splits than there are cores may lie in one row group, which a single task would work on: its rows are dealt to all
    cores. Larger tables stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 1 < cores and df.rdd.getNumPartitions() <= cores else df


def checkpointed(df):
    """Cut the lineage: the rows are written to the checkpoint folder that all executors share."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession, "spark-checkpoint-"))
    return df.checkpoint(eager=True)
