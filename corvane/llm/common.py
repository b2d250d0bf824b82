"""Small helpers of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import shared_folder

#: White space that separates words: space, tab, newline, vertical tab, form feed, carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the checkpoint folder that all executors share."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession, "spark-checkpoint-"))
    return df.checkpoint(eager=True)


def words_of(text):
    """Column of lower-cased (A-Z only) words between SPACES; an empty array for null or blank text."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, SPACES), lambda w: w != "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
