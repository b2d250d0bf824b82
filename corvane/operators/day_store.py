"""Facts by day: Parquet folders by date, of which a batch or a purge rewrites only those it touches, and a scan reads only those it asks for.

A batch's rows carry its number; written again, they replace what that batch had left. A day's folder is rewritten as a whole, so closed days
lie in few files. A purge rewrites the day of its cutoff and empties the days before (an emptied day keeps one row without key, as a
folder that gets no row would not be overwritten); files of later days stay as they are."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = "daterecorded"
#: Tasks that write a day.
SPREAD = 4


class DayStore:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "messageid", ts: str = "timecreated", rows_per_file: int = 5_000_000):
        """``schema``: of the facts, without day and batch; ``key`` is never null in them."""
        self.spark, self.path, self.key, self.ts, self.rows_per_file = spark, path, key, ts, rows_per_file
        self.schema = T.StructType([*schema.fields]).add("batch", "long").add(DAY, "date")

    def stored(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def read(self, first: str | dt.date | None = None, last: str | dt.date | None = None) -> DataFrame:
        """Facts of the days in [first, last]; other days' folders aren't opened."""
        rows = self.stored().filter(F.col(self.key).isNotNull()).drop("batch")
        for bound, inside in ((first, F.col(DAY) >= F.lit(first).cast("date")), (last, F.col(DAY) <= F.lit(last).cast("date"))):
            rows = rows if bound is None else rows.filter(inside)
        return rows

    def _write(self, rows: DataFrame) -> None:
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema.fields))
        rows = rows.repartition(DAY, F.pmod(F.xxhash64(self.key), F.lit(SPREAD)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", self.rows_per_file).partitionBy(DAY).parquet(self.path)

    def append(self, rows: DataFrame, batch: int) -> list[dt.date]:
        """Add a batch's facts to their days, late ones included; returns these days (as many as the batch has, few of a stream)."""
        new = rows.withColumns({DAY: F.to_date(self.ts), "batch": F.lit(batch).cast("long")}).select(*self.schema.names)
        days = sorted(r[DAY] for r in new.select(DAY).distinct().collect())
        if days:
            old = self.stored().filter(F.col(DAY).isin(days) & F.col(self.key).isNotNull() & (F.col("batch") != batch))
            self._write(old.unionByName(new))
        return days

    def purge(self, cutoff: str) -> list[dt.date]:
        """Drop facts from before the cutoff; returns the days that were rewritten. Days that are empty already are left alone."""
        at = F.lit(cutoff).cast("timestamp_ntz")
        due = self.stored().filter((F.col(DAY) <= F.to_date(at)) & F.col(self.key).isNotNull() & (F.col(self.ts) < at))
        days = sorted(r[DAY] for r in due.select(DAY).distinct().collect())
        if days:
            kept = self.stored().filter(F.col(DAY).isin(days) & F.col(self.key).isNotNull() & (F.col(self.ts) >= at))
            marks = self.spark.createDataFrame([(d,) for d in days], f"{DAY} date")
            self._write(kept.unionByName(marks, allowMissingColumns=True))
        return days
