"""Rate limits whose counters grow with accepted events only, over whole tables.

A limit of 0 is no limit. Windows nest: minutes and address windows lie within days. So what a day can accept are the first events of
each of its smaller windows, and of those the first of the day. Every step is a rank with a bound, which Spark cuts in each task before its shuffle:
of a window in which very many events fall, no task sends more than the limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MINUTES_OF_DAY = 24 * 60


def first_of(events: DataFrame, keys: list, n: int, order: list, rank: str = "__n") -> DataFrame:
    """The first n rows of each key in the given order, with their rank in it (null without a limit)."""
    if not n:
        return events.withColumn(rank, F.lit(None).cast("int"))
    return events.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def over_limit(events: DataFrame, user: str, per_minute: int, per_day: int, ts: str = "timecreated", key: str = "messageid") -> DataFrame:
    """Add denied: whether a user's limit of accepted events by minute or day was reached. ``key`` tells events apart, and orders those of
    one time."""
    order = [ts, key]
    thin = events.select(user, ts, key)
    could = first_of(thin, [user, F.date_trunc("minute", F.col(ts))], per_minute, order).drop("__n")
    passed = first_of(could, [user, F.to_date(ts)], per_day, order).select(key, F.lit(False).alias("denied"))
    return events.join(passed, key, "left").withColumn("denied", F.coalesce("denied", F.lit(True)))


def visitor_limits(visits: DataFrame, minutes: int, per_address: int, per_day: int, ts: str = "timecreated", key: str = "visitid") -> DataFrame:
    """visitid, address, outcome and notice. A visit is denied by its ``address`` if that has ``per_address`` accepted visits in the window of
    ``minutes`` (a divisor of a day), else by the site's ``cap`` if the day has ``per_day`` accepted ones, else ``accepted``. The first visit
    that the cap denies raises the day's one notice. Visits denied by either count for neither."""
    if minutes <= 0 or MINUTES_OF_DAY % minutes:
        raise ValueError("minutes must divide a day")
    window = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / (minutes * 60))
    thin = visits.select(F.col(key).alias("visitid"), "address", F.col(ts).alias("at"), window.alias("window"), F.to_date(ts).alias("day"))
    could = first_of(thin, ["address", "window"], per_address, ["at", "visitid"]).drop("__n")
    # one rank more than the cap: the visit that raises the notice
    ranked = first_of(could, ["day"], per_day + 1 if per_day else 0, ["at", "visitid"], "nth").withColumn("over", F.coalesce(F.col("nth") > (per_day or 0), F.lit(False)))
    used = ranked.filter("NOT over").groupBy("address", "window").agg(F.count("*").alias("used"))
    marks = ranked.select("visitid", "over")
    full = F.coalesce(F.col("used") >= per_address, F.lit(False)) if per_address else F.lit(False)
    rows = thin.join(marks, "visitid", "left").join(used, ["address", "window"], "left")
    outcome = F.when(F.col("over") == F.lit(False), "accepted").when(full, "address").otherwise("cap")
    return rows.select("visitid", "address", outcome.alias("outcome"), F.coalesce("over", F.lit(False)).alias("notice"))
