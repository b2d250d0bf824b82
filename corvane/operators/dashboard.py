"""Usage figures from the daily rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.rollup import price_periods, with_prices


def day_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """Days from first to last, both included."""
    return df.filter(F.col("daterecorded").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def course_filter(df: DataFrame, ids: list[int]) -> DataFrame:
    """Only these courses; no ids means no restriction."""
    return df.filter(F.col("courseid").isin(ids)) if ids else df


def courses_matching(courses: DataFrame, name: str, fold) -> DataFrame:
    """Ids of courses whose full or short name holds the name, whatever its case and accents."""
    wanted = fold(F.lower(F.lit(name)))
    hit = fold(F.lower("fullname")).contains(wanted) | fold(F.lower("shortname")).contains(wanted)
    return courses.filter(hit).select("courseid")


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def _sum_if(when: Column, value: str) -> Column:
    return F.coalesce(F.sum(F.when(when, F.col(value))), F.lit(0))


def _totals(stats: DataFrame) -> list[Column]:
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    every = F.lit(True)
    return [
        _sum_if(user, "messages").alias("questions"),
        _sum_if(reply, "messages").alias("answers"),
        _sum_if(every, "errors").alias("errors"),
        _sum_if(every, "prompttokens").alias("prompttokens"),
        _sum_if(every, "completiontokens").alias("completiontokens"),
        _sum_if(every, "totaltokens").alias("totaltokens"),
        F.least(_sum_if(every, "cachedtokens"), _sum_if(every, "prompttokens")).alias("cachedtokens"),
    ]


def overview(msgstats: DataFrame) -> DataFrame:
    return msgstats.agg(*_totals(msgstats))


def reach(userstats: DataFrame, exclude_visitors: bool = False) -> DataFrame:
    """Distinct users and courses with use; all visitors count as the one user 0 unless they are left out."""
    users = userstats.filter("userid <> 0") if exclude_visitors else userstats
    return users.agg(F.countDistinct("userid").alias("activeusers"), F.countDistinct("courseid").alias("activecourses"))


def days_per_user(userstats: DataFrame) -> DataFrame:
    return userstats.groupBy("userid").agg(F.countDistinct("daterecorded").alias("days"))


def recurrent_users(userstats: DataFrame) -> DataFrame:
    return days_per_user(userstats).filter("days >= 2").agg(F.count("*").alias("recurrentusers"))


def conversations_started(conversations: DataFrame, first: str, last: str) -> DataFrame:
    day = F.to_date("timecreated")
    return conversations.filter(day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))).agg(F.count("*").alias("conversations"))


def active_enrolments(enrolments: DataFrame, now: str) -> DataFrame:
    """Enrolments in force: not suspended, begun, and open-ended or not over."""
    day = F.lit(now).cast("date")
    return enrolments.filter(~F.col("suspended") & (F.col("timestart").isNull() | (F.col("timestart") <= day)) & (F.col("timeend").isNull() | (F.col("timeend") > day)))


def exposed_by_course(enrolments: DataFrame, configured: DataFrame, now: str) -> DataFrame:
    live = active_enrolments(enrolments, now).join(configured, "courseid", "left_semi")
    return live.groupBy("courseid").agg(F.countDistinct("userid").alias("enrolled"))


def exposed_participants(enrolments: DataFrame, configured: DataFrame, now: str) -> DataFrame:
    return active_enrolments(enrolments, now).join(configured, "courseid", "left_semi").agg(F.countDistinct("userid").alias("exposed"))


def overview_ratios(msgstats: DataFrame, userstats: DataFrame, conversations: DataFrame, enrolments: DataFrame, configured: DataFrame, first: str, last: str, now: str) -> DataFrame:
    """One row joined from single-row aggregates."""
    parts = [overview(day_range(msgstats, first, last)), reach(day_range(userstats, first, last)), recurrent_users(day_range(userstats, first, last)), conversations_started(conversations, first, last), exposed_participants(enrolments, configured, now)]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(p)
    c = F.col
    return one.select(
        ratio(c("activeusers"), c("exposed")).alias("adoption"),
        ratio(c("recurrentusers"), c("activeusers")).alias("recurrence"),
        ratio(c("errors"), c("answers")).alias("errorrate"),
        ratio(c("questions"), c("activeusers")).alias("questionsperuser"),
        ratio(c("questions"), c("exposed")).alias("questionsperenrolled"),
        ratio(c("questions"), c("conversations")).alias("turnsperconversation"),
        ratio(c("cachedtokens"), c("prompttokens")).alias("cachehitrate"),
    )


def route_breakdown(msgstats: DataFrame) -> DataFrame:
    """Answers by route with their share; a blank route is ``unknown``."""
    route = F.coalesce(F.nullif("route", F.lit("")), F.lit("unknown"))
    by = msgstats.filter("role = 'assistant'").groupBy(route.alias("route")).agg(F.sum("messages").alias("answers"))
    whole = by.agg(F.sum("answers").alias("whole"))  # a few routes: one row
    return by.crossJoin(whole).select("route", "answers", ratio(F.col("answers"), F.col("whole")).alias("share"))


def timeseries(msgstats: DataFrame, userstats: DataFrame, first: str, last: str) -> DataFrame:
    """Questions and distinct users for each day of the range, 0 on days without any."""
    spark = msgstats.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("daterecorded"))
    asked = day_range(msgstats, first, last).filter("role = 'user'").groupBy("daterecorded").agg(F.sum("messages").alias("questions"))
    users = day_range(userstats, first, last).groupBy("daterecorded").agg(F.countDistinct("userid").alias("users"))
    return days.join(asked, "daterecorded", "left").join(users, "daterecorded", "left").select("daterecorded", F.coalesce("questions", F.lit(0)).alias("questions"), F.coalesce("users", F.lit(0)).alias("users"))


def recurrence_histogram(userstats: DataFrame) -> DataFrame:
    """Users by their number of active days; all three buckets always appear."""
    bucket = F.when(F.col("days") >= 4, "4+").when(F.col("days") >= 2, "2-3").otherwise("1")
    found = days_per_user(userstats).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("users"))
    names = userstats.sparkSession.createDataFrame([("1",), ("2-3",), ("4+",)], "bucket string")
    return names.join(found, "bucket", "left").select("bucket", F.coalesce("users", F.lit(0)).alias("users"))


def cost_by_model(msgstats: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost of each model, priced at each day's rate. Unpriced days keep their tokens and clear haspricing."""
    daily = msgstats.groupBy("model", "daterecorded").agg(F.sum("prompttokens").alias("prompt"), F.least(F.sum("cachedtokens"), F.sum("prompttokens")).alias("cached"), F.sum("completiontokens").alias("completion"), F.sum("totaltokens").alias("total"))
    daily = with_prices(daily, price_periods(prices)).filter("total > 0 OR prompt > 0")
    p = F.col("price")
    cost = ((F.col("prompt") - F.col("cached")) * p["input"] + F.col("cached") * p["cached"] + F.col("completion") * p["output"]) / 1e6
    by = daily.withColumn("cost", F.coalesce(cost, F.lit(0.0))).groupBy("model")
    return by.agg(F.sum("prompt").alias("prompttokens"), F.sum("cached").alias("cachedtokens"), F.sum("completion").alias("completiontokens"), F.sum("total").alias("totaltokens"), F.sum("cost").alias("cost"), F.bool_and(p.isNotNull()).alias("haspricing"))


def cost_kpis(msgstats: DataFrame, prices: DataFrame) -> DataFrame:
    costs = cost_by_model(msgstats, prices).agg(F.sum("cost").alias("totalcost"), F.sum("prompttokens").alias("prompt"), F.sum("cachedtokens").alias("cached"))
    one = costs.crossJoin(overview(msgstats).select("questions"))
    return one.select("totalcost", ratio(F.col("totalcost"), F.col("questions")).alias("costperquestion"), ratio(F.col("cached"), F.col("prompt")).alias("cachedshare"))


def tool_breakdown(toolstats: DataFrame) -> DataFrame:
    by = toolstats.groupBy("toolname").agg(*(F.sum(c).alias(c) for c in ("calls", "ok", "fail")))
    return by.withColumn("successrate", ratio(F.col("ok"), F.col("calls")))


def course_rows(msgstats: DataFrame, userstats: DataFrame, courses: DataFrame, enrolled: DataFrame, key: str = "courseid") -> DataFrame:
    """One row per course with use that still exists: users, recurrent users, questions, answers, errors, tokens, adoption."""
    use = msgstats.groupBy(key).agg(*_totals(msgstats)[:3], F.sum("totaltokens").alias("totaltokens"))
    per = userstats.groupBy(key, "userid").agg(F.countDistinct("daterecorded").alias("days"))
    users = per.groupBy(key).agg(F.count("*").alias("users"), F.count(F.when(F.col("days") >= 2, 1)).alias("recurrent"))
    both = use.join(users, key, "full").join(courses, key, "left_semi").join(enrolled, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(
        key,
        *(zero(c).alias(c) for c in ("users", "recurrent", "questions", "answers", "errors", "totaltokens", "enrolled")),
        ratio(zero("errors"), zero("answers")).alias("errorrate"),
        ratio(zero("users"), zero("enrolled")).alias("adoption"),
    )


def platform_rows(msgstats: DataFrame, userstats: DataFrame, site_course: int) -> DataFrame:
    """The site course by block instance, without enrolment."""
    own = lambda df: df.filter(F.col("courseid") == site_course)
    spark = msgstats.sparkSession
    blocks = own(msgstats).select("blockinstanceid").unionByName(own(userstats).select("blockinstanceid")).distinct()
    none = spark.createDataFrame([], "blockinstanceid long, enrolled long")
    return course_rows(own(msgstats), own(userstats), blocks, none, "blockinstanceid")


def scope_rows(courses: DataFrame, platform: DataFrame) -> DataFrame:
    """Course rows and platform rows under one schema."""
    return courses.withColumnRenamed("courseid", "id").withColumn("scope", F.lit("course")).unionByName(platform.withColumnRenamed("blockinstanceid", "id").withColumn("scope", F.lit("platform")))


def busiest_courses(msgstats: DataFrame, enrolled: DataFrame, n: int) -> DataFrame:
    """The n courses with most questions; enrolment is joined to those n only."""
    top = msgstats.filter("role = 'user'").groupBy("courseid").agg(F.sum("messages").alias("questions")).orderBy(F.desc("questions"), "courseid").limit(n)
    return top.join(enrolled, "courseid", "left").select("courseid", "questions", F.coalesce("enrolled", F.lit(0)).alias("enrolled"))
