"""Daily facts from raw messages and tool calls, and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NAME_CHARS = 100
STATS_KEYS = ["courseid", "blockinstanceid", "daterecorded", "role", "route", "agentid", "model"]


def day_start(ts: str | Column = "timecreated") -> Column:
    return F.to_date(ts)


def in_range(df: DataFrame, start: str, end: str, ts: str = "timecreated") -> DataFrame:
    """Rows of the half-open range [start, end) of timestamps; pushed down to the scan."""
    return df.filter((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))


def message_facts(messages: DataFrame, conversations: DataFrame, agents: DataFrame) -> DataFrame:
    """Messages of known conversations; a message without a model has its agent's default."""
    known = conversations.select("conversationid")
    joined = messages.join(known, "conversationid").join(agents.select("agentid", "defaultmodel"), "agentid", "left")
    model = F.coalesce(F.nullif(F.trim("model"), F.lit("")), "defaultmodel", F.lit(""))
    return joined.withColumns({"model": F.left(model, F.lit(NAME_CHARS)), "route": F.trim("route"), "daterecorded": day_start()}).drop("defaultmodel")


def build_msgstats(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*STATS_KEYS).agg(
        F.count("*").alias("messages"),
        F.count(F.when(F.trim("errormessage") != "", 1)).alias("errors"),
        *(F.sum(c).alias(c) for c in ("prompttokens", "cachedtokens", "completiontokens", "totaltokens")),
    )


def build_userstats(messages: DataFrame) -> DataFrame:
    asked = messages.filter("role = 'user'").withColumn("daterecorded", day_start())
    return asked.groupBy("courseid", "blockinstanceid", "daterecorded", "userid").agg(F.count("*").alias("numquestions"))


def parse_tool_payload(other: str | Column = "other") -> tuple[Column, Column]:
    """(tool, ok) of a payload; no tool is ``unknown``, and what isn't JSON is a failed call."""
    tool = F.left(F.coalesce(F.nullif(F.get_json_object(other, "$.tool"), F.lit("")), F.lit("unknown")), F.lit(NAME_CHARS))
    ok = F.get_json_object(other, "$.ok")
    return tool, F.coalesce(~ok.isin("", "0", "false"), F.lit(False))


def build_toolstats(log: DataFrame) -> DataFrame:
    tool, ok = parse_tool_payload()
    calls = log.select("courseid", day_start().alias("daterecorded"), tool.alias("toolname"), ok.alias("good"))
    return calls.groupBy("courseid", "daterecorded", "toolname").agg(F.count("*").alias("calls"), F.count(F.when(F.col("good"), 1)).alias("ok"), F.count(F.when(~F.col("good"), 1)).alias("fail"))


def write_rollup(stats: DataFrame, path: str) -> None:
    """Replace the days that the rollup has and keep the others; writing twice changes nothing."""
    stats.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("daterecorded").parquet(path)


def load_price_table(lines: DataFrame, defaults: DataFrame, line_col: str = "value") -> DataFrame:
    """model, input, output, cached of lines ``model | input | output [| cached]``; # comments, blanks and short lines
    are skipped, no cached rate is the input rate, and a line replaces the default of its model (the last one wins)."""
    part = lambda i: F.trim(F.get(F.split(line_col, r"\|"), F.lit(i)))
    number = lambda i: F.coalesce(part(i).try_cast("double"), F.lit(0.0))
    text = F.trim(F.col(line_col))
    good = lines.withColumn("nth", F.monotonically_increasing_id()).filter((text != "") & ~text.startswith("#") & (F.size(F.split(line_col, r"\|")) >= 3) & (part(0) != ""))
    cached = F.when(F.coalesce(part(3), F.lit("")) != "", number(3)).otherwise(number(1))
    own = good.select(F.lower(part(0)).alias("model"), F.struct(number(1).alias("input"), number(2).alias("output"), cached.alias("cached")).alias("p"), "nth")
    own = own.groupBy("model").agg(F.max_by("p", "nth").alias("p"))
    base = defaults.select("model", F.struct("input", "output", "cached").alias("d"))
    return base.join(own, "model", "full").select("model", F.coalesce("p", "d").alias("x")).select("model", "x.*")


def price_periods(prices: DataFrame) -> DataFrame:
    """Prices with the half-open range of days [valid_from, valid_to) in which each holds."""
    after = F.lead("valid_from").over(W.partitionBy("model").orderBy("valid_from"))
    return prices.withColumn("valid_to", F.coalesce(after, F.lit("9999-12-31").cast("date")))


def model_names(model: str | Column) -> tuple[Column, Column]:
    """The name as priced, and the name without a snapshot date."""
    name = F.regexp_replace(F.lower(F.trim(model)), "^models/", "")
    return name, F.regexp_replace(name, r"-(\d{8}|\d{4}-\d{2}-\d{2})$", "")


def with_prices(usage: DataFrame, periods: DataFrame, day: str = "daterecorded") -> DataFrame:
    """Usage with the price in force on its day: of the exact model, else of its undated name, else null."""
    name, base = model_names("model")
    u = usage.withColumns({"__name": name, "__base": base})
    for key, p in (("__name", "__exact"), ("__base", "__undated")):
        side = periods.select(F.col("model").alias(f"{p}_model"), F.col("valid_from").alias(f"{p}_from"), F.col("valid_to").alias(f"{p}_to"), F.struct("input", "output", "cached").alias(p))
        match = (F.col(key) == F.col(f"{p}_model")) & (F.col(day) >= F.col(f"{p}_from")) & (F.col(day) < F.col(f"{p}_to"))
        u = u.join(side, match, "left").drop(f"{p}_model", f"{p}_from", f"{p}_to")
    return u.withColumn("price", F.coalesce("__exact", "__undated")).drop("__name", "__base", "__exact", "__undated")
