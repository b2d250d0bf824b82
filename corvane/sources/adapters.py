"""Views over the driver's tables: the only place that knows their names and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import table

MODELS = ["gpt-5-mini", "gpt-4.1-mini-2025-04-14", "gemini-3.8-flash", "", "house-model"]
STATUSES = ["draft", "queued", "sent", "failed", "cancelled", "expired"]
CATEGORIES = ["acceso", "notas", "entrega", "contenido", "otro"]
ROUTES = ["tutor", "assistant", "ambiguous", ""]


def pick(values: list[str], index) -> F.Column:
    """values[index], index counting from 0."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), index.cast("int") + 1)


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    e, k = _keyed(spark, d), F.col("k")
    asked = F.col("event_type").isin("view", "click", "signup")
    tokens = lambda x: F.when(asked, F.lit(0)).otherwise(F.floor(F.col("value") * x)).cast("bigint")
    e = e.withColumns({"prompttokens": tokens(10), "cachedtokens": tokens(4), "completiontokens": tokens(2)})
    return e.select(
        F.col("event_id").alias("messageid"),
        F.col("user_id").alias("userid"),
        (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("conversationid"),
        (F.col("user_id") % 25).alias("courseid"),
        F.expr("user_id div 25 % 3").alias("blockinstanceid"),
        F.when(asked, "user").otherwise("assistant").alias("role"),
        pick(ROUTES, k % 4).alias("route"),
        (k % 3).alias("agentid"),
        pick(MODELS, k % 5).alias("model"),
        "prompttokens",
        "cachedtokens",
        "completiontokens",
        (F.col("prompttokens") + F.col("completiontokens")).alias("totaltokens"),
        F.when(F.col("event_type") == "error", "apierror").otherwise("").alias("errormessage"),
        F.col("ts").alias("timecreated"),
    )


def conversations(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    return m.groupBy("conversationid", "userid", "courseid", "blockinstanceid").agg(F.min("timecreated").alias("timecreated"), F.max("timecreated").alias("timemodified"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("conversationid"), F.col("turn").alias("turn"), "role", F.col("text").alias("content"))


#: Turns that every kind of rule meets, beside the stored ones: (conversation, turn, role, content).
PROBES = [
    (-1, 0, "user", "Necesito el FODA y Paro-Pienso-Procedo del módulo B2"),
    (-1, 1, "assistant", "La técnica Si - No - Si está en la Unidad 3; NASA y ESA también."),
    (-1, 2, "user", "necesito el foda y paro pienso procedo del MODULO b2"),
    (-1, 3, "user", "What about follow\u2013up, well-being and the GPA, ECTS, MOOC, LMS, FAQ?"),
    (-1, 4, "user", "Necesito el FODA, y Paro-Pienso-Procedo, del módulo b2!"),
    (-2, 0, "user", "Pick the correct answer: a) mitosis b) meiosis c) none"),
    (-2, 1, "user", "a) first b) second"),
    (-2, 2, "user", "True or false: water is wet"),
    (-2, 3, "user", "Verdadero o falso: el agua moja"),
    (-2, 4, "user", "Which of the following is right? (a) one (b) two"),
    (-3, 0, "user", "no puedo entrar al aula, me sale un error"),
    (-3, 1, "assistant", "Lo siento, no puedo ayudarte con eso; contacta con el equipo de soporte."),
    (-3, 2, "user", "sigue fallando"),
    (-3, 3, "user", "gracias"),
    (-3, 4, "user", "\u00bfy eso?"),
    (-4, 0, "user", "quiero hablar con una persona"),
    (-4, 1, "assistant", "Puedo preparar la solicitud para el equipo de soporte. \u00bfQuieres que la envie?"),
    (-4, 2, "user", "s\u00ed, por favor"),
    (-4, 5, "user", "\u00bfc\u00f3mo puedo contactar con soporte?"),
    (-4, 3, "user", "what is my grade in this course and when is the essay due"),
    (-5, 0, "user", "   "),
    (-5, 1, "user", "x" * 900),
    (-5, 2, "assistant", "state.step = 3\nHello there\nSummary: all of it"),
    (-5, 3, "user", "Quel est le devoir de la semaine pour ce cours et les notes"),
    (-5, 4, "user", "Qual \u00e9 a data de entrega do trabalho n\u00e3o sei como fazer"),
]


def said(spark: SparkSession, d: str) -> DataFrame:
    """All stored turns, and the probes."""
    return turns(spark, d).unionByName(spark.createDataFrame(PROBES, "conversationid long, turn long, role string, content string"))


def agents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "tutor", "gpt-4.1-nano"), (1, "assistant", "gpt-5-mini"), (2, "ambiguous", "gemini-2.5-flash")], "agentid long, agenttype string, defaultmodel string")


def prices(spark: SparkSession) -> DataFrame:
    """Prices for a million tokens; one model's price changes within the fixture's month."""
    rows = [
        ("gpt-5-mini", "1970-01-01", 0.25, 2.0, 0.025),
        ("gpt-4.1-mini", "1970-01-01", 0.4, 1.6, 0.1),
        ("gpt-4.1-nano", "1970-01-01", 0.1, 0.4, 0.025),
        ("gemini-2.5-flash", "1970-01-01", 0.3, 2.5, 0.03),
        ("gemini-3.8-flash", "1970-01-01", 0.75, 3.75, 0.075),
        ("gemini-3.8-flash", "2024-01-15", 1.5, 7.5, 0.15),
    ]
    df = spark.createDataFrame(rows, "model string, valid_from string, input double, output double, cached double")
    return df.withColumn("valid_from", F.to_date("valid_from"))


def configured_courses(spark: SparkSession) -> DataFrame:
    """Courses that have the assistant: every third one."""
    return spark.range(0, 25, 1, 1).filter("id % 3 = 0").select(F.col("id").alias("courseid"))


def tool_log(spark: SparkSession, d: str) -> DataFrame:
    """The event log: payload JSON with tool and ok."""
    e = _keyed(spark, d)
    other = F.to_json(F.struct(F.col("event_type").alias("tool"), F.when(F.col("k") >= 20, "1").otherwise("0").alias("ok")))
    return e.select(F.lit("tool_called").alias("eventname"), (F.col("user_id") % 25).alias("courseid"), other.alias("other"), F.col("ts").alias("timecreated"))


def tickets(spark: SparkSession, d: str) -> DataFrame:
    e, k = _keyed(spark, d).filter("event_type = 'error'"), F.col("k")
    return e.select(
        F.col("event_id").alias("ticketid"),
        (F.col("user_id") % 25).alias("courseid"),
        F.expr("user_id div 25 % 3").alias("blockinstanceid"),
        F.col("user_id").alias("userid"),
        (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("conversationid"),
        pick(CATEGORIES, k % 5).alias("category"),
        F.sha1((k % 10).cast("string").cast("binary")).alias("summaryhash"),
        pick(STATUSES, k % 6).alias("status"),
        F.col("ts").alias("timecreated"),
        F.col("ts").alias("timemodified"),
    )


def courses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("courseid"), F.initcap("n_name").alias("fullname"), F.lower("n_name").alias("shortname"), F.concat(F.lit("/"), F.col("n_regionkey").cast("string"), F.lit("/"), (F.col("n_nationkey") + 10).cast("string")).alias("path"), F.col("n_regionkey").cast("bigint").alias("categoryid"))


def enrolments(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    end = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise(F.date_add(F.to_date("o_orderdate"), 365))
    return o.select(F.col("o_orderkey").alias("enrolmentid"), F.col("o_custkey").alias("userid"), (F.col("o_orderkey") % 25).alias("courseid"), F.to_date("o_orderdate").alias("timestart"), end.alias("timeend"), (F.col("o_orderstatus") == "P").alias("suspended"))


def activity_state(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select(
        F.col("o_custkey").alias("userid"),
        (F.col("o_orderkey") % 25).alias("courseid"),
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_linenumber").cast("bigint").alias("activityid"),
        F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("state"),
        F.date_add(F.to_date("o_orderdate"), 60).alias("due"),
        F.to_date("l_shipdate").alias("submitted"),
        F.col("l_quantity").alias("grade"),
        "l_partkey",
        "l_suppkey",
    )


CHUNK, STEP = 1200, 1000


def chunks(spark: SparkSession, d: str) -> DataFrame:
    from corvane.operators.knowledge import window_chunks

    docs = table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("filename"), (F.col("lang") != "de").alias("citable"), (F.col("doc_id") % 5).alias("courseid"))
    return window_chunks(docs, "text", CHUNK, STEP)


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("queryid"), F.col("text").alias("query"), (F.col("item_id") % 5).alias("courseid"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")
