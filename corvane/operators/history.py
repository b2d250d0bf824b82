"""Conversation history and what hangs on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.text import fingerprint, word_count

CONV = "conversationid"


def owned_by(conversations: DataFrame, user: int, course: int, block: int) -> DataFrame:
    return conversations.filter((F.col("userid") == user) & (F.col("courseid") == course) & (F.col("blockinstanceid") == block))


def latest_conversation(conversations: DataFrame) -> DataFrame:
    """The last modified conversation of each user, course and block; of equal times the highest id."""
    w = W.partitionBy("userid", "courseid", "blockinstanceid").orderBy(F.desc("timemodified"), F.desc(CONV))
    return conversations.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def recent_history(turns: DataFrame, n: int, order: str = "turn") -> DataFrame:
    """The newest n turns with content among a conversation's newest 2n of user and assistant, oldest first."""
    newest = W.partitionBy(CONV).orderBy(F.desc(order))
    said = turns.filter(F.col("role").isin("user", "assistant")).withColumn("__a", F.row_number().over(newest)).filter(F.col("__a") <= 2 * n)
    full = said.filter(F.trim("content") != "").withColumn("__b", F.row_number().over(newest)).filter(F.col("__b") <= n)
    return full.groupBy(CONV).agg(F.array_sort(F.collect_list(F.struct(order, "role", "content"))).alias("history"))


def transcript(turns: DataFrame, n: int) -> DataFrame:
    label = lambda t: F.concat(F.initcap(t["role"]), F.lit(": "), t["content"])
    return recent_history(turns, n).select(CONV, F.array_join(F.transform("history", label), "\n\n").alias("transcript"))


def last_assistant_message(turns: DataFrame, order: str = "turn") -> DataFrame:
    return turns.filter("role = 'assistant'").groupBy(CONV).agg(F.max_by("content", order).alias("content"))


def recent_user_messages(turns: DataFrame, n: int = 6, order: str = "turn") -> DataFrame:
    """The newest n user turns, blank ones then left out."""
    w = W.partitionBy(CONV).orderBy(F.desc(order))
    return turns.filter("role = 'user'").withColumn("nth", F.row_number().over(w)).filter((F.col("nth") <= n) & (F.trim("content") != ""))


def user_turns_since(messages: DataFrame, events: DataFrame) -> DataFrame:
    """turns: user messages at or after each conversation's event time (column since)."""
    after = messages.join(events.select(CONV, "since"), CONV).filter((F.col("role") == "user") & (F.col("timecreated") >= F.col("since")))
    return events.select(CONV, "since").join(after.groupBy(CONV).agg(F.count("*").alias("turns")), CONV, "left").withColumn("turns", F.coalesce("turns", F.lit(0)))


def repetition(turns: DataFrame, words: int = 12, last: int = 6, order: str = "turn") -> DataFrame:
    """Whether a user turn's fingerprint occurs twice among the last user turns, itself included."""
    w = W.partitionBy(CONV).orderBy(order).rowsBetween(1 - last, 0)
    mine = turns.filter("role = 'user'").withColumn("fp", fingerprint("content", words))
    same = F.size(F.filter(F.collect_list("fp").over(w), lambda x: x == F.col("fp")))
    return mine.select(CONV, order, ((F.col("fp") != "") & (same >= 2)).alias("repeats"))


def retrieval_query(turns: DataFrame, short: int = 6, least: int = 3, back: int = 8, order: str = "turn") -> DataFrame:
    """A user message of under ``short`` words gets the newest earlier user message of ``least`` words in front, if one is among the latest
    ``back`` turns that aren't empty (of the latest 2 * ``back``, the message itself included)."""
    w = W.partitionBy(CONV).orderBy(order).rowsBetween(1 - 2 * back, 0)
    rows = turns.filter(F.col("role").isin("user", "assistant")).withColumn("said", F.trim("content"))
    seen = F.collect_list(F.struct("role", "content", "said", word_count("said").alias("words"))).over(w)
    rows = rows.withColumn("__seen", seen).filter("role = 'user'")
    latest = F.slice(F.reverse(F.filter("__seen", lambda x: x["content"] != "")), 1, back)
    anchor = F.get(F.filter(latest, lambda x: (x["role"] == "user") & (x["words"] >= least) & (x["said"] != F.col("said"))), F.lit(0))["said"]
    rows = rows.withColumn("anchor", anchor)
    return rows.select(CONV, order, F.when((word_count("said") < short) & F.col("anchor").isNotNull(), F.concat("anchor", F.lit("\n"), "said")).otherwise(F.col("said")).alias("query"))


def silenced(turns_since: DataFrame, least: int) -> DataFrame:
    """Whether offers stay silent after a refusal (user_turns_since's rows): until the user said more than ``least`` things."""
    return turns_since.withColumn("silenced", (F.lit(least) > 0) & (F.col("turns") <= least))


def suppress_content(messages: DataFrame, profiles: DataFrame, site_allows: bool, key: str = "courseid") -> DataFrame:
    """Content stays only where the site and the course's profile allow it; all else is kept."""
    allowed = F.lit(site_allows) & F.coalesce("storecontent", F.lit(False))
    return messages.join(profiles, key, "left").withColumn("content", F.when(allowed, F.col("content")).otherwise("")).drop("storecontent")


def messages_of(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    return messages.join(conversations, CONV, "left_semi")


def used_fallback(replies: DataFrame, heads: DataFrame, words: str, order: str = "turn") -> DataFrame:
    """Whether a reply (normalised, in column ``words``) holds one of the heads (column fp, normalised: some words) as a substring.

    A head's words but the first and last, which may be parts of words, stand in such a reply as they are: heads and replies meet
    by these runs of words, and heads of one or two words by their longest one's first letters. No reply meets all heads."""
    heads = heads.select("fp").filter("fp <> ''").distinct().withColumn("__w", F.split("fp", " ")).withColumn("__n", F.size("__w"))
    inner = heads.filter("__n > 2").select("fp", (F.col("__n") - 2).alias("__k"), F.array_join(F.slice("__w", F.lit(2), F.col("__n") - 2), " ").alias("__run"))
    sizes = inner.groupBy(F.lit(1).alias("g")).agg(F.collect_set("__k").alias("sizes"))  # a head has few words, so these are few numbers
    said = replies.select(CONV, order, F.col(words).alias("__text"), F.split(words, " ").alias("__w")).join(F.broadcast(sizes.select("sizes")))
    runs = F.flatten(F.transform("sizes", lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.size("__w") - k + 1, F.lit(1))), lambda i: F.array_join(F.slice("__w", i, k), " "))))
    long = said.select(CONV, order, "__text", F.explode(F.array_distinct(runs)).alias("__run")).join(inner, "__run")
    short = heads.filter("__n <= 2").select("fp", F.left(F.array_max(F.transform("__w", lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"], F.lit(3)).alias("__run"))
    grams = F.array_distinct(F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(words) - k + 1, F.lit(1))), lambda i: F.substring(words, i, k)))))
    tiny = replies.select(CONV, order, F.col(words).alias("__text"), F.explode(grams).alias("__run")).join(short, "__run")
    hits = long.select(CONV, order, "__text", "fp").unionByName(tiny.select(CONV, order, "__text", "fp")).filter(F.contains("__text", "fp")).select(CONV, order).distinct().withColumn("fallback", F.lit(True))
    return replies.select(CONV, order).join(hits, [CONV, order], "left").withColumn("fallback", F.coalesce("fallback", F.lit(False)))
