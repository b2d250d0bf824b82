"""Retention, erasure and export. A purge gives the rows that stay; callers write them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.history import CONV

Tables = dict[str, DataFrame]


def _before(column: str, cutoff: str):
    return F.col(column) < F.lit(cutoff).cast("timestamp_ntz")


def purge_conversations(t: Tables, cutoff: str | None) -> Tables:
    """Without conversations last modified before the cutoff and their messages; no cutoff keeps all."""
    if cutoff is None:
        return t
    gone = t["conversations"].filter(_before("timemodified", cutoff)).select(CONV)
    return t | {"conversations": t["conversations"].filter(~_before("timemodified", cutoff)), "messages": t["messages"].join(gone, CONV, "left_anti")}


def purge_messages(t: Tables, cutoff: str | None) -> Tables:
    return t if cutoff is None else t | {"messages": t["messages"].filter(~_before("timecreated", cutoff))}


def purge_tickets(t: Tables, cutoff: str | None) -> Tables:
    """Without tickets last modified before the cutoff and without those whose conversation is gone (of tickets that had one, a
    conversationid over 0); drafts stay whatever their age."""
    if cutoff is None:
        return t
    draft, had = F.col("status") == "draft", F.coalesce(F.col(CONV) > 0, F.lit(False))
    kept = t["tickets"].filter(draft | ~_before("timemodified", cutoff))
    there = t["conversations"].select(CONV, F.lit(True).alias("__there")).distinct()
    return t | {"tickets": kept.join(there, CONV, "left").filter(draft | ~had | F.col("__there")).select(*kept.columns)}


def purge_visitors(t: Tables, now: str, hours: int = 24) -> Tables:
    """Without visitors' conversations (user 0) that rested for ``hours``, and their messages."""
    old = (F.col("userid") == 0) & (F.col("timemodified") + F.expr(f"INTERVAL {hours} HOURS") < F.lit(now).cast("timestamp_ntz"))
    gone = t["conversations"].filter(old).select(CONV)
    return t | {"conversations": t["conversations"].filter(~old), "messages": t["messages"].join(gone, CONV, "left_anti")}


def expire_drafts(tickets: DataFrame, now: str, life_hours: int = 24) -> DataFrame:
    """Drafts whose token has expired become expired tickets, modified now. Tickets without ``tokenexpiry`` expire ``life_hours`` after they were
    made; a null one never does."""
    at = F.lit(now).cast("timestamp_ntz")
    end = F.col("tokenexpiry") if "tokenexpiry" in tickets.columns else F.col("timecreated") + F.expr(f"INTERVAL {life_hours} HOURS")
    over = F.coalesce((F.col("status") == "draft") & (end < at), F.lit(False))
    return tickets.withColumns({"status": F.when(over, "expired").otherwise(F.col("status")), "timemodified": F.when(over, at).otherwise(F.col("timemodified"))})


def retention(t: Tables, now: str, cutoff: str | None, hours: int = 24) -> Tables:
    """Visitors' conversations go by their own clock. The rest only where retention is on (a cutoff): drafts expire, then conversations,
    messages and tickets go."""
    t = purge_visitors(t, now, hours)
    if cutoff is None:
        return t
    t = t | {"tickets": expire_drafts(t["tickets"], now)}
    return purge_tickets(purge_messages(purge_conversations(t, cutoff), cutoff), cutoff)


def counts(t: Tables) -> DataFrame:
    out = None
    for name, df in sorted(t.items()):
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def erase_subject(t: Tables, subjects: DataFrame) -> Tables:
    """Without all rows of the given users; messages go with their conversations."""
    gone = t["conversations"].join(subjects, "userid", "left_semi").select(CONV)
    out = {}
    for name, df in t.items():
        df = df.join(gone, CONV, "left_anti") if name == "messages" else df
        out[name] = df.join(subjects, "userid", "left_anti") if "userid" in df.columns else df
    return out


def subject_contexts(t: Tables) -> DataFrame:
    """Distinct users and courses with any row in any table."""
    out = None
    for df in t.values():
        one = df.select("userid", "courseid")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def users_in_context(t: Tables, course: int) -> DataFrame:
    return subject_contexts(t).filter(F.col("courseid") == course).select("userid").distinct()


def export_subject(t: Tables, subjects: DataFrame) -> DataFrame:
    """One row per user and course: conversations with their messages, and tickets."""
    mine = t["conversations"].join(subjects, "userid", "left_semi")
    said = t["messages"].join(mine.select(CONV), CONV, "left_semi").groupBy(CONV).agg(F.array_sort(F.collect_list(F.struct("timecreated", "messageid", "role"))).alias("messages"))
    convs = mine.join(said, CONV, "left").groupBy("userid", "courseid").agg(F.array_sort(F.collect_list(F.struct(CONV, "messages"))).alias("conversations"))
    tickets = t["tickets"].join(subjects, "userid", "left_semi").groupBy("userid", "courseid").agg(F.array_sort(F.collect_list(F.struct("ticketid", "status"))).alias("tickets"))
    return convs.join(tickets, ["userid", "courseid"], "full")


def write_export(export: DataFrame, path: str, folders: int = 1024) -> None:
    """JSON lines by user, in a bounded number of folders (bucket: hash of the user), so that a user's lines are in one of them."""
    dealt = export.withColumn("bucket", F.pmod(F.xxhash64("userid"), F.lit(folders)))
    dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(path)
