"""Support tickets: listing, limits, duplicates, outcomes and the decision to offer one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import classify as C
from corvane.operators.history import CONV, repetition

COUNTED = ("queued", "sent")
CONFIRMED = ("queued", "sent", "failed")


def support_filters(tickets: DataFrame, start: str, end: str, course: int | None = None, courses: list[int] | None = None, status: str | None = None, who: str | None = None, names: DataFrame | None = None) -> DataFrame:
    """Tickets created in [start, end) with the given course, one of the courses, the status, and a participant (columns
    userid, fullname of ``names``) or reference number that holds ``who``."""
    t = tickets.filter((F.col("timecreated") >= F.lit(start).cast("timestamp_ntz")) & (F.col("timecreated") < F.lit(end).cast("timestamp_ntz")))
    if course is not None:
        t = t.filter(F.col("courseid") == course)
    if courses:
        t = t.filter(F.col("courseid").isin(courses))
    if status:
        t = t.filter(F.col("status") == status)
    if who:
        ref = F.col("ticketid").cast("string").contains(who)
        t = t.join(names.select("userid", "fullname"), "userid", "left").filter(ref | F.coalesce(F.lower("fullname").contains(who.lower()), F.lit(False))).drop("fullname") if names is not None else t.filter(ref)
    return t


def escalated_conversations(tickets: DataFrame, conversations: DataFrame, start: str, end: str) -> DataFrame:
    """Distinct conversations of the range with a confirmed ticket of the range."""
    inside = lambda c: (F.col(c) >= F.lit(start).cast("timestamp_ntz")) & (F.col(c) < F.lit(end).cast("timestamp_ntz"))
    t = tickets.filter(F.col("status").isin(*CONFIRMED) & inside("timecreated")).select(CONV)
    return conversations.filter(inside("timecreated")).join(t, CONV, "left_semi").agg(F.countDistinct(CONV).alias("escalated"))


def support_summary(tickets: DataFrame, conversations: DataFrame, start: str, end: str) -> DataFrame:
    ranged = support_filters(tickets, start, end)
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    counts = ranged.agg(F.count("*").alias("total"), *(n(s).alias(s) for s in ("sent", "queued", "failed", "cancelled", "draft", "expired")), n(*CONFIRMED).alias("confirmed"))
    begun = support_filters(conversations, start, end).agg(F.count("*").alias("conversations"))
    one = counts.crossJoin(escalated_conversations(tickets, conversations, start, end)).crossJoin(begun)  # single rows
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b) * 100, 1)).otherwise(0.0)
    return one.withColumns({"confirmedratio": share("confirmed", "total"), "ratio": share("escalated", "conversations")})


def audit_page(tickets: DataFrame, users: DataFrame, courses: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of tickets, newest first, with participant and (if it still exists) course name."""
    page = tickets.join(users.select("userid"), "userid", "left_semi").orderBy(F.desc("timecreated"), F.desc("ticketid")).offset(offset).limit(limit)
    return page.join(users, "userid").join(courses.select("courseid", "fullname"), "courseid", "left")


def orphans(tickets: DataFrame, conversations: DataFrame) -> DataFrame:
    return tickets.join(conversations, CONV, "left_anti")


def duplicates(tickets: DataFrame, hours: int) -> DataFrame:
    """Each ticket with whether a counted one of the same course, user and hash came at most ``hours`` before."""
    w = W.partitionBy("courseid", "userid", "summaryhash").orderBy("timecreated", "ticketid").rowsBetween(W.unboundedPreceding, -1)
    last = F.max(F.when(F.col("status").isin(*COUNTED), F.col("timecreated"))).over(w)
    return tickets.withColumn("duplicate", F.coalesce(F.col("timecreated") - F.expr(f"INTERVAL {hours} HOURS") <= last, F.lit(False)) & (F.col("summaryhash") != ""))


def quota_use(tickets: DataFrame) -> DataFrame:
    """Counted tickets of the same day before each ticket: of its user in its course, and of its course."""
    day = F.to_date("timecreated")
    hit = F.count(F.when(F.col("status").isin(*COUNTED), 1))
    before = lambda *keys: W.partitionBy(*keys, day).orderBy("timecreated", "ticketid").rowsBetween(W.unboundedPreceding, -1)
    return tickets.withColumns({"user_today": hit.over(before("courseid", "userid")), "course_today": hit.over(before("courseid"))})


def cool_down(tickets: DataFrame) -> DataFrame:
    """Seconds since the last counted ticket of the same user and course, null for none."""
    w = W.partitionBy("courseid", "userid").orderBy("timecreated", "ticketid").rowsBetween(W.unboundedPreceding, -1)
    last = F.max(F.when(F.col("status").isin(*COUNTED), F.col("timecreated"))).over(w)
    return tickets.withColumn("seconds_since", F.timestamp_diff("SECOND", last, F.col("timecreated")))


def supersede_drafts(tickets: DataFrame) -> DataFrame:
    """Drafts with a newer draft in their conversation expire."""
    w = W.partitionBy(CONV, "status").orderBy("timecreated", "ticketid")
    newer = F.lead("ticketid").over(w).isNotNull()
    return tickets.withColumn("status", F.when((F.col("status") == "draft") & newer, "expired").otherwise(F.col("status")))


def pending_drafts(tickets: DataFrame, now: str, life_hours: int = 24) -> DataFrame:
    """Each conversation's newest draft that is still alive."""
    alive = tickets.filter((F.col("status") == "draft") & (F.col("timecreated") + F.expr(f"INTERVAL {life_hours} HOURS") > F.lit(now).cast("timestamp_ntz")))
    w = W.partitionBy(CONV).orderBy(F.desc("timecreated"), F.desc("ticketid"))
    return alive.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def last_refusals(tickets: DataFrame) -> DataFrame:
    return tickets.filter("status = 'cancelled'").groupBy(CONV).agg(F.max("timemodified").alias("since"))


def recent_tickets(tickets: DataFrame, n: int = 5) -> DataFrame:
    w = W.partitionBy("courseid", "userid").orderBy(F.desc("timecreated"), F.desc("ticketid"))
    return tickets.filter("status <> 'draft'").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)


def digest_due(tickets: DataFrame, now: str, minutes: int) -> DataFrame:
    """Courses whose oldest queued ticket has waited long enough, with their whole queue."""
    oldest = F.min("timecreated")
    by = tickets.filter("status = 'queued'").groupBy("courseid").agg(oldest.alias("oldest"), F.count("*").alias("queued"), F.array_sort(F.collect_list("ticketid")).alias("ticketids"))
    return by.filter(F.col("oldest") + F.expr(f"INTERVAL {minutes} MINUTES") <= F.lit(now).cast("timestamp_ntz"))


def unanswered_requests(turns: DataFrame, tickets: DataFrame, order: str = "turn") -> DataFrame:
    """User turns whose previous user turn asked for a person, in conversations where no ticket came at or after it (column
    raised of tickets, on the turns' order)."""
    w = W.partitionBy(CONV).orderBy(order)
    mine = turns.filter("role = 'user'").withColumns({"__prev": F.lag(order).over(w), "__asked": C.human_request_kind(F.lag("content").over(w)) == "request"})
    asked = mine.filter("__asked")
    none = asked.join(tickets.select(F.col(CONV).alias("__c"), "raised"), (F.col(CONV) == F.col("__c")) & (F.col("raised") >= F.col("__prev")), "left_anti")
    return none.select(CONV, order)


def escalation_triggers(turns: DataFrame, tickets: DataFrame, fallbacks: DataFrame, failures: DataFrame, order: str = "turn") -> DataFrame:
    """The first trigger that fires for each user turn. ``fallbacks`` and ``failures``: conversations and turns (columns
    conversationid, turn) of fallback replies and failed tools; tickets as in unanswered_requests."""
    w = W.partitionBy(CONV).orderBy(order)
    reply = F.last(F.when(F.col("role") == "assistant", F.col("content")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    mine = turns.withColumn("__reply", reply).filter("role = 'user'").select(CONV, order, "content", F.coalesce("__reply", F.lit("")).alias("__reply"))
    open_ = unanswered_requests(turns, tickets, order).withColumn("__open", F.lit(True))
    first = lambda df, name: df.groupBy(CONV).agg(F.min(order).alias(name))
    df = mine.join(open_, [CONV, order], "left").join(repetition(turns, order=order), [CONV, order], "left")
    df = df.join(first(failures, "__failed"), CONV, "left").join(first(fallbacks, "__fell"), CONV, "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    trigger = (
        F.when(C.human_request_kind("content") == "request", "asked")
        .when(yes(F.col("__open")), "asked")
        .when(C.accepts_an_offer("content", "__reply"), "accepted")
        .when(yes(F.col("__failed") < F.col(order)), "toolfailure")
        .when(yes(F.col("__fell") < F.col(order)), "fallback")
        .when(yes(F.col("repeats")), "repetition")
        .when(C.recommends_support("__reply"), "recommended")
        .otherwise("")
    )
    return df.select(CONV, order, trigger.alias("trigger"))


def escalation_gate(tickets: DataFrame, enabled: bool, most_user: int, minutes: int, most_course: int) -> DataFrame:
    """For each ticket, why it would be denied when it was raised: disabled, capability (visitors), quota, cooldown, coursequota, or nothing."""
    t = cool_down(quota_use(tickets))
    reason = (
        F.when(~F.lit(enabled), "disabled")
        .when(F.col("userid") <= 0, "capability")
        .when((F.lit(most_user) > 0) & (F.col("user_today") >= most_user), "quota")
        .when((F.lit(minutes) > 0) & (F.col("seconds_since") < minutes * 60), "cooldown")
        .when((F.lit(most_course) > 0) & (F.col("course_today") >= most_course), "coursequota")
        .otherwise("")
    )
    return t.withColumn("denied", reason)


def offer_gate(turns: DataFrame, triggers: DataFrame, blocked: DataFrame, refusals: DataFrame, silence: int, order: str = "turn") -> DataFrame:
    """For each user turn whether support may be offered (reason ``allowed``) or why not: what blocks its conversation (blocked: conversationid,
    denied; the reasons of escalation_gate), refused (at most ``silence`` user turns since the last refusal, unless the user asks for a
    person; refusals: conversationid, refused, on the turns' order), notrigger, needdetail (an opening request without a problem)."""
    # refusals stand among the turns, each before the turn of its number
    both = turns.select(CONV, order, "role", "content", F.lit(1).alias("__kind")).unionByName(refusals.select(CONV, F.col("refused").alias(order), F.lit(0).alias("__kind")), allowMissingColumns=True)
    w = W.partitionBy(CONV).orderBy(order, "__kind")
    sofar = w.rowsBetween(W.unboundedPreceding, 0)
    reply = F.last(F.when(F.col("role") == "assistant", F.col("content")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = both.withColumns({"__reply": F.coalesce(reply, F.lit("")), "__user": F.count(F.when(F.col("role") == "user", 1)).over(sofar)})
    rows = rows.withColumn("__since", F.col("__user") - F.last(F.when(F.col("__kind") == 0, F.col("__user")), ignorenulls=True).over(sofar))
    mine = rows.filter("role = 'user'")
    why = blocked.groupBy(CONV).agg(F.max("denied").alias("denied"))  # a reason rather than none
    df = mine.join(triggers.select(CONV, order, "trigger"), [CONV, order]).join(why, CONV, "left")
    asked = C.human_request_kind("content") == "request"
    reason = (
        F.when(F.coalesce("denied", F.lit("")) != "", F.col("denied"))
        .when(~asked & F.coalesce((F.lit(silence) > 0) & (F.col("__since") <= silence), F.lit(False)), "refused")
        .when(F.col("trigger") == "", "notrigger")
        .when(asked & ~C.states_a_problem("content") & (F.trim("__reply") == ""), "needdetail")
        .otherwise("allowed")
    )
    return df.select(CONV, order, "trigger", reason.alias("reason"))
