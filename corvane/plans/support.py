"""Queries over conversations and tickets."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.text import ACCENTED, PLAIN, fingerprint, normalize_summary
from corvane.operators import history as H
from corvane.operators import tickets as K
from corvane.plans.registry import query
from corvane.session import table
from corvane.sources import adapters as A

START, END = "2024-01-05", "2024-01-26"
IN = f"timecreated >= TIMESTAMP '{START}' AND timecreated < TIMESTAMP '{END}'"
COUNTED = "status IN ('queued', 'sent')"
T = A.tickets


def users(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("userid"), F.concat(F.lit("User "), F.col("c_custkey").cast("string")).alias("username"))


query("f6_owned_by", "convs", "SELECT conversationid, timecreated FROM convs WHERE userid = 7 AND courseid = 7 AND blockinstanceid = 0")(lambda s, d: H.owned_by(A.conversations(s, d), 7, 7, 0).select("conversationid", "timecreated"))
query("w1_latest_conversation", "convs", "SELECT conversationid, userid FROM (SELECT *, row_number() OVER (PARTITION BY userid, courseid, blockinstanceid ORDER BY timemodified DESC, conversationid DESC) AS n FROM convs) WHERE n = 1")(
    lambda s, d: H.latest_conversation(A.conversations(s, d)).select("conversationid", "userid")
)
_HISTORY = """WITH a AS (SELECT *, row_number() OVER (PARTITION BY conversationid ORDER BY turn DESC) AS n FROM turns WHERE role IN ('user', 'assistant')),
b AS (SELECT *, row_number() OVER (PARTITION BY conversationid ORDER BY turn DESC) AS m FROM a WHERE n <= 6 AND trim(content) <> '')"""
query("w2_recent_history", "turns", f"{_HISTORY} SELECT conversationid, string_agg(turn || ':' || role, ',' ORDER BY turn) AS history, md5(string_agg(content, '|' ORDER BY turn)) AS said FROM b WHERE m <= 3 GROUP BY 1")(
    lambda s, d: H.recent_history(A.turns(s, d), 3).select("conversationid", F.array_join(F.transform("history", lambda t: F.concat(t["turn"].cast("string"), F.lit(":"), t["role"])), ",").alias("history"), F.md5(F.array_join("history.content", "|").cast("binary")).alias("said"))
)
query("x33_transcript", "turns", f"{_HISTORY} SELECT conversationid, string_agg(upper(left(role, 1)) || substring(role, 2) || ': ' || content, chr(10) || chr(10) ORDER BY turn) AS transcript FROM b WHERE m <= 3 GROUP BY 1")(lambda s, d: H.transcript(A.turns(s, d), 3))
query("w3_last_assistant_message", "turns", "SELECT conversationid, arg_max(content, turn) AS content FROM turns WHERE role = 'assistant' GROUP BY 1")(lambda s, d: H.last_assistant_message(A.turns(s, d)))
query("w4_recent_user_messages", "turns", "SELECT conversationid, turn, nth FROM (SELECT *, row_number() OVER (PARTITION BY conversationid ORDER BY turn DESC) AS nth FROM turns WHERE role = 'user') WHERE nth <= 6 AND trim(content) <> ''")(
    lambda s, d: H.recent_user_messages(A.turns(s, d)).select("conversationid", "turn", F.col("nth").cast("bigint").alias("nth"))
)
query("w5_user_turns_since_refusal", "messages tickets", "WITH r AS (SELECT conversationid, max(timemodified) AS since FROM tickets WHERE status = 'cancelled' GROUP BY 1) SELECT r.conversationid, since, count(messageid) AS turns, count(messageid) <= 2 AS silenced FROM r LEFT JOIN messages m ON m.conversationid = r.conversationid AND role = 'user' AND timecreated >= since GROUP BY ALL")(
    lambda s, d: H.silenced(H.user_turns_since(A.messages(s, d), K.last_refusals(T(s, d))), 2)
)
_FP = f"array_to_string(list_filter(string_split(trim(regexp_replace(translate(lower(content), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')[1:12], ' ')"
query("w8_repetition", "said", f"""WITH m AS (SELECT conversationid, turn, {_FP} AS raw FROM said WHERE role = 'user'), f AS (SELECT conversationid, turn, CASE WHEN len(string_split(raw, ' ')) < 4 THEN '' ELSE raw END AS fp FROM m),
l AS (SELECT *, list(fp) OVER (PARTITION BY conversationid ORDER BY turn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS fps FROM f) SELECT conversationid, turn, fp <> '' AND len(list_filter(fps, lambda x: x = fp)) >= 2 AS repeats FROM l""")(
    lambda s, d: H.repetition(A.said(s, d))
)
_RETRIEVAL = r"""t AS (SELECT conversationid, turn, role, content, trim(content) AS said, row_number() OVER (PARTITION BY conversationid ORDER BY turn) AS n, len(list_filter(regexp_split_to_array(trim(content), '\s+'), lambda x: x <> '')) AS words FROM turns WHERE role IN ('user', 'assistant')),
p AS (SELECT t.conversationid, t.turn, t.said AS now, p.role, p.said, p.words, p.n, row_number() OVER (PARTITION BY t.conversationid, t.turn ORDER BY p.n DESC) AS back FROM t JOIN t p ON p.conversationid = t.conversationid AND p.n BETWEEN t.n - 15 AND t.n AND p.content <> '' WHERE t.role = 'user'),
a AS (SELECT conversationid, turn, arg_max(said, n) AS anchor FROM p WHERE back <= 8 AND role = 'user' AND words >= 3 AND said <> now GROUP BY ALL),
asked AS (SELECT t.conversationid, t.turn, CASE WHEN words < 6 AND anchor IS NOT NULL THEN anchor || chr(10) || said ELSE said END AS query FROM t LEFT JOIN a USING (conversationid, turn) WHERE role = 'user')"""
query("w16_retrieval_query", "turns", f"WITH {_RETRIEVAL} SELECT * FROM asked")(lambda s, d: H.retrieval_query(A.turns(s, d)))
query("s12_suppress_content", "turns", "SELECT conversationid, turn, CASE WHEN conversationid % 5 IN (1, 3) THEN content ELSE '' END AS content FROM turns")(
    lambda s, d: H.suppress_content(A.turns(s, d).withColumn("courseid", F.col("conversationid") % 5), s.range(0, 5, 1, 1).filter("id <> 0").select(F.col("id").alias("courseid"), (F.col("id") % 2 == 1).alias("storecontent")), True).select("conversationid", "turn", "content")
)
query("j10_messages_of", "messages convs", "SELECT messageid FROM messages WHERE conversationid IN (SELECT conversationid FROM convs WHERE userid % 10 = 3)")(lambda s, d: H.messages_of(A.messages(s, d), A.conversations(s, d).filter("userid % 10 = 3")).select("messageid"))
query("f8_support_filters", "tickets", f"SELECT ticketid FROM tickets WHERE {IN} AND courseid IN (1, 2, 3, 4, 5, 6) AND status = 'sent' AND (contains(CAST(ticketid AS VARCHAR), '12') OR (contains('user ' || userid, 'user 5') OR contains('user ' || userid, '12')) AND userid IN (SELECT c_custkey FROM customer))")(
    lambda s, d: K.support_filters(T(s, d), START, END, courses=[1, 2, 3, 4, 5, 6], status="sent", who="12", names=users(s, d).withColumnRenamed("username", "fullname")).select("ticketid").unionByName(
        K.support_filters(T(s, d), START, END, courses=[1, 2, 3, 4, 5, 6], status="sent", who="user 5", names=users(s, d).withColumnRenamed("username", "fullname")).select("ticketid")
    ).distinct()
)
query("j3_escalated_conversations", "tickets convs", f"SELECT count(DISTINCT c.conversationid) AS escalated FROM tickets t JOIN convs c USING (conversationid) WHERE status IN ('queued', 'sent', 'failed') AND t.{IN.replace('AND timecreated', 'AND t.timecreated')} AND c.{IN.replace('AND timecreated', 'AND c.timecreated')}")(
    lambda s, d: K.escalated_conversations(T(s, d), A.conversations(s, d), START, END)
)
query("a20_support_summary", "tickets convs", f"""WITH x AS (SELECT count(*) AS total, {', '.join(f"count(*) FILTER (status = '{n}') AS {n}" for n in ('sent', 'queued', 'failed', 'cancelled', 'draft', 'expired'))}, count(*) FILTER (status IN ('queued', 'sent', 'failed')) AS confirmed FROM tickets WHERE {IN}),
e AS (SELECT count(DISTINCT conversationid) AS escalated FROM convs WHERE {IN} AND conversationid IN (SELECT conversationid FROM tickets WHERE status IN ('queued', 'sent', 'failed') AND {IN})), c AS (SELECT count(*) AS conversations FROM convs WHERE {IN})
SELECT *, round(CAST(confirmed AS DOUBLE) / total * 100, 1) AS confirmedratio, round(CAST(escalated AS DOUBLE) / conversations * 100, 1) AS ratio FROM x, e, c""")(lambda s, d: K.support_summary(T(s, d), A.conversations(s, d), START, END))
query("t4_j4_audit_page", "tickets courses", "SELECT ticketid, userid, 'User ' || userid AS username, t.courseid, rawname IS NOT NULL AS named FROM (SELECT * FROM tickets WHERE userid IN (SELECT c_custkey FROM customer) ORDER BY timecreated DESC, ticketid DESC LIMIT 25 OFFSET 50) t LEFT JOIN courses c ON c.courseid = t.courseid AND c.courseid % 4 <> 1")(
    lambda s, d: K.audit_page(T(s, d), users(s, d), A.courses(s, d).filter("courseid % 4 <> 1"), 50, 25).select("ticketid", "userid", "username", "courseid", F.col("fullname").isNotNull().alias("named"))
)
query("t4_audit_total", "tickets", "SELECT count(*) AS total FROM tickets WHERE userid IN (SELECT c_custkey FROM customer)")(lambda s, d: T(s, d).join(users(s, d), "userid", "left_semi").agg(F.count("*").alias("total")))
query("j9_orphans", "tickets convs", "SELECT ticketid FROM tickets WHERE conversationid NOT IN (SELECT conversationid FROM convs WHERE conversationid % 4 <> 0)")(lambda s, d: K.orphans(T(s, d), A.conversations(s, d).filter("conversationid % 4 <> 0")).select("ticketid"))
query("j12_duplicates", "tickets", f"SELECT t.ticketid, EXISTS (SELECT 1 FROM tickets p WHERE p.courseid = t.courseid AND p.userid = t.userid AND p.summaryhash = t.summaryhash AND p.{COUNTED} AND (p.timecreated, p.ticketid) < (t.timecreated, t.ticketid) AND p.timecreated >= t.timecreated - INTERVAL 72 HOUR) AS duplicate FROM tickets t")(
    lambda s, d: K.duplicates(T(s, d), 72).select("ticketid", "duplicate")
)
query("w6_quota_use", "tickets", f"""SELECT ticketid, count(*) FILTER ({COUNTED}) OVER (PARTITION BY courseid, userid, CAST(timecreated AS DATE) ORDER BY timecreated, ticketid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_today,
count(*) FILTER ({COUNTED}) OVER (PARTITION BY courseid, CAST(timecreated AS DATE) ORDER BY timecreated, ticketid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS course_today FROM tickets""")(lambda s, d: K.quota_use(T(s, d)).select("ticketid", "user_today", "course_today"))
_COOL = f"max(CASE WHEN {COUNTED} THEN timecreated END) OVER (PARTITION BY courseid, userid ORDER BY timecreated, ticketid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
query("w7_cool_down", "tickets", f"SELECT ticketid, CAST(floor(epoch(timecreated) - epoch({_COOL})) AS BIGINT) AS seconds_since FROM tickets")(lambda s, d: K.cool_down(T(s, d)).select("ticketid", "seconds_since"))
query("w9_supersede_drafts", "tickets", "SELECT ticketid, CASE WHEN status = 'draft' AND lead(ticketid) OVER (PARTITION BY conversationid, status ORDER BY timecreated, ticketid) IS NOT NULL THEN 'expired' ELSE status END AS status FROM tickets")(lambda s, d: K.supersede_drafts(T(s, d)).select("ticketid", "status"))
query("w10_pending_drafts", "tickets", "SELECT ticketid, conversationid FROM (SELECT *, row_number() OVER (PARTITION BY conversationid ORDER BY timecreated DESC, ticketid DESC) AS n FROM tickets WHERE status = 'draft' AND timecreated + INTERVAL 24 HOUR > TIMESTAMP '2024-01-20') WHERE n = 1")(lambda s, d: K.pending_drafts(T(s, d), "2024-01-20").select("ticketid", "conversationid"))
query("w11_last_refusals", "tickets", "SELECT conversationid, max(timemodified) AS since FROM tickets WHERE status = 'cancelled' GROUP BY 1")(lambda s, d: K.last_refusals(T(s, d)))
query("w14_recent_tickets", "tickets", "SELECT ticketid, nth FROM (SELECT ticketid, row_number() OVER (PARTITION BY courseid, userid ORDER BY timecreated DESC, ticketid DESC) AS nth FROM tickets WHERE status <> 'draft') WHERE nth <= 5")(lambda s, d: K.recent_tickets(T(s, d)).select("ticketid", F.col("nth").cast("bigint").alias("nth")))
query("a35_digest_due", "tickets", "SELECT courseid, min(timecreated) AS oldest, count(*) AS queued, string_agg(CAST(ticketid AS VARCHAR), ',' ORDER BY ticketid) AS ticketids FROM tickets WHERE status = 'queued' GROUP BY 1 HAVING min(timecreated) + INTERVAL 60 MINUTE <= TIMESTAMP '2024-01-02'")(
    lambda s, d: K.digest_due(T(s, d), "2024-01-02", 60).withColumn("ticketids", F.array_join(F.transform("ticketids", lambda x: x.cast("string")), ","))
)


def _raised(s, d):
    """Tickets on the turn conversations: one after turn 2 of every third."""
    return A.turns(s, d).filter("conversationid % 3 = 0 AND turn = 2").select("conversationid", F.col("turn").alias("raised"))


def _scripted(s, d):
    """Every fourth conversation's first turn asks for a person."""
    return A.turns(s, d).withColumn("content", F.when((F.col("conversationid") % 4 == 0) & (F.col("turn") == 0), "quiero hablar con una persona").otherwise(F.col("content")))


query("j16_unanswered_requests", "turns", """WITH m AS (SELECT conversationid, turn, lag(turn) OVER (PARTITION BY conversationid ORDER BY turn) AS prev FROM turns WHERE role = 'user')
SELECT conversationid, turn FROM m WHERE conversationid % 4 = 0 AND prev = 0 AND NOT (conversationid % 3 = 0 AND conversationid IN (SELECT conversationid FROM turns WHERE turn = 2))""")(lambda s, d: K.unanswered_requests(_scripted(s, d), _raised(s, d)))
query("x19_escalation_triggers")(
    lambda s, d: K.escalation_triggers(_scripted(s, d), _raised(s, d), A.turns(s, d).filter("role = 'assistant' AND conversationid % 7 = 1").select("conversationid", "turn"), A.turns(s, d).filter("role = 'assistant' AND conversationid % 11 = 2").select("conversationid", "turn"))
)
query("x20_escalation_gate", "tickets", f"""WITH q AS (SELECT ticketid, userid, count(*) FILTER ({COUNTED}) OVER (PARTITION BY courseid, userid, CAST(timecreated AS DATE) ORDER BY timecreated, ticketid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u,
count(*) FILTER ({COUNTED}) OVER (PARTITION BY courseid, CAST(timecreated AS DATE) ORDER BY timecreated, ticketid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c, floor(epoch(timecreated) - epoch({_COOL})) AS cool FROM tickets)
SELECT ticketid, CASE WHEN userid <= 0 THEN 'capability' WHEN u >= 1 THEN 'quota' WHEN cool < 43200 THEN 'cooldown' WHEN c >= 2 THEN 'coursequota' ELSE '' END AS denied FROM q""")(lambda s, d: K.escalation_gate(T(s, d), True, 1, 720, 2).select("ticketid", "denied"))


def _blocked(s, d):
    """What blocks conversations, by their number: some courses have support switched off, visitors may not ask, some users have used theirs up."""
    c = F.col("conversationid")
    why = F.when(c % 13 == 0, "disabled").when(c % 17 == 0, "capability").when(c % 19 == 0, "quota").when(c % 23 == 0, "cooldown").when(c % 29 == 0, "coursequota").otherwise("")
    return A.turns(s, d).select("conversationid").distinct().select(c, why.alias("denied"))


def _triggers(s, d):
    failures = A.turns(s, d).filter("role = 'assistant' AND conversationid % 7 = 1").select("conversationid", "turn")
    fallbacks = H.used_fallback(A.turns(s, d).filter("role = 'assistant'").withColumn("words", normalize_summary("content")), A.turns(s, d).filter("role = 'assistant' AND conversationid % 20 = 0").select(fingerprint("content").alias("fp")), "words")
    return K.escalation_triggers(A.turns(s, d), _raised(s, d), fallbacks.filter("fallback").select("conversationid", "turn"), failures)


query("x20_offer_gate", "turns")(
    lambda s, d: K.offer_gate(A.turns(s, d), _triggers(s, d), _blocked(s, d), A.turns(s, d).filter("conversationid % 5 = 2 AND turn = 2").select("conversationid", F.col("turn").alias("refused")), 2)
)
