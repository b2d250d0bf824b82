"""Queries over learners and governance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvane.operators import governance as G
from corvane.operators import learners as L
from corvane.operators.dashboard import active_enrolments
from corvane.operators.day_store import DayStore
from corvane.operators.rollup import build_userstats
from corvane.plans.registry import query
from corvane.session import shared_folder
from corvane.sources import adapters as A

NOW = "1996-06-01"
S = A.activity_state

query("a24_learner_progress", "activity", "SELECT userid, courseid, count(*) AS tracked, count(*) FILTER (state IN (1, 2)) AS complete, round(CAST(count(*) FILTER (state IN (1, 2)) AS DOUBLE) / count(*) * 100, 2) AS percent FROM activity GROUP BY ALL")(lambda s, d: L.learner_progress(S(s, d)))
query("a25_learner_grade_summary", "activity", "SELECT userid, courseid, count(*) FILTER (state = 0) AS pending, round(sum(grade) / count(*), 2) AS grade FROM activity GROUP BY ALL")(
    lambda s, d: L.learner_grade_summary(S(s, d), S(s, d).groupBy("userid", "courseid").agg((F.sum("grade") / F.count("*")).alias("grade")))
)
query("a29_submission_status", "activity", """WITH a AS (SELECT * REPLACE (CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE submitted END AS submitted) FROM activity)
SELECT orderkey, activityid, submitted, due, submitted IS NOT NULL AS issubmitted, coalesce(submitted > due, false) AS late
FROM (SELECT *, row_number() OVER (PARTITION BY orderkey, activityid ORDER BY submitted DESC NULLS LAST, l_partkey DESC, l_suppkey DESC) AS n FROM a) WHERE n = 1""")(
    lambda s, d: L.submission_status(S(s, d).withColumn("submitted", F.when(F.col("l_suppkey") % 4 != 0, F.col("submitted"))), ["orderkey", "activityid"], ["submitted", "l_partkey", "l_suppkey"]).select("orderkey", "activityid", "submitted", "due", "issubmitted", "late")
)


def _course_dates(s, d):
    return A.courses(s, d).select("courseid", "fullname", "shortname", "path", (F.col("courseid") % 6 != 5).alias("visible"), F.when(F.col("courseid") % 4 == 1, F.lit("1996-01-01").cast("date")).alias("enddate"))


query("a30_access_status", "enrolments courses", f"""WITH e AS (SELECT *, NOT suspended AND coalesce(timeend < DATE '{NOW}', false) AS over FROM enrolments), f AS (SELECT *, NOT suspended AND NOT over AND timestart > DATE '{NOW}' AS ahead FROM e),
g AS (SELECT userid, courseid, max(CASE WHEN over THEN timeend END) AS ended, min(CASE WHEN ahead THEN timestart END) AS starts, bool_or(NOT suspended AND NOT over AND NOT ahead) AS live FROM f GROUP BY ALL),
h AS (SELECT g.*, CASE WHEN NOT live AND ended IS NOT NULL THEN 'expired' WHEN NOT live AND starts IS NOT NULL THEN 'not_started' WHEN NOT live THEN 'suspended' WHEN courseid % 6 = 5 THEN 'course_hidden' WHEN courseid % 4 = 1 THEN 'course_ended' ELSE 'active' END AS status FROM g JOIN courses USING (courseid))
SELECT userid, courseid, status, CASE status WHEN 'expired' THEN ended WHEN 'not_started' THEN starts WHEN 'course_ended' THEN DATE '1996-01-01' END AS day FROM h""")(lambda s, d: L.access_status(A.enrolments(s, d), _course_dates(s, d), NOW))
query("j2_enrolment_reach", "enrolments courses", f"SELECT categoryid, count(DISTINCT userid) AS users FROM enrolments JOIN courses USING (courseid) WHERE NOT suspended AND timestart <= DATE '{NOW}' AND (timeend IS NULL OR timeend > DATE '{NOW}') GROUP BY 1")(
    lambda s, d: active_enrolments(A.enrolments(s, d), NOW).join(A.courses(s, d), "courseid").groupBy("categoryid").agg(F.countDistinct("userid").alias("users"))
)
query("f12_in_category_tree", "courses", "SELECT courseid FROM courses WHERE categoryid = 2")(lambda s, d: A.courses(s, d).filter(L.in_category_tree("path", "2")).select("courseid"))
query("f11_catalogue", "courses enrolments", "SELECT courseid, courseid IN (SELECT courseid FROM enrolments WHERE userid = 7) AS mine FROM courses WHERE courseid <> 1 AND courseid % 6 <> 5 AND (courseid % 4 <> 1 OR courseid IN (SELECT courseid FROM enrolments WHERE userid = 7))")(
    lambda s, d: L.catalogue(_course_dates(s, d), A.enrolments(s, d).filter("userid = 7"), 1, None, NOW).select("courseid", "mine")
)
query("t5_catalogue_page", "courses", "SELECT courseid, row_number() OVER (ORDER BY shortname) AS place, (SELECT count(*) FROM courses WHERE contains(shortname, 'nation')) > 4 AS has_more FROM (SELECT * FROM courses WHERE contains(shortname, 'nation') ORDER BY shortname LIMIT 3 OFFSET 1)")(
    lambda s, d: L.catalogue_page(A.courses(s, d).withColumn("fullname", F.col("shortname")), "Nation", 1, 3).select("courseid", F.col("place").cast("bigint").alias("place"), "has_more")
)
query("t7_my_courses", "activity courses", """WITH p AS (SELECT userid, courseid, CAST(count(*) FILTER (state IN (1, 2)) AS DOUBLE) / count(*) * 100 AS percent, max(submitted) AS lastaccess FROM activity GROUP BY ALL),
r AS (SELECT userid, courseid, lastaccess, row_number() OVER (PARTITION BY userid ORDER BY lastaccess DESC NULLS LAST, shortname, courseid) AS place FROM p JOIN courses USING (courseid) WHERE round(percent, 2) < 100) SELECT * FROM r WHERE place BETWEEN 2 AND 4""")(
    lambda s, d: L.my_courses(L.learner_progress(S(s, d)).join(S(s, d).groupBy("userid", "courseid").agg(F.max("submitted").alias("lastaccess")), ["userid", "courseid"]).join(A.courses(s, d).select("courseid", F.col("shortname").alias("fullname")), "courseid"), "inprogress", 1, 3).select("userid", "courseid", "lastaccess", F.col("place").cast("bigint").alias("place"))
)
query("t8_deadlines", "activity", f"""WITH e AS (SELECT DISTINCT userid, orderkey * 10 + activityid AS eventid, due FROM activity WHERE due BETWEEN DATE '{NOW}' - 7 AND DATE '{NOW}' + 30)
SELECT userid, eventid, due, due < DATE '{NOW}' AS overdue, place FROM (SELECT *, row_number() OVER (PARTITION BY userid ORDER BY due, eventid) AS place FROM e) WHERE place <= 5""")(
    lambda s, d: L.deadlines(S(s, d).select("userid", (F.col("orderkey") * 10 + F.col("activityid")).alias("eventid"), "due").distinct(), NOW, 30, 5).select("userid", "eventid", "due", "overdue", F.col("place").cast("bigint").alias("place"))
)


# ---- governance ----
CUT, TODAY = "2024-01-12", "2024-01-29"


def tables(s, d):
    """Conversations, messages and tickets; every seventh user counts as a visitor."""
    zero = F.when(F.col("userid") % 7 == 0, 0).otherwise(F.col("userid")).cast("bigint")
    return {n: f(s, d).withColumn("userid", zero) for n, f in (("conversations", A.conversations), ("messages", A.messages), ("tickets", A.tickets))}


def aged(s, d):
    """The same; tickets are modified days after they were made, some have lost their conversation and some never had one."""
    t = tables(s, d)
    later = F.expr("timecreated + make_dt_interval(CAST(ticketid % 17 AS INT))")
    conv = F.when(F.col("ticketid") % 5 == 0, -F.col("conversationid")).when(F.col("ticketid") % 11 == 0, F.col("conversationid") + 400).otherwise(F.col("conversationid"))
    return t | {"tickets": t["tickets"].withColumns({"timemodified": later, "conversationid": conv})}


def all_tables(s, d):
    """Also the daily counts of users, and the conversations a user began on each day (the legacy usage table)."""
    t = tables(s, d)
    began = t["conversations"].groupBy("userid", "courseid", F.to_date("timecreated").alias("day")).agg(F.count("*").alias("conversationcount"))
    return {**t, "userstats": build_userstats(t["messages"]), "usage": began}


_T = """c0 AS (SELECT * REPLACE (CASE WHEN userid % 7 = 0 THEN 0 ELSE userid END AS userid) FROM convs), m0 AS (SELECT * REPLACE (CASE WHEN userid % 7 = 0 THEN 0 ELSE userid END AS userid) FROM messages),
t0 AS (SELECT * REPLACE (CASE WHEN userid % 7 = 0 THEN 0 ELSE userid END AS userid) FROM tickets)"""
_N = "SELECT 'conversations' AS name, count(*) AS n FROM c UNION ALL SELECT 'messages', count(*) FROM m UNION ALL SELECT 'tickets', count(*) FROM t"
ALL = "convs messages tickets"
query("p1_purge_conversations", ALL, f"WITH {_T}, c AS (SELECT * FROM c0 WHERE timemodified >= TIMESTAMP '{CUT}'), m AS (SELECT * FROM m0 WHERE conversationid IN (SELECT conversationid FROM c)), t AS (SELECT * FROM t0) {_N}")(lambda s, d: G.counts(G.purge_conversations(tables(s, d), CUT)))
query("p2_purge_messages", ALL, f"WITH {_T}, c AS (SELECT * FROM c0), m AS (SELECT * FROM m0 WHERE timecreated >= TIMESTAMP '{CUT}'), t AS (SELECT * FROM t0) {_N}")(lambda s, d: G.counts(G.purge_messages(tables(s, d), CUT)))
_A = """t9 AS (SELECT * REPLACE (timecreated + to_days(CAST(ticketid % 17 AS INTEGER)) AS timemodified,
CASE WHEN ticketid % 5 = 0 THEN -conversationid WHEN ticketid % 11 = 0 THEN conversationid + 400 ELSE conversationid END AS conversationid) FROM t0)"""
_LEFT = "SELECT 'ticket' AS name, ticketid AS id, status FROM t UNION ALL SELECT 'conversation', conversationid, NULL FROM c UNION ALL SELECT 'message', messageid, NULL FROM m"


def left(t):
    """What is left, row by row."""
    tickets = t["tickets"].select(F.lit("ticket").alias("name"), F.col("ticketid").alias("id"), "status")
    others = [t[f"{n}s"].select(F.lit(n).alias("name"), F.col(f"{n}id").alias("id"), F.lit(None).cast("string").alias("status")) for n in ("conversation", "message")]
    return tickets.unionByName(others[0]).unionByName(others[1])


query("p3_purge_tickets", ALL, f"""WITH {_T}, {_A}, c AS (SELECT * FROM c0), m AS (SELECT * FROM m0), old AS (SELECT ticketid FROM t9 WHERE timemodified < TIMESTAMP '{CUT}' AND status <> 'draft'),
orphan AS (SELECT ticketid FROM t9 WHERE conversationid > 0 AND status <> 'draft' AND conversationid NOT IN (SELECT conversationid FROM c0)),
t AS (SELECT * FROM t9 WHERE ticketid NOT IN (SELECT ticketid FROM old) AND ticketid NOT IN (SELECT ticketid FROM orphan)) {_LEFT}""")(lambda s, d: left(G.purge_tickets(aged(s, d), CUT)))


def _stored(s, d):
    """Messages in a day store: two batches, one of them written twice, then a purge; of what is left, the days up to the first of February."""
    rows = A.messages(s, d).select("messageid", "userid", "role", "timecreated")
    store = DayStore(s, f"{shared_folder(s, 'spark-days-')}/days-{uuid.uuid4().hex}", rows.schema)
    for batch in (0, 1, 1):
        store.append(rows.filter(F.col("messageid") % 2 == batch), batch)
    store.purge(CUT)
    return store.read(None, "2024-02-01")


query("p2_purge_day_store", "messages", f"SELECT messageid, userid, role, timecreated, CAST(timecreated AS DATE) AS daterecorded FROM messages WHERE timecreated >= TIMESTAMP '{CUT}' AND timecreated < TIMESTAMP '2024-02-02'")(_stored)
_V = f"userid = 0 AND timemodified + INTERVAL 24 HOUR < TIMESTAMP '{TODAY}'"
query("p4_purge_visitors", ALL, f"WITH {_T}, c AS (SELECT * FROM c0 WHERE NOT ({_V})), m AS (SELECT * FROM m0 WHERE conversationid IN (SELECT conversationid FROM c)), t AS (SELECT * FROM t0) {_N}")(lambda s, d: G.counts(G.purge_visitors(tables(s, d), TODAY)))
query("p5_expire_drafts", "tickets", f"""WITH x AS (SELECT ticketid, status = 'draft' AND timecreated + INTERVAL 24 HOUR < TIMESTAMP '{TODAY}' AS stale, status, timemodified FROM tickets)
SELECT ticketid, CASE WHEN stale THEN 'expired' ELSE status END AS status, CASE WHEN stale THEN TIMESTAMP '{TODAY}' ELSE timemodified END AS timemodified FROM x""")(
    lambda s, d: G.expire_drafts(A.tickets(s, d), TODAY).select("ticketid", "status", "timemodified")
)
_U = """u0 AS (SELECT courseid, blockinstanceid, CAST(timecreated AS DATE) AS daterecorded, userid, count(*) AS numquestions FROM m0 WHERE role = 'user' GROUP BY ALL),
g0 AS (SELECT userid, courseid, CAST(timecreated AS DATE) AS day, count(*) AS conversationcount FROM c0 GROUP BY ALL)"""
query("p6_erase_subject", ALL, f"""WITH {_T}, {_U}, c AS (SELECT * FROM c0 WHERE userid NOT IN (5, 12)), m AS (SELECT * FROM m0 WHERE conversationid IN (SELECT conversationid FROM c)), t AS (SELECT * FROM t0 WHERE userid NOT IN (5, 12)) {_N}
UNION ALL SELECT 'userstats', count(*) FROM u0 WHERE userid NOT IN (5, 12) UNION ALL SELECT 'usage', count(*) FROM g0 WHERE userid NOT IN (5, 12)""")(
    lambda s, d: G.counts(G.erase_subject(all_tables(s, d), s.range(0, 20, 1, 1).filter("id IN (5, 12)").select(F.col("id").alias("userid"))))
)
_GONE = f"""c1 AS (SELECT * FROM c0 WHERE NOT ({_V})), m1 AS (SELECT * FROM m0 WHERE conversationid NOT IN (SELECT conversationid FROM c0 WHERE {_V}))"""
query("p8_retention", ALL, f"""WITH {_T}, {_A}, {_GONE}, x AS (SELECT *, status = 'draft' AND timecreated + INTERVAL 24 HOUR < TIMESTAMP '{TODAY}' AS stale FROM t9),
t1 AS (SELECT * REPLACE (CASE WHEN stale THEN 'expired' ELSE status END AS status, CASE WHEN stale THEN TIMESTAMP '{TODAY}' ELSE timemodified END AS timemodified) FROM x),
c AS (SELECT * FROM c1 WHERE timemodified >= TIMESTAMP '{CUT}'), m AS (SELECT * FROM m1 WHERE timecreated >= TIMESTAMP '{CUT}' AND conversationid NOT IN (SELECT conversationid FROM c1 WHERE timemodified < TIMESTAMP '{CUT}')),
t AS (SELECT * FROM t1 WHERE status = 'draft' OR (timemodified >= TIMESTAMP '{CUT}' AND (conversationid <= 0 OR conversationid IN (SELECT conversationid FROM c)))) {_LEFT}""")(lambda s, d: left(G.retention(aged(s, d), TODAY, CUT)))
query("p8_retention_off", ALL, f"WITH {_T}, {_A}, {_GONE}, c AS (SELECT * FROM c1), m AS (SELECT * FROM m1), t AS (SELECT * FROM t9) {_LEFT}")(lambda s, d: left(G.retention(aged(s, d), TODAY, None)))
query("u1_subject_contexts", ALL, f"WITH {_T}, {_U} SELECT userid, courseid FROM c0 UNION SELECT userid, courseid FROM m0 UNION SELECT userid, courseid FROM t0 UNION SELECT userid, courseid FROM u0 UNION SELECT userid, courseid FROM g0")(lambda s, d: G.subject_contexts(all_tables(s, d)))
query("u2_users_in_context", ALL, f"WITH {_T} SELECT userid FROM c0 WHERE courseid = 3 UNION SELECT userid FROM m0 WHERE courseid = 3 UNION SELECT userid FROM t0 WHERE courseid = 3")(lambda s, d: G.users_in_context(tables(s, d), 3))
query("s13_export_subject", ALL, f"WITH {_T}, c AS (SELECT userid, courseid, count(DISTINCT conversationid) AS n, count(messageid) AS said FROM c0 LEFT JOIN (SELECT conversationid, messageid FROM m0) USING (conversationid) GROUP BY ALL), t AS (SELECT userid, courseid, count(*) AS tickets FROM t0 GROUP BY ALL) SELECT userid, courseid, coalesce(n, 0) AS conversations, CAST(coalesce(said, 0) AS BIGINT) AS messages, coalesce(tickets, 0) AS tickets FROM c FULL JOIN t USING (userid, courseid)")(
    lambda s, d: (lambda t: G.export_subject(t, t["conversations"].select("userid").distinct()))(tables(s, d)).select(
        "userid", "courseid", F.coalesce(F.size("conversations"), F.lit(0)).cast("bigint").alias("conversations"), F.coalesce(F.aggregate("conversations", F.lit(0), lambda n, c: n + F.coalesce(F.size(c["messages"]), F.lit(0))), F.lit(0)).cast("bigint").alias("messages"), F.coalesce(F.size("tickets"), F.lit(0)).cast("bigint").alias("tickets"))
)
