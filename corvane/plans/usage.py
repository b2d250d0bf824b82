"""Queries over rollups: facts, dashboard figures, costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.text import fold_accents
from corvane.operators import dashboard as D
from corvane.operators import rollup as R
from corvane.plans.registry import query
from corvane.sources import adapters as A

FIRST, LAST, NOW = "2024-01-05", "2024-01-25", "1996-01-01"
RANGE = f"daterecorded BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"
LIVE = f"NOT suspended AND timestart <= DATE '{NOW}' AND (timeend IS NULL OR timeend > DATE '{NOW}')"


def facts(s, d):
    return R.message_facts(A.messages(s, d), A.conversations(s, d), A.agents(s))


def stats(s, d):
    return R.build_msgstats(facts(s, d))


def users(s, d):
    return R.build_userstats(A.messages(s, d))


def rounded(df, **places):
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


query("s1_scan_messages", "messages", "SELECT messageid, userid, role, model, totaltokens FROM messages WHERE timecreated >= TIMESTAMP '2024-01-10' AND timecreated < TIMESTAMP '2024-01-12'")(
    lambda s, d: R.in_range(A.messages(s, d), "2024-01-10", "2024-01-12").select("messageid", "userid", "role", "model", "totaltokens")
)
query("s2_s3_tool_log", "toollog", "SELECT tool, ok, count(*) AS calls FROM toollog WHERE daterecorded >= DATE '2024-01-10' AND daterecorded < DATE '2024-01-12' GROUP BY ALL")(
    lambda s, d: R.in_range(A.tool_log(s, d).filter("eventname = 'tool_called'"), "2024-01-10", "2024-01-12").select(R.parse_tool_payload()[0].alias("tool"), R.parse_tool_payload()[1].alias("ok")).groupBy("tool", "ok").agg(F.count("*").alias("calls"))
)
query("j1_message_facts", "messages convs agents", "SELECT m.messageid, m.agentid, left(coalesce(nullif(trim(m.model), ''), defaultmodel, ''), 100) AS model FROM messages m JOIN convs USING (conversationid) LEFT JOIN agents a ON a.agentid = m.agentid")(
    lambda s, d: facts(s, d).select("messageid", "agentid", "model")
)
query("a1_build_msgstats", "msgstats", "SELECT * FROM msgstats")(stats)
query("a2_build_userstats", "userstats", "SELECT * FROM userstats")(users)
query("a3_build_toolstats", "toolstats", "SELECT * FROM toolstats")(lambda s, d: R.build_toolstats(A.tool_log(s, d)))
query("f2_f3_day_and_course_filter", "msgstats", f"SELECT courseid, daterecorded, CAST(sum(messages) AS BIGINT) AS messages FROM msgstats WHERE {RANGE} AND courseid IN (1, 7, 12) GROUP BY ALL")(
    lambda s, d: D.course_filter(D.day_range(stats(s, d), FIRST, LAST), [1, 7, 12]).groupBy("courseid", "daterecorded").agg(F.sum("messages").alias("messages"))
)
query("f4_courses_matching", "courses", "SELECT courseid FROM courses WHERE contains(shortname, 'ation_1')")(lambda s, d: D.courses_matching(A.courses(s, d), "ÁTIÓN_1", fold_accents))
_OVERVIEW = """SELECT CAST(coalesce(sum(messages) FILTER (role = 'user'), 0) AS BIGINT) AS questions, CAST(coalesce(sum(messages) FILTER (role = 'assistant'), 0) AS BIGINT) AS answers,
CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(prompttokens) AS BIGINT) AS prompttokens, CAST(sum(completiontokens) AS BIGINT) AS completiontokens,
CAST(sum(totaltokens) AS BIGINT) AS totaltokens, CAST(least(sum(cachedtokens), sum(prompttokens)) AS BIGINT) AS cachedtokens FROM msgstats"""
query("a4_overview", "msgstats", f"{_OVERVIEW} WHERE {RANGE}")(lambda s, d: D.overview(D.day_range(stats(s, d), FIRST, LAST)))
query("a5_reach", "userstats", f"SELECT count(DISTINCT userid) AS activeusers, count(DISTINCT courseid) AS activecourses FROM userstats WHERE {RANGE}")(lambda s, d: D.reach(D.day_range(users(s, d), FIRST, LAST)))
query("a6_recurrent_users", "userstats", "SELECT count(*) AS recurrentusers FROM (SELECT userid FROM userstats GROUP BY userid HAVING count(DISTINCT daterecorded) >= 2)")(lambda s, d: D.recurrent_users(users(s, d)))
query("a7_conversations_started", "convs", f"SELECT count(*) AS conversations FROM convs WHERE CAST(timecreated AS DATE) BETWEEN DATE '{FIRST}' AND DATE '{LAST}'")(lambda s, d: D.conversations_started(A.conversations(s, d), FIRST, LAST))
query("f10_active_enrolment", "enrolments", f"SELECT enrolmentid, userid, courseid FROM enrolments WHERE {LIVE}")(lambda s, d: D.active_enrolments(A.enrolments(s, d), NOW).select("enrolmentid", "userid", "courseid"))
query("a8_exposed_participants", "enrolments configured", f"SELECT count(DISTINCT userid) AS exposed FROM enrolments WHERE {LIVE} AND courseid IN (SELECT courseid FROM configured)")(lambda s, d: D.exposed_participants(A.enrolments(s, d), A.configured_courses(s), NOW))
query("a9_exposed_by_course", "enrolments configured", f"SELECT courseid, count(DISTINCT userid) AS enrolled FROM enrolments WHERE {LIVE} AND courseid IN (SELECT courseid FROM configured) GROUP BY courseid")(lambda s, d: D.exposed_by_course(A.enrolments(s, d), A.configured_courses(s), NOW))
query(
    "a10_overview_ratios",
    "msgstats userstats convs enrolments configured",
    f"""WITH o AS ({_OVERVIEW} WHERE {RANGE}), u AS (SELECT count(DISTINCT userid) AS active FROM userstats WHERE {RANGE}),
    r AS (SELECT count(*) AS rec FROM (SELECT userid FROM userstats WHERE {RANGE} GROUP BY userid HAVING count(DISTINCT daterecorded) >= 2)),
    c AS (SELECT count(*) AS convs FROM convs WHERE CAST(timecreated AS DATE) BETWEEN DATE '{FIRST}' AND DATE '{LAST}'),
    e AS (SELECT count(DISTINCT userid) AS exposed FROM enrolments WHERE {LIVE} AND courseid IN (SELECT courseid FROM configured))
    SELECT round(CASE WHEN exposed > 0 THEN active / exposed ELSE 0 END, 6) AS adoption, round(CASE WHEN active > 0 THEN rec / active ELSE 0 END, 6) AS recurrence,
    round(CASE WHEN answers > 0 THEN errors / answers ELSE 0 END, 6) AS errorrate, round(CASE WHEN active > 0 THEN questions / active ELSE 0 END, 6) AS questionsperuser,
    round(CASE WHEN exposed > 0 THEN questions / exposed ELSE 0 END, 6) AS questionsperenrolled, round(CASE WHEN convs > 0 THEN questions / convs ELSE 0 END, 6) AS turnsperconversation,
    round(CASE WHEN prompttokens > 0 THEN cachedtokens / prompttokens ELSE 0 END, 6) AS cachehitrate FROM o, u, r, c, e""",
)(lambda s, d: (lambda x: x.select(*(F.round(c, 6).alias(c) for c in x.columns)))(D.overview_ratios(stats(s, d), users(s, d), A.conversations(s, d), A.enrolments(s, d), A.configured_courses(s), FIRST, LAST, NOW)))
query("a11_a12_route_breakdown", "msgstats", "SELECT coalesce(nullif(route, ''), 'unknown') AS route, CAST(sum(messages) AS BIGINT) AS answers, round(sum(messages) / sum(sum(messages)) OVER (), 6) AS share FROM msgstats WHERE role = 'assistant' GROUP BY 1")(
    lambda s, d: rounded(D.route_breakdown(stats(s, d)), share=6)
)
query(
    "a13_timeseries",
    "msgstats userstats",
    f"""WITH days AS (SELECT CAST(unnest(generate_series(DATE '{FIRST}', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS daterecorded),
    q AS (SELECT daterecorded, sum(messages) AS n FROM msgstats WHERE role = 'user' GROUP BY 1), u AS (SELECT daterecorded, count(DISTINCT userid) AS n FROM userstats GROUP BY 1)
    SELECT daterecorded, CAST(coalesce(q.n, 0) AS BIGINT) AS questions, coalesce(u.n, 0) AS users FROM days LEFT JOIN q USING (daterecorded) LEFT JOIN u USING (daterecorded)""",
)(lambda s, d: D.timeseries(stats(s, d), users(s, d), FIRST, "2024-02-05"))
query(
    "a14_recurrence_histogram",
    "userstats",
    """WITH days AS (SELECT userid, count(DISTINCT daterecorded) AS n FROM userstats GROUP BY 1)
    SELECT bucket, count(userid) AS users FROM (VALUES ('1', 1, 1), ('2-3', 2, 3), ('4+', 4, 1000000)) b(bucket, lo, hi) LEFT JOIN days ON n BETWEEN lo AND hi GROUP BY bucket""",
)(lambda s, d: D.recurrence_histogram(users(s, d)))
_PRICED = """WITH daily AS (SELECT model, daterecorded, sum(prompttokens) AS prompt, least(sum(cachedtokens), sum(prompttokens)) AS cached, sum(completiontokens) AS completion, sum(totaltokens) AS total,
regexp_replace(lower(trim(model)), '^models/', '') AS name, regexp_replace(regexp_replace(lower(trim(model)), '^models/', ''), '-([0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2})$', '') AS base
FROM msgstats GROUP BY model, daterecorded HAVING sum(totaltokens) > 0 OR sum(prompttokens) > 0),
priced AS (SELECT daily.*, coalesce(a.input, b.input) AS pin, coalesce(a.output, b.output) AS pout, CASE WHEN a.input IS NOT NULL THEN a.cached ELSE b.cached END AS pcached FROM daily
LEFT JOIN prices a ON a.model = name AND daterecorded >= a.valid_from AND daterecorded < a.valid_to LEFT JOIN prices b ON b.model = base AND daterecorded >= b.valid_from AND daterecorded < b.valid_to),
costs AS (SELECT model, CAST(sum(prompt) AS BIGINT) AS prompttokens, CAST(sum(cached) AS BIGINT) AS cachedtokens, CAST(sum(completion) AS BIGINT) AS completiontokens, CAST(sum(total) AS BIGINT) AS totaltokens,
sum(coalesce(((prompt - cached) * pin + cached * pcached + completion * pout) / 1e6, 0)) AS cost, bool_and(pin IS NOT NULL) AS haspricing FROM priced GROUP BY model)"""
query("a15_cost_by_model", "msgstats prices", f"{_PRICED} SELECT * REPLACE (round(cost, 6) AS cost) FROM costs")(lambda s, d: rounded(D.cost_by_model(stats(s, d), A.prices(s)), cost=6))
query("t2_models_by_tokens", "msgstats prices", f"{_PRICED} SELECT model, totaltokens, row_number() OVER (ORDER BY totaltokens DESC, model) AS place FROM costs ORDER BY totaltokens DESC, model LIMIT 3")(
    lambda s, d: D.cost_by_model(stats(s, d), A.prices(s)).orderBy(F.desc("totaltokens"), "model").limit(3).select("model", "totaltokens", F.expr("row_number() OVER (ORDER BY totaltokens DESC, model)").cast("bigint").alias("place"))
)
query("a16_cost_kpis", "msgstats prices", f"{_PRICED} SELECT round(sum(cost), 6) AS totalcost, round(sum(cost) / (SELECT sum(messages) FROM msgstats WHERE role = 'user'), 9) AS costperquestion, round(sum(cachedtokens) / sum(prompttokens), 6) AS cachedshare FROM costs")(
    lambda s, d: rounded(D.cost_kpis(stats(s, d), A.prices(s)), totalcost=6, costperquestion=9, cachedshare=6)
)
query(
    "j7_j8_as_of_prices",
    "msgstats prices",
    f"{_PRICED} SELECT model, daterecorded, pin AS input, pout AS output, pcached AS cached FROM priced",
)(lambda s, d: R.with_prices(stats(s, d).groupBy("model", "daterecorded").agg(F.sum("totaltokens").alias("t"), F.sum("prompttokens").alias("p")).filter("t > 0 OR p > 0"), R.price_periods(A.prices(s))).select("model", "daterecorded", "price.input", "price.output", "price.cached"))
query("a17_tool_breakdown", "toolstats", "SELECT toolname, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(ok) AS BIGINT) AS ok, CAST(sum(fail) AS BIGINT) AS fail, round(sum(ok) / sum(calls), 6) AS successrate FROM toolstats GROUP BY 1")(
    lambda s, d: rounded(D.tool_breakdown(R.build_toolstats(A.tool_log(s, d))), successrate=6)
)
query("t3_tools_by_calls", "toolstats", "SELECT toolname, CAST(sum(calls) AS BIGINT) AS calls FROM toolstats GROUP BY 1 ORDER BY calls DESC, toolname LIMIT 3")(
    lambda s, d: D.tool_breakdown(R.build_toolstats(A.tool_log(s, d))).orderBy(F.desc("calls"), "toolname").limit(3).select("toolname", "calls")
)


def _rows_sql(key: str, where: str, enrolled: str, exists: str) -> str:
    return f"""m AS (SELECT {key} AS id, coalesce(sum(messages) FILTER (role = 'user'), 0) AS questions, coalesce(sum(messages) FILTER (role = 'assistant'), 0) AS answers, sum(errors) AS errors, sum(totaltokens) AS totaltokens FROM msgstats WHERE {where} GROUP BY 1),
    u AS (SELECT id, count(*) AS users, count(*) FILTER (n >= 2) AS recurrent FROM (SELECT {key} AS id, userid, count(DISTINCT daterecorded) AS n FROM userstats WHERE {where} GROUP BY ALL) GROUP BY 1),
    e AS ({enrolled}),
    x AS (SELECT id, CAST(coalesce(users, 0) AS BIGINT) AS users, CAST(coalesce(recurrent, 0) AS BIGINT) AS recurrent, CAST(coalesce(questions, 0) AS BIGINT) AS questions, CAST(coalesce(answers, 0) AS BIGINT) AS answers, CAST(coalesce(errors, 0) AS BIGINT) AS errors,
    CAST(coalesce(totaltokens, 0) AS BIGINT) AS totaltokens, CAST(coalesce(enrolled, 0) AS BIGINT) AS enrolled FROM m FULL JOIN u USING (id) LEFT JOIN e USING (id) WHERE {exists}),
    y AS (SELECT *, round(CASE WHEN answers > 0 THEN errors / answers ELSE 0 END, 6) AS errorrate, round(CASE WHEN enrolled > 0 THEN users / enrolled ELSE 0 END, 6) AS adoption FROM x)"""


_ENROLLED = f"SELECT courseid AS id, count(DISTINCT userid) AS enrolled FROM enrolments WHERE {LIVE} AND courseid IN (SELECT courseid FROM configured) GROUP BY 1"


def _enrolled(s, d):
    return D.exposed_by_course(A.enrolments(s, d), A.configured_courses(s), NOW)


def _course_rows(s, d):
    live = A.courses(s, d).filter("courseid % 10 <> 4").select("courseid")  # the others count as deleted
    return rounded(D.course_rows(stats(s, d), users(s, d), live, _enrolled(s, d)), errorrate=6, adoption=6)


def _platform_rows(s, d):
    return rounded(D.platform_rows(stats(s, d), users(s, d), 1), errorrate=6, adoption=6)


query("a18_course_rows", "msgstats userstats enrolments configured courses", f"WITH {_rows_sql('courseid', 'true', _ENROLLED, 'id IN (SELECT courseid FROM courses WHERE courseid % 10 <> 4)')} SELECT * RENAME (id AS courseid) FROM y")(_course_rows)
query("a19_platform_rows", "msgstats userstats", f"WITH {_rows_sql('blockinstanceid', 'courseid = 1', 'SELECT CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS enrolled', 'true')} SELECT * RENAME (id AS blockinstanceid) FROM y")(_platform_rows)
_PLATFORM = _rows_sql("blockinstanceid", "courseid = 1", "SELECT CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS enrolled", "true")
query("u6_scope_rows", "msgstats userstats enrolments configured courses", f"""SELECT *, 'course' AS scope FROM (WITH {_rows_sql('courseid', 'true', _ENROLLED, 'id IN (SELECT courseid FROM courses WHERE courseid % 10 <> 4)')} SELECT * FROM y)
UNION ALL SELECT *, 'platform' FROM (WITH {_PLATFORM} SELECT * FROM y)""")(lambda s, d: D.scope_rows(_course_rows(s, d), _platform_rows(s, d)))
query("t1_busiest_courses", "msgstats enrolments configured", f"WITH t AS (SELECT courseid, CAST(sum(messages) AS BIGINT) AS questions FROM msgstats WHERE role = 'user' GROUP BY 1 ORDER BY questions DESC, courseid LIMIT 5), e AS ({_ENROLLED}) SELECT courseid, questions, coalesce(enrolled, 0) AS enrolled FROM t LEFT JOIN e ON id = courseid")(
    lambda s, d: D.busiest_courses(stats(s, d), _enrolled(s, d), 5)
)
query("u4_configured_in_use", "configured userstats", "SELECT courseid FROM configured INTERSECT SELECT courseid FROM userstats")(lambda s, d: A.configured_courses(s).intersect(users(s, d).select("courseid")))
query("rollup_totals", "msgstats", "SELECT courseid, role, CAST(sum(messages) AS BIGINT) AS messages FROM msgstats GROUP BY ROLLUP (courseid, role)")(lambda s, d: stats(s, d).rollup("courseid", "role").agg(F.sum("messages").alias("messages")))
