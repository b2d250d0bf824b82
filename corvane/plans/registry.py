"""Registered queries and their SQL, and the driver-table views as SQL."""

from __future__ import annotations

from collections.abc import Callable

from corvane.sources.adapters import PROBES

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

_K = "CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT)"
_ASKED = "event_type IN ('view', 'click', 'signup')"


def _tokens(x: int) -> str:
    return f"CASE WHEN {_ASKED} THEN 0 ELSE CAST(floor(value * {x}) AS BIGINT) END"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "messages": (
        (),
        f"""SELECT event_id AS messageid, user_id AS userid, user_id * 1000 + dayofyear(ts) AS conversationid, user_id % 25 AS courseid,
        user_id // 25 % 3 AS blockinstanceid, CASE WHEN {_ASKED} THEN 'user' ELSE 'assistant' END AS role,
        ['tutor', 'assistant', 'ambiguous', ''][{_K} % 4 + 1] AS route, {_K} % 3 AS agentid,
        ['gpt-5-mini', 'gpt-4.1-mini-2025-04-14', 'gemini-3.8-flash', '', 'house-model'][{_K} % 5 + 1] AS model,
        {_tokens(10)} AS prompttokens, {_tokens(4)} AS cachedtokens, {_tokens(2)} AS completiontokens,
        {_tokens(10)} + {_tokens(2)} AS totaltokens, CASE WHEN event_type = 'error' THEN 'apierror' ELSE '' END AS errormessage,
        ts AS timecreated, CAST(ts AS DATE) AS daterecorded FROM events""",
    ),
    "convs": (
        ("messages",),
        "SELECT conversationid, userid, courseid, blockinstanceid, min(timecreated) AS timecreated, max(timecreated) AS timemodified FROM messages GROUP BY ALL",
    ),
    "agents": ((), "SELECT * FROM (VALUES (0, 'tutor', 'gpt-4.1-nano'), (1, 'assistant', 'gpt-5-mini'), (2, 'ambiguous', 'gemini-2.5-flash')) t(agentid, agenttype, defaultmodel)"),
    "prices": (
        (),
        """SELECT model, CAST(valid_from AS DATE) AS valid_from, CAST(input AS DOUBLE) AS input, CAST(output AS DOUBLE) AS output, CAST(cached AS DOUBLE) AS cached,
        coalesce(lead(CAST(valid_from AS DATE)) OVER (PARTITION BY model ORDER BY valid_from), DATE '9999-12-31') AS valid_to
        FROM (VALUES ('gpt-5-mini', '1970-01-01', 0.25, 2.0, 0.025), ('gpt-4.1-mini', '1970-01-01', 0.4, 1.6, 0.1), ('gpt-4.1-nano', '1970-01-01', 0.1, 0.4, 0.025),
        ('gemini-2.5-flash', '1970-01-01', 0.3, 2.5, 0.03), ('gemini-3.8-flash', '1970-01-01', 0.75, 3.75, 0.075), ('gemini-3.8-flash', '2024-01-15', 1.5, 7.5, 0.15))
        t(model, valid_from, input, output, cached)""",
    ),
    "configured": ((), "SELECT CAST(range AS BIGINT) AS courseid FROM range(25) WHERE range % 3 = 0"),
    "msgstats": (
        ("messages", "convs", "agents"),
        """SELECT m.courseid, m.blockinstanceid, daterecorded, role, trim(route) AS route, m.agentid,
        left(coalesce(nullif(trim(m.model), ''), defaultmodel, ''), 100) AS model, count(*) AS messages,
        CAST(count(*) FILTER (trim(errormessage) <> '') AS BIGINT) AS errors, CAST(sum(prompttokens) AS BIGINT) AS prompttokens, CAST(sum(cachedtokens) AS BIGINT) AS cachedtokens,
        CAST(sum(completiontokens) AS BIGINT) AS completiontokens, CAST(sum(totaltokens) AS BIGINT) AS totaltokens
        FROM messages m JOIN convs c USING (conversationid) LEFT JOIN agents a ON m.agentid = a.agentid GROUP BY ALL""",
    ),
    "userstats": (("messages",), "SELECT courseid, blockinstanceid, daterecorded, userid, count(*) AS numquestions FROM messages WHERE role = 'user' GROUP BY ALL"),
    "toollog": ((), f"SELECT user_id % 25 AS courseid, CAST(ts AS DATE) AS daterecorded, event_type AS tool, {_K} >= 20 AS ok FROM events"),
    "toolstats": (("toollog",), "SELECT courseid, daterecorded, tool AS toolname, count(*) AS calls, CAST(count(*) FILTER (ok) AS BIGINT) AS ok, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS fail FROM toollog GROUP BY ALL"),
    "tickets": (
        (),
        f"""SELECT event_id AS ticketid, user_id % 25 AS courseid, user_id // 25 % 3 AS blockinstanceid, user_id AS userid, user_id * 1000 + dayofyear(ts) AS conversationid,
        ['acceso', 'notas', 'entrega', 'contenido', 'otro'][{_K} % 5 + 1] AS category, sha1(CAST({_K} % 10 AS VARCHAR)) AS summaryhash,
        ['draft', 'queued', 'sent', 'failed', 'cancelled', 'expired'][{_K} % 6 + 1] AS status, ts AS timecreated, ts AS timemodified
        FROM events WHERE event_type = 'error'""",
    ),
    "enrolments": (
        (),
        """SELECT o_orderkey AS enrolmentid, o_custkey AS userid, o_orderkey % 25 AS courseid, CAST(o_orderdate AS DATE) AS timestart,
        CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_orderdate AS DATE) + 365 END AS timeend, o_orderstatus = 'P' AS suspended FROM orders""",
    ),
    "activity": (
        (),
        """SELECT o_custkey AS userid, o_orderkey % 25 AS courseid, l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS activityid,
        CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 1 ELSE 0 END AS state, CAST(o_orderdate AS DATE) + 60 AS due, CAST(l_shipdate AS DATE) AS submitted,
        l_quantity AS grade, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "courses": ((), "SELECT CAST(n_nationkey AS BIGINT) AS courseid, n_name AS rawname, lower(n_name) AS shortname, CAST(n_regionkey AS BIGINT) AS categoryid FROM nation"),
    "turns": ((), "SELECT conv_id AS conversationid, turn, role, text AS content FROM conversations"),
    "said": (("turns",), "SELECT * FROM turns UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({c}, {t}, '{r}', {_literal(x)})" for c, t, r, x in PROBES) + ") p(conversationid, turn, role, content)"),
    "docchunks": (
        (),
        """SELECT doc_id, doc_id % 5 AS courseid, source AS filename, lang <> 'de' AS citable, CAST(i AS BIGINT) AS chunkindex, substring(text, CAST(i * 1000 + 1 AS BIGINT), 1200) AS content
        FROM documents, unnest(range(CAST(greatest(1, ceil((length(text) - 200) / 1000.0)) AS BIGINT))) u(i) WHERE text IS NOT NULL AND text <> ''""",
    ),
    "questions": ((), "SELECT item_id AS queryid, text AS query, item_id % 5 AS courseid FROM benchmark"),
}


def sql(views: str, body: str) -> str:
    """A statement with the named views (space-separated) and those they need in front."""
    order: list[str] = []

    def need(v: str) -> None:
        for x in VIEWS[v][0]:
            need(x)
        if v not in order:
            order.append(v)

    for v in views.split():
        need(v)
    body = body.strip()
    ctes = [f"{v} AS ({VIEWS[v][1]})" for v in order]
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ", ".join(ctes) + ", " + body[5:]
    return "WITH " + ", ".join(ctes) + " " + body


def query(name: str, views: str = "", oracle: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame and its SQL."""

    def wrap(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = sql(views, oracle)
        return f

    return wrap
