"""Queries over streams: each runs what is there through a stream and reads its sink."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvane.operators import index_store as I
from corvane.operators import knowledge as K
from corvane.operators import limits as L
from corvane.operators import rollup as R
from corvane.plans.registry import query
from corvane.session import shared_folder, table
from corvane.sources import adapters as A
from corvane.streaming import decisions as D
from corvane.streaming import streams as S


def shared(spark) -> str:
    return f"{shared_folder(spark, 'spark-stream-')}/stream-{uuid.uuid4().hex}"


def arriving(spark, d, name):
    """A table as a stream: its one file, or the files in its folder. A path that is a pattern may be either."""
    return S.read_folder(spark, f"{d}/{{{name}}}.parquet", table(spark, d, name).schema)


def event_stream(spark, d):
    """The events table as a stream, with the columns of messages."""
    raw = arriving(spark, d, "events")
    asked = F.col("event_type").isin("view", "click", "signup")
    return raw.select(F.col("event_id").alias("messageid"), F.col("user_id").alias("userid"), (F.col("user_id") % 25).alias("courseid"), F.expr("user_id div 25 % 3").alias("blockinstanceid"), F.when(asked, "user").otherwise("assistant").alias("role"), F.col("ts").cast("timestamp").alias("timecreated"))


def _daily(s, d):
    at = shared(s)
    S.run_available(event_stream(s, d), S.rollup_sink(f"{at}/facts", f"{at}/rollup", R.build_userstats), f"{at}/state")
    return s.read.parquet(f"{at}/rollup").select("courseid", "blockinstanceid", "daterecorded", "userid", "numquestions")


query("g1_daily_rollup_stream", "userstats", "SELECT * FROM userstats")(_daily)
#: Bursts: the events' clock runs an hour in a minute, so that a month of events is half a day with a midnight in it.
HURRY = 6_000_000_000
HURRIED = f"make_timestamp(epoch_us(timecreated) // 60 - {HURRY})"


def hurried(ts):
    return F.timestamp_micros((F.unix_micros(F.col(ts).cast("timestamp")) / 60).cast("bigint") - F.lit(HURRY)).cast("timestamp_ntz")


def asked_in_bursts(s, d):
    return A.messages(s, d).filter("role = 'user'").withColumn("timecreated", hurried("timecreated")).select("messageid", "userid", "timecreated")


# what a minute accepts at most, then what the minutes before it have accepted on that day
_G2 = f"""WITH q AS (SELECT messageid, userid, {HURRIED} AS ts FROM messages WHERE role = 'user'),
n AS (SELECT *, row_number() OVER (PARTITION BY userid, date_trunc('minute', ts) ORDER BY ts, messageid) AS nth FROM q),
c AS (SELECT userid, date_trunc('minute', ts) AS minute, least(count(*), 2) AS most FROM q GROUP BY ALL),
p AS (SELECT *, coalesce(sum(most) OVER (PARTITION BY userid, CAST(minute AS DATE) ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT messageid, NOT (nth <= 2 AND before + nth <= 15) AS denied FROM n JOIN p ON p.userid = n.userid AND p.minute = date_trunc('minute', n.ts)"""
query("g2_rate_limit", "messages", _G2)(
    lambda s, d: L.over_limit(asked_in_bursts(s, d), "userid", 2, 15).select("messageid", "denied")
)


def _counted(s, d, size):
    at = shared(s)
    S.to_folder(S.window_counts(event_stream(s, d).filter("role = 'user'"), ["userid"], size, "0 seconds"), f"{at}/out", f"{at}/state")
    return s.read.schema("userid long, start timestamp, n long").parquet(f"{at}/out")


# a window comes out once the stream is past its end
_CLOSED = "(SELECT max(timecreated) FROM messages WHERE role = 'user')"
query("g2_window_count_stream", "messages", f"SELECT * FROM (SELECT userid, CAST(timecreated AS DATE) AS day, count(*) AS n FROM messages WHERE role = 'user' GROUP BY ALL) WHERE day + INTERVAL 1 DAY <= {_CLOSED}")(
    lambda s, d: _counted(s, d, "1 day").select("userid", F.to_date("start").alias("day"), "n")
)
query("g2_minute_count_stream", "messages", f"SELECT * FROM (SELECT userid, date_trunc('minute', timecreated) AS minute, count(*) AS n FROM messages WHERE role = 'user' GROUP BY ALL) WHERE minute + INTERVAL 1 MINUTE <= {_CLOSED}")(
    lambda s, d: _counted(s, d, "1 minute").select("userid", F.col("start").cast("timestamp_ntz").alias("minute"), "n")
)
def visits_in_bursts(s, d):
    return A.messages(s, d).select(F.col("messageid").alias("visitid"), (F.col("userid") % 7).alias("address"), hurried("timecreated").alias("timecreated"))


# a visit passes its address while that has accepted fewer than three; the day's count takes only those that passed
_G3 = f"""WITH v AS (SELECT messageid AS visitid, userid % 7 AS address, {HURRIED} AS ts FROM messages),
a AS (SELECT *, floor(epoch(ts) / 600) AS slot, row_number() OVER (PARTITION BY address, floor(epoch(ts) / 600) ORDER BY ts, visitid) AS nth FROM v),
d AS (SELECT *, sum(CASE WHEN nth <= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, visitid) AS passed FROM a),
x AS (SELECT *, nth <= 3 AND passed <= 300 AS ok FROM d), s AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY address, slot) AS used FROM x)
SELECT visitid, address, CASE WHEN ok THEN 'accepted' WHEN used >= 3 THEN 'address' ELSE 'cap' END AS outcome, nth <= 3 AND passed = 301 AS notice FROM s"""
query("g3_visitor_limits", "messages", _G3)(
    lambda s, d: L.visitor_limits(visits_in_bursts(s, d), 10, 3, 300)
)


def hurried_stream(s, d):
    e = event_stream(s, d)
    return e.withColumn("timecreated", hurried("timecreated").cast("timestamp"))


def decided(s, stream, schema):
    at = shared(s)
    S.to_folder(stream, f"{at}/out", f"{at}/state")
    return s.read.schema(schema).parquet(f"{at}/out")


query("g2_rate_limit_stream", "messages", _G2)(
    lambda s, d: decided(s, D.decide_limits(hurried_stream(s, d).filter("role = 'user'"), 2, 15), "messageid long, denied boolean")
)
query("g3_visitor_limits_stream", "messages", f"WITH o AS ({_G3}) SELECT visitid, address, outcome <> 'accepted' AS denied, notice FROM o")(
    lambda s, d: decided(s, D.decide_visits(hurried_stream(s, d).select(F.col("messageid").alias("visitid"), (F.col("userid") % 7).alias("address"), "timecreated"), 10, 3, 300), "visitid long, address string, denied boolean, notice boolean").withColumn("address", F.col("address").cast("long"))
)


def _distinct(s, d):
    """Tickets of the errors; all of them come in one batch, so of those that are alike one is kept."""
    at = shared(s)
    raw = arriving(s, d, "events").filter("event_type = 'error'")
    k = F.get_json_object("props", "$.k").cast("bigint")
    tickets = raw.select((F.col("user_id") % 25).alias("courseid"), F.col("user_id").alias("userid"), F.sha1((k % 10).cast("string").cast("binary")).alias("summaryhash"), F.col("ts").cast("timestamp").alias("timecreated"))
    S.to_folder(S.distinct_tickets(tickets, 24), f"{at}/out", f"{at}/state")
    return s.read.schema("courseid long, userid long, summaryhash string").parquet(f"{at}/out").groupBy("courseid").agg(F.count("*").alias("tickets"))


query("g4_distinct_tickets_stream", "tickets", "SELECT courseid, count(*) AS tickets FROM (SELECT DISTINCT courseid, userid, summaryhash FROM tickets) GROUP BY 1")(_distinct)


ACTIONS = {"view": "create", "click": "confirm", "signup": "bounced", "purchase": "delivered", "error": "cancel"}


def actions(events):
    """Events as actions on tickets; a user has a ticket in each five days."""
    action = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in ACTIONS.items()))
    return events.select((F.col("user_id") * 100 + F.floor(F.dayofyear("ts") / 5)).alias("ticketid"), action.alias("action"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))


_KINDS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items())
# what a ticket becomes, from its first answer in time and its deliveries since then; an hour before the last event is now
_G5 = f"""WITH e AS (SELECT user_id * 100 + floor(dayofyear(ts) / 5)::BIGINT AS ticketid, CASE event_type {_KINDS} END AS action, ts, event_id AS seq FROM events),
n AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS now FROM e), a AS (SELECT e.* FROM e, n WHERE ts < now + INTERVAL 1 MILLISECOND),
b AS (SELECT ticketid, min((ts, seq)) AS born FROM a WHERE action = 'create' GROUP BY 1),
r AS (SELECT a.ticketid, min((ts, seq)) AS answer, arg_min(action, (ts, seq)) AS kind FROM a JOIN b USING (ticketid) WHERE action IN ('confirm', 'cancel') AND (ts, seq) > born AND ts <= born[1] + INTERVAL 1 DAY GROUP BY 1),
t AS (SELECT a.*, count(*) FILTER (action = 'bounced') OVER w AS bounces, count(*) FILTER (action = 'delivered') OVER w AS sent FROM a JOIN r USING (ticketid) WHERE kind = 'confirm' AND (ts, seq) > answer AND action IN ('bounced', 'delivered') WINDOW w AS (PARTITION BY ticketid ORDER BY ts, seq))
SELECT ticketid, 'draft' AS status, 0 AS attempts, born[1] AS "at" FROM b UNION ALL SELECT ticketid, CASE kind WHEN 'confirm' THEN 'queued' ELSE 'cancelled' END, 0, answer[1] FROM r
UNION ALL SELECT ticketid, 'expired', 0, born[1] + INTERVAL 1 DAY FROM b, n WHERE ticketid NOT IN (SELECT ticketid FROM r) AND born[1] + INTERVAL 1 DAY < now
UNION ALL SELECT ticketid, CASE WHEN action = 'delivered' THEN 'sent' WHEN bounces = 3 THEN 'failed' ELSE 'queued' END, CAST(bounces AS INTEGER), ts FROM t WHERE (action = 'delivered' AND sent = 1 AND bounces < 3) OR (action = 'bounced' AND sent = 0 AND bounces <= 3)"""
plain = lambda df: df.withColumn("at", F.col("at").cast("timestamp_ntz"))
query("g5_ticket_lifecycle_stream", "", _G5)(lambda s, d: plain(decided(s, D.ticket_lifecycle(actions(arriving(s, d, "events"))), D.LIFE)))


def _replay(s, d):
    rows = actions(table(s, d, "events"))
    last = rows.agg(F.date_format(F.max("at") - F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd HH:mm:ss.SSS")).first()[0]
    return plain(D.replay_lifecycle(rows, f"{last or '1970-01-01 00:00:00.000'}999"))


query("g5_ticket_lifecycle_replay", "", _G5)(_replay)


def _sweep(s, d):
    """Documents arrive; those of the first 50 of 120 courses are embedded in the batch they come in."""
    at = shared(s)
    store = I.ChunkStore.create(s, f"{at}/index", 16)
    raw = arriving(s, d, "documents").filter("text <> ''")
    name = F.concat(F.sha1(F.col("text").cast("binary")), F.lit("/"), F.col("doc_id").cast("string"))
    files = raw.select((F.col("doc_id") % 120).alias("courseid"), F.sha1(name.cast("binary")).alias("contenthash"), F.col("doc_id").cast("string").alias("filename"), F.lit(True).alias("citable"), "text")
    S.index_files(files, store, lambda x: K.window_chunks(x, "text", A.CHUNK, A.STEP), 1, lambda x: x.read().select("courseid", "contenthash", "chunkindex", F.array(F.lit(0.5)).alias("vector")), "m", f"{at}/state")
    return store.read().groupBy("courseid").agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))


query("g8_embedding_sweep_stream", "", """WITH f AS (SELECT doc_id % 120 AS courseid, CAST(sum(CAST(greatest(1, ceil((length(text) - 200) / 1000.0)) AS BIGINT)) AS BIGINT) AS chunks FROM documents WHERE text <> '' GROUP BY 1)
SELECT courseid, chunks, CASE WHEN row_number() OVER (ORDER BY courseid) <= 50 THEN chunks ELSE 0 END AS embedded FROM f""")(_sweep)
query("session_windows", "messages", """WITH g AS (SELECT userid, timecreated, timecreated - lag(timecreated) OVER (PARTITION BY userid ORDER BY timecreated) >= INTERVAL 6 HOUR AS gap FROM messages),
n AS (SELECT userid, timecreated, count(*) FILTER (gap) OVER (PARTITION BY userid ORDER BY timecreated) AS k FROM g) SELECT userid, min(timecreated) AS start, count(*) AS n FROM n GROUP BY userid, k""")(
    lambda s, d: S.sessions(A.messages(s, d), "userid", "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))
)
