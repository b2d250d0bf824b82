"""Decisions on a stream with keyed state: rate limits, site limits and the life of tickets.

State is kept by ``transformWithState`` in RocksDB. Limits decide in the order of arrival, within a micro-batch by time; of each key they keep the
counters of its latest windows in one value, read and written once for a micro-batch's rows of a key, and with ``forget`` all of them expire some time after their last use (such a stream always has a next
batch, so it suits a query that goes on, not a run of what is there). Of a window no more rows are
held than may still be accepted; the others are decided as they come. Tickets wait for the watermark, so what comes out doesn't depend on the order of arrival."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from heapq import heappush, heappushpop

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MAX_ATTEMPTS = 3


def with_state_store(spark: SparkSession) -> None:
    """The state store that these processors need; streams started before are not touched."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Counters:
    """Counters by window, of which the latest ``KEPT`` are kept."""

    KEPT = 3

    def __init__(self, windows: list[int], counts: list[int]):
        self.held, self.last = dict(zip(windows, counts, strict=True)), None

    def __getitem__(self, window: int) -> int:
        self.last = window if self.last is None else max(self.last, window)
        return self.held.get(window, 0)

    def add(self, window: int) -> None:
        self.held[window] = self[window] + 1

    def kept(self) -> tuple[list[int], list[int]]:
        held = {w: n for w, n in self.held.items() if self.last is None or w > self.last - self.KEPT}
        return list(held), list(held.values())


def counters(handle, forget: dt.timedelta | None):
    """Two Counters in one value."""
    return handle.getValueState("counters", "a array<long>, na array<int>, b array<long>, nb array<int>", int(forget.total_seconds() * 1000) if forget else None)


def held_in(state) -> list[Counters]:
    a, na, b, nb = state.get() or ([], [], [], [])
    return [Counters(a, na), Counters(b, nb)]


def mode(forget: dt.timedelta | None) -> str:
    return "ProcessingTime" if forget else "None"


def micros(ts: str):
    """A time's microseconds, and those of its clock in the session's time zone, which windows go by."""
    return F.unix_micros(ts).alias("at"), F.unix_micros(F.from_utc_timestamp(ts, F.current_timezone())).alias("clock")


def window_of(clock: int | None, minutes: int) -> int:
    return (-(1 << 63) if clock is None else clock) // (minutes * 60_000_000)


class Earliest:
    """The earliest rows of a window, at most ``most``: by time, then id, nulls last."""

    def __init__(self, most: int):
        self.most, self.heap, self.n = most, [], 0

    def push(self, at: int | None, key: int | None, row: Row) -> Row | None:
        """Take a row; returns one that is not among the earliest."""
        self.n += 1
        order = tuple(-x for y in (at, key) for x in (y is None, y or 0))
        if len(self.heap) < self.most:
            return heappush(self.heap, (order, -self.n, row))
        return heappushpop(self.heap, (order, -self.n, row))[2] if self.most > 0 else row

    def rows(self) -> list[tuple]:
        """(order, row), the earliest first."""
        return [(tuple(-x for x in (*order, n)), row) for order, n, row in sorted(self.heap, reverse=True)]


class UserLimit(StatefulProcessor):
    """Denies a user's messages beyond the accepted ones of their minute or day."""

    def __init__(self, per_minute: int, per_day: int, forget: dt.timedelta | None):
        self.limits, self.forget = ((1, per_minute), (24 * 60, per_day)), forget

    def init(self, handle) -> None:
        self.state = counters(handle, self.forget)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        out = lambda row, denied: Row(messageid=row.messageid, userid=key[0], at=row.at, denied=denied)
        counts = held_in(self.state)
        # what a window accepts are its first rows, so none behind them is held; the first limit that is set is enough for that
        size, limit, count = next(((s, n, c) for (s, n), c in zip(self.limits, counts, strict=True) if n), (0, 0, None))
        first: dict[int, Earliest] = {}
        for row in rows:
            if not limit:
                for (span, _), c in zip(self.limits, counts, strict=True):
                    c.add(window_of(row.clock, span))
                yield out(row, False)
                continue
            window = window_of(row.clock, size)
            if window not in first:
                first[window] = Earliest(limit - count[window])
            if (late := first[window].push(row.at, row.messageid, row)) is not None:
                for (span, _), c in zip(self.limits, counts, strict=True):
                    c[window_of(late.clock, span)]
                yield out(late, True)
        for _, row in sorted((x for e in first.values() for x in e.rows()), key=lambda x: x[0]):
            windows = [window_of(row.clock, span) for span, _ in self.limits]
            denied = any(n and c[w] >= n for c, w, (_, n) in zip(counts, windows, self.limits, strict=True))
            if not denied:
                for c, w in zip(counts, windows, strict=True):
                    c.add(w)
            yield out(row, denied)
        self.state.update((*counts[0].kept(), *counts[1].kept()))

    def close(self) -> None:
        pass


def decide_limits(events: DataFrame, per_minute: int, per_day: int, forget: dt.timedelta | None = None) -> DataFrame:
    """messageid, userid, timecreated, denied for a stream of messages (messageid, userid, timecreated)."""
    with_state_store(events.sparkSession)
    keyed = events.select("messageid", "userid", *micros("timecreated")).groupBy("userid")
    out = keyed.transformWithState(UserLimit(per_minute, per_day, forget), "messageid long, userid long, at long, denied boolean", "Append", mode(forget))
    return out.select("messageid", "userid", F.timestamp_micros("at").alias("timecreated"), "denied")


VISIT = "visitid long, address string, at long, clock long, open boolean, notice boolean"
FIELDS = ["visitid", "address", "at", "clock", "open", "notice"]


class FirstOf(StatefulProcessor):
    """Of the visits that are still open, the first ``most`` of each window stay open (of keys whose last part is ``only``, if given). With
    ``notice`` the first visit beyond them is marked."""

    def __init__(self, minutes: int, most: int, forget: dt.timedelta | None, notice: bool = False, only: str | None = None):
        self.minutes, self.most, self.forget, self.notice, self.only = minutes, most, forget, notice, only

    def init(self, handle) -> None:
        self.state = counters(handle, self.forget)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.most or (self.only is not None and str(key[-1]) != self.only):
            yield from (x[FIELDS] for x in rows)
            return
        counts, marks = held_in(self.state)
        room: dict[int, int] = {}
        held = None
        for found in rows:
            found = found[FIELDS].assign(notice=False)
            yield found[~found["open"]]
            some = found[found["open"]]
            some = some.assign(window=some["clock"].fillna(-(1 << 63)).astype("int64") // (self.minutes * 60_000_000))
            held = (some if held is None else pd.concat([held, some])).sort_values(["at", "visitid"], kind="stable")
            for w in set(some["window"].unique().tolist()) - room.keys():
                room[w] = max(0, self.most - counts[w]) + (self.notice and not marks[w])
            early = held.groupby("window").cumcount() < held["window"].map(room)
            yield held.loc[~early, FIELDS].assign(open=False)
            held = held[early]
        if held is not None and len(held):
            stays = []
            for w in held["window"].tolist():
                stays.append(counts[w] < self.most)
                (counts if stays[-1] else marks).add(w)
            yield held[FIELDS].assign(open=stays, notice=[not x for x in stays])
        self.state.update((*counts.kept(), *marks.kept()))

    def close(self) -> None:
        pass


SITE = "site"


def decide_visits(visits: DataFrame, minutes: int, per_address: int, per_day: int, shards: int = 16, forget: dt.timedelta | None = None) -> DataFrame:
    """visitid, address, timecreated, denied, notice for a stream of visits (visitid, address, timecreated): an address's windows first, then
    the site's day.

    A day isn't one key: each of its ``shards`` passes on as many visits as the day may have and one more, so the day's own key gets a bounded number of
    rows; visits that are decided travel under their shard's key."""
    if minutes <= 0 or 24 * 60 % minutes:
        raise ValueError("minutes must divide a day")
    with_state_store(visits.sparkSession)
    rows = visits.select("visitid", F.col("address").cast("string").alias("address"), *micros("timecreated"), F.lit(True).alias("open"), F.lit(False).alias("notice"))
    shard = F.pmod(F.xxhash64("address"), F.lit(shards)).cast("string")
    day = F.date_format(F.timestamp_micros("at"), "yyyy-MM-dd")
    step = lambda df, of, *keys: df.groupBy(*keys).transformWithStateInPandas(of, VISIT, "Append", mode(forget))
    passed = step(rows, FirstOf(minutes, per_address, forget), "address")
    some = step(passed.withColumns({"day": day, "shard": shard}), FirstOf(24 * 60, per_day + 1 if per_day else 0, forget), "day", "shard")
    at = F.when(F.col("open"), SITE).otherwise(shard)
    out = step(some.withColumns({"day": day, "part": at}), FirstOf(24 * 60, per_day, forget, notice=True, only=SITE), "day", "part")
    return out.select("visitid", "address", F.timestamp_micros("at").alias("timecreated"), (~F.col("open")).alias("denied"), "notice")


LIFE = "ticketid long, status string, attempts int, at timestamp"
TICKET = "status string, attempts int, born long, actions array<string>, times array<long>, seqs array<long>"


class Ticket:
    """The states of a ticket; times in microseconds."""

    def __init__(self, status: str, attempts: int, born: int, life: int):
        self.status, self.attempts, self.born, self.life = status, attempts, born, life
        self.out: list[tuple[str, int, int]] = []

    def become(self, status: str, at: int, attempts: int = 0) -> None:
        self.status, self.attempts = status, attempts
        self.out.append((status, attempts, at))

    def until(self, at: int) -> None:
        """What time alone does."""
        if self.status == "draft" and at > self.born + self.life:
            self.become("expired", self.born + self.life)

    def act(self, action: str, at: int) -> None:
        self.until(at)
        if action == "create" and not self.status:
            self.born = at
            self.become("draft", at)
        elif self.status == "draft" and action in ("confirm", "cancel"):
            self.become("queued" if action == "confirm" else "cancelled", at)
        elif self.status == "queued" and action == "delivered":
            self.become("sent", at, self.attempts)
        elif self.status == "queued" and action == "bounced":
            n = self.attempts + 1
            self.become("failed" if n >= MAX_ATTEMPTS else "queued", at, n)


class Lifecycle(StatefulProcessor):
    """Keeps a ticket's actions until the watermark has passed them, then follows them in order; a timer ends drafts. All of a ticket is one value."""

    def __init__(self, life_us: int):
        self.life = life_us

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", TICKET)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        *ticket, actions, times, seqs = self.now.get() or ("", 0, 0, [], [], [])
        found = [(x.action, x.us, x.seq) for x in rows]
        self.now.update((*ticket, *([*had, *new] for had, new in zip((actions, times, seqs), zip(*found, strict=True), strict=True))))
        self.handle.registerTimer(min(us for _, us, _ in found) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        status, attempts, born, actions, times, seqs = self.now.get() or ("", 0, 0, [], [], [])
        ticket = Ticket(status, attempts, born, self.life)
        waiting = sorted(zip(times, seqs, actions, strict=True))
        due = [x for x in waiting if x[0] // 1000 <= now]
        for at, _, action in due:
            ticket.act(action, at)
        ticket.until(now * 1000)
        rest = waiting[len(due) :]
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000)
        if due or ticket.out:
            self.now.update((ticket.status, ticket.attempts, ticket.born, [x for *_, x in rest], [at for at, *_ in rest], [seq for _, seq, _ in rest]))
        if ticket.status == "draft":
            self.handle.registerTimer((ticket.born + self.life) // 1000 + 1)
        return (Row(ticketid=key[0], status=s, attempts=n, us=at) for s, n, at in ticket.out)

    def close(self) -> None:
        pass


def ticket_lifecycle(actions: DataFrame, life: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Changes of state (ticketid, status, attempts, at) from a stream of actions (ticketid, action, at, seq): drafts are confirmed,
    cancelled or expire after ``life``; deliveries fail at the third bounce. Actions up to ``late`` out of order are followed in order."""
    with_state_store(actions.sparkSession)
    span = int(pd.Timedelta(life).total_seconds() * 1_000_000)
    keyed = actions.withWatermark("at", late).select("ticketid", "action", "at", "seq", F.unix_micros("at").alias("us")).groupBy("ticketid")
    out = keyed.transformWithState(Lifecycle(span), "ticketid long, status string, attempts int, us long", "Append", "EventTime")
    return out.select("ticketid", "status", "attempts", F.timestamp_micros("us").alias("at"))


def replay_lifecycle(actions: DataFrame, until: str, life: str = "1 day") -> DataFrame:
    """The same changes from a table of actions with ``until`` (a timestamp) as the time now, by windows over tickets: what a draft becomes is
    decided by its first answer in time, what a queued ticket becomes by its deliveries since then."""
    now = F.lit(until).cast("timestamp")
    rows = actions.filter(F.col("at") <= now)
    order = [F.col("at"), F.col("seq")]
    sofar = W.partitionBy("ticketid").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    first = lambda name, cond: F.min(F.when(cond, F.struct("at", "seq"))).over(W.partitionBy("ticketid")).alias(name)
    here = F.struct("at", "seq")
    df = rows.select("*", here.alias("here"), first("born", F.col("action") == "create")).filter("here >= born")
    df = df.withColumn("deadline", F.col("born.at") + F.expr(f"INTERVAL {life}"))
    answer = F.col("action").isin("confirm", "cancel") & (F.col("at") <= F.col("deadline"))
    df = df.select("*", first("answered", answer)).withColumn("yes", F.max((F.col("here") == F.col("answered")) & (F.col("action") == "confirm")).over(W.partitionBy("ticketid")))
    draft = df.filter("here = born").select("ticketid", F.lit("draft").alias("status"), F.lit(0).alias("attempts"), "at")
    answers = df.filter("here = answered").select("ticketid", F.when(F.col("yes"), "queued").otherwise("cancelled").alias("status"), F.lit(0).alias("attempts"), "at")
    expired = df.filter("here = born AND answered IS NULL").filter(F.col("deadline") < now).select("ticketid", F.lit("expired").alias("status"), F.lit(0).alias("attempts"), F.col("deadline").alias("at"))
    tries = df.filter("yes AND here > answered AND action IN ('delivered', 'bounced')")
    tries = tries.withColumns({"bounced": F.count_if(F.col("action") == "bounced").over(sofar).cast("int"), "sent": F.count_if(F.col("action") == "delivered").over(sofar)})
    tries = tries.filter(F.when(F.col("action") == "delivered", (F.col("sent") == 1) & (F.col("bounced") < MAX_ATTEMPTS)).otherwise((F.col("sent") == 0) & (F.col("bounced") <= MAX_ATTEMPTS)))
    status = F.when(F.col("action") == "delivered", "sent").when(F.col("bounced") == MAX_ATTEMPTS, "failed").otherwise("queued")
    return draft.unionByName(answers).unionByName(expired).unionByName(tries.select("ticketid", status.alias("status"), F.col("bounced").alias("attempts"), "at"))
