"""Limits with feedback, purges and what they leave, against step-by-step versions."""

import datetime as dt
import random
from collections import Counter

import pytest

from corvane.operators import governance as G
from corvane.operators import limits as L

T0 = dt.datetime(2024, 1, 1, 9)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def one_by_one(events, per_minute, per_day):
    """Events (id, user, ts) through two counters that grow with accepted events."""
    minutes, days, denied = Counter(), Counter(), {}
    for i, user, ts in sorted(events, key=lambda e: (e[2], e[0])):
        m, d = (user, ts.replace(second=0, microsecond=0)), (user, ts.date())
        denied[i] = bool((per_minute and minutes[m] >= per_minute) or (per_day and days[d] >= per_day))
        if not denied[i]:
            minutes[m] += 1
            days[d] += 1
    return denied


def visits_one_by_one(visits, minutes, per_address, per_day):
    slots, days, noticed, out = Counter(), Counter(), set(), {}
    for i, address, ts in sorted(visits, key=lambda e: (e[2], e[0])):
        slot, day = (address, int(ts.replace(tzinfo=dt.UTC).timestamp()) // (minutes * 60)), ts.date()
        if per_address and slots[slot] >= per_address:
            out[i] = ("address", False)
        elif per_day and days[day] >= per_day:
            out[i] = ("cap", day not in noticed)
            noticed.add(day)
        else:
            slots[slot] += 1
            days[day] += 1
            out[i] = ("accepted", False)
    return out


def events_of(spark, rows):
    return spark.createDataFrame(rows, "messageid long, userid long, timecreated timestamp_ntz, n long")


def denied(spark, events, per_minute, per_day):
    return {r["messageid"]: r["denied"] for r in L.over_limit(events_of(spark, [(*e, 1) for e in events]), "userid", per_minute, per_day).collect()}


def test_denied_messages_use_no_quota(spark):
    assert denied(spark, [(i, 1, at(s)) for i, s in enumerate((0, 10, 20, 300, 540))], 1, 2) == {0: False, 1: True, 2: True, 3: False, 4: True}


@pytest.mark.parametrize("per_minute, per_day", [(1, 3), (2, 5), (3, 0), (0, 4), (0, 0)])
def test_limits_in_bursts(spark, per_minute, per_day):
    rnd = random.Random(per_minute * 10 + per_day)
    events = [(i, rnd.randint(1, 4), at(rnd.choice([0, 60, 61, 62, 3600, 54_000, 54_001]) + rnd.randint(0, 90))) for i in range(400)]
    assert denied(spark, events, per_minute, per_day) == one_by_one(events, per_minute, per_day)
    assert denied(spark, [], per_minute, per_day) == {}


def outcomes(spark, visits, *limits):
    df = spark.createDataFrame([(*v, "x") for v in visits], "visitid long, address string, timecreated timestamp_ntz, outcome string")
    return {r["visitid"]: (r["outcome"], r["notice"]) for r in L.visitor_limits(df, *limits).collect()}


def test_refused_visits_spend_nothing(spark):
    got = outcomes(spark, [(0, "a", at(0)), (1, "a", at(1)), (2, "a", at(2)), (3, "b", at(3)), (4, "c", at(4)), (5, "d", at(5))], 10, 1, 2)
    assert got == {0: ("accepted", False), 1: ("address", False), 2: ("address", False), 3: ("accepted", False), 4: ("cap", True), 5: ("cap", False)}


@pytest.mark.parametrize("limits", [(10, 2, 30), (60, 5, 20), (1440, 3, 9), (10, 0, 7), (10, 2, 0), (10, 0, 0)])
def test_visits_in_bursts(spark, limits):
    rnd = random.Random(sum(limits))
    visits = [(i, rnd.choice("abcdefgh"), at(rnd.randint(0, 3) * 40_000 + rnd.randint(0, 1500))) for i in range(500)]
    assert outcomes(spark, visits, *limits) == visits_one_by_one(visits, *limits)


def test_windows_lie_within_days(spark):
    with pytest.raises(ValueError, match="divide a day"):
        outcomes(spark, [(0, "a", at(0))], 7, 1, 1)


# ---- purges ----
def purge_tables(spark):
    day = lambda m, d=1: dt.datetime(2024, m, d)
    tickets = [
        (1, 10, "sent", day(1), day(3)),  # old, but changed since
        (2, 10, "sent", day(1), day(1)),
        (3, 99, "draft", day(1), day(1)),  # a draft, old and without its conversation
        (4, 99, "failed", day(3), day(3)),  # an orphan
        (5, 0, "queued", day(3), day(3)),  # never had a conversation
        (6, None, "queued", day(3), day(3)),
        (7, 10, "draft", day(3, 2), day(3, 2)),
    ]
    convs = [(10, 5, day(1), day(3)), (11, 0, day(1), day(1)), (12, 5, day(1), day(1))]
    said = [(1, 10, day(1)), (2, 10, day(3)), (3, 11, day(3)), (4, 12, day(3))]
    return {
        "tickets": spark.createDataFrame(tickets, "ticketid long, conversationid long, status string, timecreated timestamp_ntz, timemodified timestamp_ntz"),
        "conversations": spark.createDataFrame(convs, "conversationid long, userid long, timecreated timestamp_ntz, timemodified timestamp_ntz"),
        "messages": spark.createDataFrame(said, "messageid long, conversationid long, timecreated timestamp_ntz"),
    }


def ids(t, name, key):
    return {r[key] for r in t[name].collect()}


def test_tickets_go_by_their_last_change(spark):
    t = G.purge_tickets(purge_tables(spark), "2024-02-01")
    assert ids(t, "tickets", "ticketid") == {1, 3, 5, 6, 7}


def test_retention(spark):
    on = G.retention(purge_tables(spark), "2024-03-02 12:00:00", "2024-02-01")
    assert {(r["ticketid"], r["status"]) for r in on["tickets"].collect()} == {(1, "sent"), (5, "queued"), (6, "queued"), (7, "draft")}  # ticket 3 has expired, and is an orphan
    assert ids(on, "conversations", "conversationid") == {10} and ids(on, "messages", "messageid") == {2}
    off = G.retention(purge_tables(spark), "2024-03-02 12:00:00", None)
    assert {(r["ticketid"], r["status"]) for r in off["tickets"].collect() if r["status"] == "expired"} == set()
    assert ids(off, "conversations", "conversationid") == {10, 12} and len(ids(off, "tickets", "ticketid")) == 7


def test_an_expired_draft_was_modified_now(spark):
    got = {r["ticketid"]: (r["status"], r["timemodified"]) for r in G.expire_drafts(purge_tables(spark)["tickets"], "2024-03-02 12:00:00").collect()}
    assert got[3] == ("expired", dt.datetime(2024, 3, 2, 12)) and got[7][0] == "draft" and got[1] == ("sent", dt.datetime(2024, 3, 1))
