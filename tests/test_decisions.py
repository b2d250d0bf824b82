"""Streams that decide, over several micro-batches, against the same decisions on whole tables."""

import datetime as dt
import random
import time

import pytest
from test_limits import at, one_by_one, visits_one_by_one

from corvane.streaming import decisions as D
from corvane.streaming import streams as S


def arriving(spark, tmp_path, batches, schema):
    """A stream of one file a batch, in this order."""
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        part = tmp_path / f"part{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(part))
        folder.mkdir(exist_ok=True)
        (file,) = part.glob("*.parquet")
        time.sleep(0.02)
        (folder / f"{i}.parquet").write_bytes(file.read_bytes())
    return S.read_folder(spark, str(folder), spark.read.parquet(str(folder)).schema, files_per_batch=1)


def results(spark, tmp_path, stream, schema):
    S.to_folder(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    return spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()


def cut(rows, n):
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def test_user_limits(spark, tmp_path):
    rnd = random.Random(2)
    events = [(i, rnd.randint(1, 4), at(rnd.choice([0, 60, 61, 3600, 54_000]) + rnd.randint(0, 90))) for i in range(300)]
    stream = arriving(spark, tmp_path, cut(events, 3), "messageid long, userid long, timecreated timestamp")
    got = {r["messageid"]: r["denied"] for r in results(spark, tmp_path, D.decide_limits(stream, 2, 9), "messageid long, denied boolean")}
    assert got == one_by_one(events, 2, 9) and set(got.values()) == {True, False}


@pytest.mark.parametrize("limits", [(10, 2, 30), (60, 4, 0)])
def test_visits(spark, tmp_path, limits):
    rnd = random.Random(3)
    visits = [(i, rnd.choice("abcdefgh"), at(rnd.randint(0, 3) * 40_000 + rnd.randint(0, 1500))) for i in range(300)]
    stream = arriving(spark, tmp_path, cut(visits, 3), "visitid long, address string, timecreated timestamp")
    got = {r["visitid"]: (r["denied"], r["notice"]) for r in results(spark, tmp_path, D.decide_visits(stream, *limits, shards=3), "visitid long, denied boolean, notice boolean")}
    assert got == {i: (outcome != "accepted", notice) for i, (outcome, notice) in visits_one_by_one(visits, *limits).items()}


def test_lifecycle_is_its_replay(spark, tmp_path):
    """Actions arrive up to 20 minutes out of order and over several batches; the stream's changes are the table's."""
    rnd = random.Random(5)
    kinds = ["create", "create", "confirm", "cancel", "bounced", "bounced", "bounced", "delivered"]
    acts = [(rnd.randint(1, 40), rnd.choice(kinds), at(rnd.randint(0, 4 * 86_400)), i) for i in range(600)]
    acts += [(100, "create", at(0), 900), (100, "confirm", at(86_400), 901), (101, "create", at(0), 902), (101, "confirm", at(86_401), 903), (102, "create", at(4 * 86_400 - 100), 904), (103, "confirm", at(5), 905)]
    arrival = sorted(acts, key=lambda r: r[2] + dt.timedelta(seconds=rnd.randint(0, 1200)))
    size = len(arrival) // 4 + 1
    schema = "ticketid long, action string, at timestamp, seq long"
    stream = arriving(spark, tmp_path, [arrival[i : i + size] for i in range(0, len(arrival), size)], schema)
    got = sorted(tuple(r) for r in results(spark, tmp_path, D.ticket_lifecycle(stream, "1 day", "30 minutes"), D.LIFE))
    until = max(a[2] for a in acts) - dt.timedelta(minutes=30)
    want = sorted(tuple(r) for r in D.replay_lifecycle(spark.createDataFrame(acts, schema), str(until), "1 day").collect())
    assert got == want
    assert {r[1] for r in got} == {"draft", "queued", "cancelled", "expired", "sent", "failed"}
    assert (100, "queued", 0, at(86_400)) in got and (101, "expired", 0, at(86_400)) in got and not [r for r in got if r[0] == 103]


def test_replay_is_the_automaton(spark):
    rnd = random.Random(6)
    acts = [(rnd.randint(1, 60), rnd.choice(["create", "confirm", "cancel", "bounced", "delivered"]), at(rnd.randint(0, 3 * 86_400)), i) for i in range(900)]
    want = []
    for t in {a[0] for a in acts}:
        ticket = D.Ticket("", 0, 0, 86_400_000_000)
        for _, action, when, _ in sorted((a for a in acts if a[0] == t), key=lambda a: (a[2], a[3])):
            ticket.act(action, int((when - at(0)).total_seconds()) * 1_000_000)
        ticket.until(3 * 86_400_000_000)
        want += [(t, s, n, at(0) + dt.timedelta(microseconds=w)) for s, n, w in ticket.out]
    schema = "ticketid long, action string, at timestamp, seq long"
    got = [tuple(r) for r in D.replay_lifecycle(spark.createDataFrame(acts, schema), str(at(3 * 86_400))).collect()]
    assert sorted(got) == sorted(want)


class Held:
    """A value state that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, []

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    getValueState = lambda self, *_: self


@pytest.mark.parametrize("limits", [(2, 9), (0, 9)])
def test_messages_beyond_a_limit_are_not_held(limits):
    """A key's rows are decided as they come but for what may still be accepted, and its state is read once and written once."""
    state, of, taken = Held(), D.UserLimit(*limits, None), 0
    of.init(state)

    def rows():
        nonlocal taken
        for taken in range(1, 5001):
            yield D.Row(messageid=taken, at=5000 - taken, clock=5000 - taken)

    out = of.handleInputRows((7,), rows(), None)
    first = next(out)
    assert taken <= 10 and first.denied
    rest = [first, *out]
    assert len(rest) == 5000 and sorted(r.at for r in rest if not r.denied) == list(range(limits[0] or limits[1]))
    assert state.calls == ["get", "update"]


def test_visits_beyond_a_limit_are_not_held():
    state, of, taken = Held(), D.FirstOf(10, 3, None, notice=True), 0
    of.init(state)

    def frames():
        nonlocal taken
        for taken in range(1, 51):
            at = [5000 - (taken - 1) * 100 - i for i in range(100)]
            yield D.pd.DataFrame({"visitid": at, "address": "a", "at": at, "clock": at, "open": [x % 10 != 0 for x in at], "notice": False})

    sizes, found = [], []
    for frame in of.handleInputRows(("a",), frames(), None):
        found.append(frame)
        sizes.append(taken * 100 - sum(map(len, found)))
    whole = D.pd.concat(found)
    assert len(whole) == 5000 and max(sizes) <= 104
    assert sorted(whole[whole["open"]]["at"]) == [1, 2, 3] and whole[whole["notice"]]["at"].tolist() == [4]
    assert state.calls == ["get", "update"]
