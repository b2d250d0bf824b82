"""Facts by day: what a batch and a purge rewrite, and what a scan opens."""

import datetime as dt
from pathlib import Path

from corvane.operators.day_store import DayStore

SCHEMA = "messageid long, userid long, timecreated timestamp_ntz"


def files(path):
    return {d.name: {x.name for x in d.glob("*.parquet")} for d in Path(path).glob("daterecorded=*")}


def rows(spark, *facts):
    return spark.createDataFrame([(i, i % 3, dt.datetime(2024, 1, day, hour)) for i, day, hour in facts], SCHEMA)


def ids(store, *days):
    return sorted(r["messageid"] for r in store.read(*days).collect())


def test_batches_purges_and_scans(spark, tmp_path):
    path = str(tmp_path / "s")
    store = DayStore(spark, path, rows(spark).schema)
    assert ids(store) == [] and store.purge("2024-01-05") == []
    store.append(rows(spark, (1, 1, 5), (2, 2, 5), (3, 3, 5), (4, 3, 20)), 0)
    before = files(path)
    for _ in range(2):  # a batch that is written again replaces itself
        assert store.append(rows(spark, (5, 3, 6), (6, 4, 1)), 1) == [dt.date(2024, 1, 3), dt.date(2024, 1, 4)]
        assert ids(store) == [1, 2, 3, 4, 5, 6]
    after = files(path)
    assert {d for d in before if before[d] == after[d]} == {"daterecorded=2024-01-01", "daterecorded=2024-01-02"}
    store.append(rows(spark, (7, 1, 9)), 2)  # late
    assert ids(store, "2024-01-01", "2024-01-01") == [1, 7] and ids(store, "2024-01-02", "2024-01-03") == [2, 3, 4, 5]
    before = files(path)
    assert store.purge("2024-01-03 06:00:00") == [dt.date(2024, 1, d) for d in (1, 2, 3)]
    assert ids(store) == [4, 5, 6] and files(path)["daterecorded=2024-01-04"] == before["daterecorded=2024-01-04"]
    assert store.purge("2024-01-03 06:00:00") == []
    plan = store.read("2024-01-04", "2024-01-04")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(daterecorded" in plan
