"""The chunk store and urls within content, against rebuilds and plain search."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from corvane.operators import containment as C
from corvane.operators.index_store import ChunkStore
from corvane.operators.knowledge import window_chunks

FILES = "courseid long, contenthash string, filename string, citable boolean, text string"


def chunker(files):
    return window_chunks(files, "text", 12, 10)


def files(spark, rows):
    return spark.createDataFrame([(c, h, n, cit, f"text of {h} " * 3) for c, h, n, cit in rows], FILES)


def content(store):
    return {(r["courseid"], r["contenthash"], r["filename"], r["citable"], r["version"], r["chunkindex"], r["content"]) for r in store.read().collect()}


def stored(path):
    return {p.parent.name: {x.name for x in p.parent.glob("*.parquet")} for p in Path(path).glob("bucket=*/*.parquet")}


def test_an_index_is_what_a_rebuild_gives(spark, tmp_path):
    rnd = random.Random(4)
    store = ChunkStore.create(spark, str(tmp_path / "a"), 8)
    rows, version = {}, 1
    for step in range(4):
        for _ in range(6):
            rows[rnd.randint(1, 2), f"h{rnd.randint(0, 15)}"] = (f"name{rnd.randint(0, 3)}", rnd.random() < 0.5)
        for key in rnd.sample(sorted(rows), 2):
            del rows[key]
        version += step == 2
        listing = files(spark, [(*k, *v) for k, v in rows.items()])
        store.apply(listing, chunker, version, whole=True)
        rebuilt = ChunkStore.create(spark, str(tmp_path / f"b{step}"), 8)
        rebuilt.apply(listing, chunker, version)
        assert content(store) == content(rebuilt)
    store.apply(files(spark, []), chunker, version, whole=True)
    assert content(store) == set() and store.documents().count() == 0


def test_untouched_buckets_keep_their_files_and_vectors_stay(spark, tmp_path):
    path = str(tmp_path / "s")
    store = ChunkStore.create(spark, path, 8)
    store.apply(files(spark, [(1, f"h{i}", "n", True) for i in range(20)]), chunker, 1)
    vectors = store.read().select("courseid", "contenthash", "chunkindex", F.array(F.lit(0.12345678)).alias("vector"))
    assert store.sweep(vectors, "m", 1) == 1 and store.pending("m").isEmpty() and store.pending("other").count() == store.read().count()
    before = stored(path)
    change = files(spark, [(1, "h3", "renamed", False)]).withColumn("gone", F.lit(False)).unionByName(files(spark, [(1, "h4", "n", True), (1, "nowhere", "n", True)]).withColumn("gone", F.lit(True)))
    for _ in range(2):  # done again, it changes nothing
        store.sink(chunker, 1)(change, 7)
        rows = store.read().collect()
        assert {r["embedding"][0] for r in rows} == {0.123457} and {r["filename"] for r in rows if r["contenthash"] == "h3"} == {"renamed"}
        assert {r["contenthash"] for r in rows} == {f"h{i}" for i in range(20) if i != 4}
    after = stored(path)
    same = {b for b in before if before[b] == after[b]}
    assert set(after) == set(before) and len(same) >= len(before) - 2
    store.apply(change, chunker, 1)
    assert stored(path) == after


def test_sweeps_go_on_where_the_last_one_ended(spark, tmp_path):
    store = ChunkStore.create(spark, str(tmp_path / "s"), 4)
    store.apply(files(spark, [(c, f"h{c}", "n", True) for c in range(120)]), chunker, 1)
    all_ = lambda: store.read().select("courseid", "contenthash", "chunkindex", F.array(F.lit(1.0)).alias("vector"))
    assert [store.sweep(all_(), "m", run) for run in (1, 2, 3, 4)] == [50, 50, 20, 0]
    assert {r["courseid"]: r["sweep"] for r in store.read().collect()} == {c: c // 50 + 1 for c in range(120)}


def test_urls_anywhere(spark):
    rnd = random.Random(9)
    hosts = ["http://a.org", "https://a.org", "HTTPS://A.org", "https://b.net/http://a.org", "https://é.fr"]
    urls = {(rnd.randint(1, 3), rnd.choice(hosts) + rnd.choice(["", "/", "/x", "/X y", "/x?y=%_", "/\n"])) for _ in range(80)} | {(1, "a.org"), (1, "ftp://a.org"), (2, ""), (None, "http://a.org")}
    texts = [(rnd.randint(1, 3), " ".join(rnd.choice(hosts) + rnd.choice(["", "/x?y=", "/X Y", "%_"]) for _ in range(3))) for _ in range(12)] + [(1, None), (2, ""), (3, "http://" * 2000)]
    df = spark.createDataFrame([(*u, "k") for u in urls], "courseid long, url string, contained string")
    got = {(r["courseid"], r["url"]): r["contained"] for r in C.contained_urls(df.drop("contained"), spark.createDataFrame(texts, "courseid long, content string"), "courseid").collect()}
    want = {(s, u): s is not None and u.lower().startswith(("http://", "https://")) and any(x == s and u.lower() in (t or "").lower() for x, t in texts) for s, u in urls}
    assert got == want and set(got.values()) == {True, False}
    assert C.contained_urls(df.filter("false").drop("contained"), spark.createDataFrame(texts, "courseid long, content string"), "courseid").count() == 0


def test_a_sweep_joins_only_its_courses(spark, tmp_path, monkeypatch):
    """What is rewritten of other courses, and chunks of new files, are not joined; a chunker that drops columns does as well."""
    slim = lambda x: chunker(x).select("courseid", "contenthash", "chunkindex", "content")
    rows = [(c, f"h{c}", f"n{c}", c % 2 == 0) for c in range(6)]
    stores = [ChunkStore.create(spark, str(tmp_path / str(i)), 1) for i in range(2)]
    for store, how in zip(stores, (chunker, slim), strict=True):
        store.apply(files(spark, rows), how, 1)
    assert content(stores[0]) == content(stores[1]) != set()
    seen = []
    monkeypatch.setattr(ChunkStore, "_write", lambda self, touched, whole, f=ChunkStore._write: (seen.append(whole), f(self, touched, whole)))
    stores[0].sweep(stores[0].read().select("courseid", "contenthash", "chunkindex", F.array(F.lit(1.0)).alias("vector")), "m", 1, most=2)
    assert "Union" in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert {r["courseid"]: r["sweep"] for r in stores[0].read().collect()} == {c: 1 if c < 2 else None for c in range(6)}
