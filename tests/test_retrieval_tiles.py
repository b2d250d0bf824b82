"""Scores by terms out of tiles, against all pairs one by one."""

import math
import random
import re

import pytest

from corvane.operators import retrieval as R

WORDS = ["mitosis", "mitosisis", "animitosis", "cell", "cells", "cat", "follow-up", "section", "sections", "ñandú", "the"]


@pytest.fixture(scope="module")
def case(spark):
    rnd = random.Random(3)
    said = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    chunks = [(i % 2, i // 3, i % 3, rnd.choice(["cells.txt", "f"]), (f"[Section: {said(2)}]\n" if i % 5 == 0 else "") + said(rnd.randint(1, 12))) for i in range(90)] + [(0, 1000 + i, 0, "f", "the cell the cell") for i in range(20)]
    asked = [(100 + i, i % 3, said(rnd.randint(1, 6))) for i in range(15)]
    make = spark.createDataFrame
    return chunks, asked, make(chunks, "courseid long, doc_id long, chunkindex long, filename string, content string"), make(asked, "queryid long, courseid long, query string")


def hits(term, text):
    folded = text.replace("ñ", "n").replace("ú", "u")
    if "-" in term:
        return re.sub(r"[\s\-]+", "-", folded).count(term)
    return folded.count(term) if len(term) >= 5 else re.split(r"[^a-z0-9]+", folded).count(term)


def expected(chunks, asked):
    out = {}
    for q, scope, text in asked:
        terms = {w for w in re.split(r"[^\w]+", text) if len(w) >= 3} | {re.sub(r"\s*-\s*", "-", x) for x in re.findall(r"[a-zñú]+(?:\s*-\s*[a-zñú]+)+", text)}
        for s, doc, i, name, content in chunks:
            if s == scope:
                head = content[len("[Section: ") : content.index("]")] if content.startswith("[Section: ") else ""
                folded = [(t, t.replace("ñ", "n").replace("ú", "u")) for t in terms]
                score = sum((1 + math.log(n)) * len(t) for t, f in folded if (n := hits(f, content.lower()))) + sum(2 for _, f in folded if f in name)
                heads = sum(1 for _, f in folded if hits(f, head.lower()))
                if score or heads:
                    out[q, doc, i] = (round(score, 6), heads)
    return out


@pytest.mark.parametrize(("few_terms", "tile"), [(20_000, (256, 4096)), (0, (2, 7))])
def test_lexical_tiles(spark, monkeypatch, case, few_terms, tile):
    """All pairs, and the best of each question, whatever the tiles and the way words meet terms."""
    monkeypatch.setattr(R, "FEW_TERMS", few_terms)
    monkeypatch.setattr(R, "ALL_PAIRS", tile)
    monkeypatch.setattr(R, "BEST_PAIRS", tile)
    chunks, asked, c, q = case
    every = R.lexical_scores(q, c)
    got = {(r["queryid"], r["doc_id"], r["chunkindex"]): (round(r["lexical"], 6), r["headinghits"]) for r in every.collect()}
    assert got == expected(chunks, asked)
    whole = R.hybrid_scores(every).withColumn("score", R.F.round("score", R.DIGITS))
    best = R.top_scores(q, c, 3)
    rows = lambda df: sorted(map(str, R.select_top_k(df, 3).collect()))
    assert rows(best) == rows(whole)
    assert best.groupBy("queryid").count().agg({"count": "max"}).first()[0] <= 6


def test_vectors_in_tiles(spark, monkeypatch):
    """Pairs that both have a vector come out without a hit too; others have no cosine."""
    monkeypatch.setattr(R, "ALL_PAIRS", (1, 2))
    make = spark.createDataFrame
    c = make([(0, d, i, "f", t) for d, t in ((1, "mitosis"), (2, "other"), (3, "mitosis"), (4, "more")) for i in (0, 1)], "courseid long, doc_id long, chunkindex long, filename string, content string")
    q = make([(7, 0, "mitosis"), (8, 0, "nothing here"), (9, 0, "mitosis"), (6, 0, "a")], "queryid long, courseid long, query string")
    vector = "array<float>"
    sides = make([(7, [1.0, 0.0]), (8, [1.0, 1.0]), (6, [0.0, 2.0])], f"queryid long, vector {vector}"), make([(1, [3.0, 0.0]), (2, [0.0, 0.0]), (4, None), (99, [1.0, 1.0])], f"doc_id long, vector {vector}")
    got = {(r["queryid"], r["doc_id"]): (round(r["lexical"], 6), None if r["cosine"] is None else round(r["cosine"], 6)) for r in R.lexical_scores(q, c, vectors=sides).collect()}
    assert got == {
        (7, 1): (7.0, 1.0), (7, 2): (0.0, 0.0), (7, 3): (7.0, None), (7, 4): (0.0, 0.0), (9, 1): (7.0, None), (9, 3): (7.0, None),
        (8, 1): (0.0, 0.707107), (8, 2): (0.0, 0.0), (8, 4): (0.0, 0.0), (6, 1): (0.0, 0.0), (6, 2): (0.0, 0.0), (6, 4): (0.0, 0.0),
    }


def test_all_cosines(spark, monkeypatch):
    """Every pair of a scope, in tiles of any size; no cosine is 0."""
    monkeypatch.setattr(R, "TILE_ROWS", 2)
    monkeypatch.setattr(R, "TILE_QUERIES", 1)
    e = spark.createDataFrame([(i, i % 2, v) for i, v in enumerate([[1.0, 0.0], [2.0], [3.0, 4.0], None, [0.0, 0.0], [1.0], [1.0, None], [-1.0]])], "vec_id long, scope int, embedding array<float>")
    got = {(r["queryid"], r["vec_id"]): round(r["cosine"], 6) for r in R.semantic_scores(e.filter("vec_id IN (0, 1)"), e, "scope").collect()}
    assert got == {(0, 0): 1.0, (0, 2): 0.6, (0, 4): 0.0, (0, 6): 0.0, (1, 1): 1.0, (1, 3): 0.0, (1, 5): 1.0, (1, 7): -1.0}
    text = R.semantic_scores(e, e, "scope")._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in text


ODD = [
    "Mitosis—mitosis cell: cells' anímitosis", "follow up, FOLLOW–UP follow_up/up-to-date a-b A - B", "ñandú NÃNDÚ ǅet straße 中文 ²x x²", "", None, "a\x00b cell\x07cells​cell",
    "[Section: Cells; a-b follow-up]\nthe cell", "mitosismitosis mitosis" * 40, "x-y x‑y z", "İstanbul istanbul ΣΑΣ σας", "cat cats concatenate 123 1234 12345 9123456",
]


@pytest.mark.parametrize("most", [None, 2])
def test_few_questions_go_to_the_chunks(spark, monkeypatch, most):
    """Scores of odd texts where the chunks lie are those of tiles of hits, at any number of chunks at once; nothing is shuffled."""
    make = spark.createDataFrame
    c = make([(i % 2, i, j, name, t) for i in range(6) for j, (name, t) in enumerate(zip(["Cells.txt", "f", None, "ñandú-a-b", "", "CAT"] * 2, ODD, strict=False))], "courseid long, doc_id long, chunkindex long, filename string, content string")
    q = make([(i, i % 3, t) for i, t in enumerate([t for t in ODD if t] * 2 + ["a-b", "x - y", "cat", "... !"])], "queryid long, courseid long, query string")
    rows = lambda: sorted((r["queryid"], r["doc_id"], r["chunkindex"], round(r["lexical"], 9), r["headinghits"]) for r in R.lexical_scores(q, c, most=most).collect())
    monkeypatch.setattr(R, "FEW_ASKED", 0)
    tiles = R.top_scores(q, c, 2) if most else None
    want = rows()
    monkeypatch.setattr(R, "FEW_ASKED", 20_000)
    plan = R.lexical_scores(q, c, most=most)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and want
    for at_once in (1, 20, 16_384):
        monkeypatch.setattr(R, "SCANNED", at_once)
        monkeypatch.setattr(R.KnownWords, "MOST", 3 * at_once)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(10_000, 5 * at_once)))
        try:
            if most is None:
                assert rows() == want
            else:
                best = lambda df: sorted(map(str, R.select_top_k(df, 2).collect()))
                assert best(R.top_scores(q, c, 2)) == best(tiles)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("few_terms", [20_000, 0])
def test_many_questions_meet_in_tiles(spark, monkeypatch, case, few_terms):
    monkeypatch.setattr(R, "FEW_ASKED", 0)
    test_lexical_tiles(spark, monkeypatch, case, few_terms, (2, 7))
    test_vectors_in_tiles(spark, monkeypatch)


def test_every_vector_is_asked_for(spark, tmp_path):
    """x9_cosine, code and SQL: each row of a scope against each other one, whatever its id (finding F4 of round 4)."""
    from compare import connect, difference

    from corvane.plans import ORACLE_SQL, QUERIES

    rows = [(i, [float(i), 1.0], label) for i, label in ((1, 0), (7, 2), (50, 0), (51, 1), (53, 3))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    df = QUERIES["x9_cosine"](spark, str(tmp_path))
    assert difference(df, connect(str(tmp_path)), ORACLE_SQL["x9_cosine"]) is None
    assert {(r["queryid"], r["vec_id"]) for r in df.collect()} == {(a, b) for of in ((1, 7, 50), (51, 53)) for a in of for b in of if a != b}


def test_hits_of_many_questions_are_shuffled_once(spark, monkeypatch, case):
    """Where only the best count no tile of questions has a copy of the hits (finding F3 of round 4), and the setting for batches is as before."""
    monkeypatch.setattr(R, "FEW_ASKED", 0)
    monkeypatch.setattr(R, "BEST_PAIRS", (1, 2))
    _, _, c, q = case
    before = spark.conf.getAll.get("spark.sql.execution.arrow.maxBytesPerBatch")
    kept = R.lexical_scores(q, c, most=2)
    assert "CoGroup" not in kept._jdf.queryExecution().toString() and kept.count() > 0
    assert spark.conf.getAll.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


@pytest.mark.parametrize("tile", [1, 4, 100])
def test_groups_come_in_batches_of_any_size(monkeypatch, tile):
    """A question's best of a group are those of all its chunks, wherever batches and tiles end."""
    import pyarrow as pa
    from pyspark.sql import types as T

    monkeypatch.setattr(R, "BEST_PAIRS", (7, tile))
    rnd = random.Random(tile)
    rows, want = [], []
    for group in (3, 5):
        hits = [(d, f, t, rnd.randint(1, 3)) for d in rnd.sample(range(40), 40) for f, t in {(rnd.choice([0, 0, 1, 2]), rnd.randint(0, 5)) for _ in range(rnd.randint(0, 4))}]
        asked = [(group * 100 + i, rnd.sample(range(7), 3)) for i in range(9)]
        rows += [{"__group": group, "__asks": 0, "doc_id": d, "field": f, "tid": t, "n": n} for d, f, t, n in hits]
        rows += [{"__group": group, "__asks": 1, "queryid": q, "courseid": 1, "terms": [{"tid": t, "size": float(t + 3)} for t in ts]} for q, ts in asked]
        for q, ts in asked:
            found = {}
            for d, f, t, n in hits:
                if t in ts:
                    lexical, heads = found.get(d, (0.0, 0))
                    found[d] = (lexical + (0.0 if f == 1 else 2.0 if f == 2 else (1 + math.log(n)) * (t + 3)), heads + (f == 1))
            score = {d: round(x + 15 * h, 9) for d, (x, h) in found.items()}
            best = sorted(found, key=lambda d: (-score[d], d))[:2] + sorted((d for d in found if found[d][1]), key=lambda d: (-found[d][1], -score[d], d))[:2]
            want += [(q, d, round(found[d][0], 6), found[d][1]) for d in set(best)]
    schema = pa.schema([(k, pa.int64()) for k in ("__group", "__asks", "doc_id", "field", "tid", "n", "queryid", "courseid")] + [("terms", pa.list_(pa.struct([("tid", pa.int64()), ("size", pa.float64())])))])
    out = T.StructType().add("queryid", "long").add("courseid", "long").add("doc_id", "long").add("lexical", "double").add("headinghits", "integer")
    for size in (1, 5, 1000):
        batches = pa.Table.from_pylist(rows, schema).combine_chunks().to_batches(max_chunksize=size)
        got = [x for b in R.group_scores(iter(batches), ["doc_id"], "courseid", out, 2) for x in b.to_pylist()]
        assert sorted((x["queryid"], x["doc_id"], round(x["lexical"], 6), x["headinghits"]) for x in got) == sorted(want) and want
