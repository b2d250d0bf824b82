"""Nearest rows by tiles, against all cosines."""

import random

import numpy as np
import pytest

from corvane.operators import retrieval as R


@pytest.mark.parametrize("rows_a_tile", [4096, 7])
def test_semantic_top(spark, monkeypatch, rows_a_tile):
    monkeypatch.setattr(R, "TILE_ROWS", rows_a_tile)
    monkeypatch.setattr(R, "TILE_QUERIES", 3)
    rnd = random.Random(rows_a_tile)
    vector = lambda: rnd.choice([None, [0.0, 0.0, 0.0], [1.0, 2.0], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], *[[float(rnd.randint(-2, 2)) for _ in range(3)] for _ in range(20)]])
    corpus = [(rnd.choice([1, 2, 2, 2, None]), i, vector()) for i in range(150)]
    asked = [(rnd.choice([1, 2, 3]), 1000 + i, vector()) for i in range(12)]
    q, c = spark.createDataFrame(asked, "courseid long, queryid long, vector array<double>"), spark.createDataFrame(corpus, "courseid long, vec_id long, vector array<double>")
    got = {(r["queryid"], r["vec_id"], r["cosine"]) for r in R.semantic_top(q, c, 5).collect()}

    def unit(v):
        ok = v is not None and None not in v and np.isfinite(v).all() and any(v)
        return np.array(v) / np.sqrt((np.array(v) ** 2).sum()) if ok else None

    want = set()
    for scope, i, v in asked:
        if (a := unit(v)) is not None:
            found = [(-round(float(a @ b), 7), j) for s, j, w in corpus if s == scope and (b := unit(w)) is not None and len(b) == len(a)]
            want |= {(i, j, -x) for x, j in sorted(found)[:5]}
    assert {(q, j, round(x, 6) + 0.0) for q, j, x in got} == {(q, j, round(x, 6) + 0.0) for q, j, x in want} and want
    assert R.semantic_top(q, c.filter("false"), 5).count() == 0
