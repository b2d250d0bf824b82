"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats and empty tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import chat, fingerprint, language, licenses, mixing, neighbors, ngram_join, pieces, secret_scan, sharding
from corvane.llm.entries import tokenizer

DOC = "doc_id long, text string, lang string, source string, n_chars long, bytes long, cls string, size string"


def docs(spark, rows):
    """Rows of (doc_id, text[, lang, source]) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], *(r[2:] or ("en", "s")), None, 1, "x", "y") for r in rows], DOC)


ODD = [(1, "a b c"), (2, None), (3, ""), (4, " \n\t "), (None, "a b c"), (None, None), (5, "a b c"), (5, "a b c"), (6, "word " * 30_000), (-7, "x" * 50_000), (8, "日本語 text ▁ é \x00 end")]


# ---- 1 secrets ----
def test_secret_positions_and_redaction(spark):
    key = "AKIA" + "Q7" * 8
    d = docs(spark, [*ODD, (20, f"é {key}, then password={'5f' * 9} end {key}")])
    score = secret_scan.train(secret_scan.weak_labels(d))
    got = secret_scan.findings(d, score).collect()
    text = f"é {key}, then password={'5f' * 9} end {key}"
    assert {(r["doc_id"], text[r["start"] : r["end"]]) for r in got if r["doc_id"] == 20} == {(20, key), (20, "5f" * 9)}
    assert len([r for r in got if r["doc_id"] == 20]) == 3 and {r["doc_id"] for r in got} == {20}
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(d.filter("doc_id > 0"), score).collect()}
    assert clean[20] == "é [SECRET], then password=[SECRET] end [SECRET]" and clean[2] is None and clean[1] == "a b c" and clean[6] == "word " * 30_000
    assert secret_scan.findings(docs(spark, []), score).count() == 0


def test_forest_removes_false_positives(spark):
    rnd = random.Random(3)
    hexed = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(32))
    rows = [(i, f"text token = \"{hexed()}\" more" if i % 2 else f"see order {rnd.randrange(10**15, 10**16)} and Donaudampfschifffahrt{'en' * (i % 5)}") for i in range(200)]
    score = secret_scan.train(secret_scan.weak_labels(docs(spark, rows)))
    held_out = [(1000 + i, f"a secret: {hexed()}" if i % 2 else f"order {rnd.randrange(10**15, 10**16)} Handelsgesellschaften") for i in range(40)]
    found = {r["doc_id"] for r in secret_scan.findings(docs(spark, held_out), score).collect()}
    assert found == {1000 + i for i in range(40) if i % 2}


def test_forest_decides_without_secrets_in_the_table(spark):
    hexed = hashlib.md5(b"a").hexdigest()
    assert all(len(re.findall(secret_scan.CANDIDATE, t)) == 1 for t, _ in secret_scan.EXAMPLES)
    score = secret_scan.train(secret_scan.weak_labels(docs(spark, [(1, "no candidate here")])))
    secrets = [(2, f"send bearer {hexed} on"), (3, f"the password is {hexed}")]
    others = [(4, f"commit {hexed}"), (5, "see the Donaudampfschifffahrtsgesellschaft"), (6, "order 4111111111111111"), (7, "x" * 500), (8, "open /usr/share/doc/configuration/notes")]
    assert {r["doc_id"] for r in secret_scan.findings(docs(spark, [*secrets, *others]), score).collect()} == {2, 3}


def test_scores_are_the_forests_own(spark):
    """The column expression gives what the forest itself predicts."""
    from pyspark.ml.functions import vector_to_array

    rows = secret_scan.weak_labels(docs(spark, [(1, "password = 0123456789abcdef01 and /usr/share/doc/notes"), (2, "order 4111111111111111")]))
    forest = secret_scan.fit(rows)
    own = F.struct(*(F.col(c) for c in secret_scan.FEATURES))
    both = forest.transform(secret_scan.as_vectors(rows)).select(vector_to_array("probability")[1].alias("p"), secret_scan.as_column(forest)(own).alias("q")).collect()
    assert len(both) > 150 and max(abs(r["p"] - r["q"]) for r in both) < 1e-9


def test_recall_and_precision_on_held_out_findings(spark):
    """Findings of other kinds of text and value than the fixed examples have: most secrets are found, most else is left alone."""
    rnd = random.Random(21)
    pick = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    low, mixed = "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    keys = [lambda: pick("0123456789abcdef", 40), lambda: pick(mixed, 24), lambda: pick(low, 32), lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: "ghp_" + pick(mixed, 36)]
    told = ["DB_PASSWORD={}", "export API_TOKEN={}", "auth_token: '{}'", "my api key is {} thanks", '{{"client_secret": "{}"}}']
    uuid = lambda: "-".join(pick("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))
    others = [
        lambda: "see https://example.org/" + "/".join(rnd.choice(["docs", "images", "static", "users", "report"]) for _ in range(4)),
        lambda: "the id " + uuid() + " of it", lambda: "data:image/png;base64," + pick(mixed + "+/", 200), lambda: "at commit " + pick("0123456789abcdef", 40),
        lambda: "call " + pick("0123456789", 14) + " now", lambda: "eine " + rnd.choice(["Rechtsschutzversicherungsgesellschaft", "Donaudampfschifffahrtskapitaen"]) + " ist", lambda: "in src/main/java/" + rnd.choice(["services", "controllers"]) + "/index-page",
    ]
    rows = [(i, rnd.choice(told).format(rnd.choice(keys)())) for i in range(150)] + [(1000 + i, rnd.choice(others)()) for i in range(150)]
    score = secret_scan.train(secret_scan.weak_labels(docs(spark, [(1, "none")])))
    found = {r["doc_id"] for r in secret_scan.findings(docs(spark, rows), score).collect()}
    hits = len([i for i in found if i < 1000])
    assert hits / 150 >= 0.9 and hits / len(found) >= 0.9, (hits, len(found), [t for i, t in rows if i in found and i >= 1000][:9], [t for i, t in rows if i not in found and i < 1000][:9])


def test_secrets_beyond_the_training_documents_are_labelled(spark):
    rows = [(i, "password: " + hashlib.md5(b"%d" % i).hexdigest() if i in (77, 150) else f"order {10**15 + i}") for i in range(200)]
    fixed = sum(label for _, label in secret_scan.EXAMPLES)
    assert secret_scan.weak_labels(docs(spark, rows), train_docs=2).filter("label = 1").count() == fixed + 2


def test_labels_make_candidates_of_the_training_documents_only(spark):
    """Nothing that makes candidates stands below the join that leaves only the training documents (finding F1 of round 4)."""
    rows = secret_scan.weak_labels(docs(spark, [(1, "password = 0123456789abcdef01")]), train_docs=2)
    above, below = rows._jdf.queryExecution().optimizedPlan().toString().split("Join LeftSemi")
    assert "regexp_extract_all" in above and "regexp_extract_all" not in below.split("\n+- ")[0]


def test_candidates_are_those_of_the_plain_pattern(spark):
    plain = r"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]{0,200}[0-9])[A-Za-z0-9+/_-]{12,}|[A-Za-z0-9+/_-]{16,})={0,2}"
    rnd = random.Random(5)
    part = lambda: rnd.choice("aZ/_-+ 7=.\u00e9\u0660") * rnd.choice([1, 1, 2, 11, 12, 15, 16, 199, 201])
    texts = ["", "a" * 200 + "1", "a" * 201 + "1", *("".join(part() for _ in range(rnd.randint(1, 9))) for _ in range(400))]
    got = secret_scan.with_candidates(docs(spark, [*enumerate(texts), (-1, None)])).select("doc_id", "__gaps", "__found.c").collect()
    assert {r["doc_id"]: (r["__gaps"], r["c"]) for r in got} == {-1: ([""], []), **{i: (re.split(plain, t), re.findall(plain, t)) for i, t in enumerate(texts)}}


def test_texts_that_may_hold_a_secret_are_those_of_the_pattern(spark):
    rows = ["PASSWORD: abcdefghijkl", "xoxb-0123456789-", "risk-" + "a" * 20, "sk-" + "a" * 20, "author = abcdefghijkl", "author: none", "\u212aey=abcdefghijkl", "eyJ" + "a" * 20, "ghx_" + "a" * 36, "ghs_" + "a" * 36, ""]
    got = docs(spark, [*enumerate(rows), (-1, None)]).select(secret_scan.maybe(F.col("text")).alias("a"), F.regexp_like("text", F.lit(secret_scan.MAYBE)).alias("b")).collect()
    assert [bool(r["a"]) for r in got] == [bool(r["b"]) for r in got] and {True, False} <= {r["a"] for r in got}


def test_many_secrets_in_one_text_and_clashing_names(spark):
    hexes = [hashlib.md5(b"%d" % i).hexdigest() for i in range(3000)]
    text = "é " + " ".join(f"password={h}" for h in hexes)
    score = secret_scan.train(secret_scan.weak_labels(docs(spark, [(1, "none")])))
    d = docs(spark, [(1, text), (2, "nothing")]).withColumns({"__gaps": F.lit("g"), "__found": F.lit(1), "__c": F.lit("c"), "row": F.lit("r"), "clean": F.lit("x")})
    got = secret_scan.findings(d, score).collect()
    assert sorted(text[r["start"] : r["end"]] for r in got) == sorted(hexes)
    clean = {r["doc_id"]: r for r in secret_scan.redact(d, score).collect()}
    assert clean[1]["text"] == "é " + " ".join(["password=[SECRET]"] * 3000) and clean[1]["__gaps"] == "g" and clean[1]["row"] == "r" and clean[2]["clean"] == "x"
    assert secret_scan.redact(d, score).columns == d.columns


# ---- 2 sharding ----
@pytest.mark.parametrize("limit", [1 << 40, 20_000, 300, 1])
def test_shards_fit(spark, limit):
    rnd = random.Random(5)
    rows = [*ODD, *[(i, "y" * rnd.randrange(200)) for i in range(100, 400)], *[(77, "same row")] * 50]
    got = sharding.assign(docs(spark, rows), limit).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["bytes"]) for r in got) == sorted((i is not None, i or 0, len((t or "").encode())) for i, t, *_ in rows)
    shards = collections.defaultdict(list)
    for r in got:
        assert len(r["shard"]) == r["bits"]
        shards[r["shard"], r["part"]].append(r)
    for rs in shards.values():
        assert sum(r["bytes"] for r in rs) == rs[0]["shard_bytes"] and len(rs) == rs[0]["shard_rows"]
        assert rs[0]["shard_bytes"] <= limit or len(rs) == 1
    names = sorted({s for s, _ in shards})
    assert all(not b.startswith(a) for a, b in zip(names, names[1:], strict=False))  # no bucket within another
    # only buckets over the limit were split: the parent of each pair of leaves is over it
    total = collections.Counter()
    for r in got:
        for k in range(r["bits"]):
            total[r["shard"][:k]] += r["bytes"]
    assert all(total[n[:-1]] > limit for n in names if n)


def test_a_row_repeated_very_often(spark):
    d = docs(spark, [(1, "abc"), (2, "defgh")]).unionByName(spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in docs(spark, []).dtypes[2:])))
    got = sharding.assign(d, 4000).collect()
    parts = collections.Counter((r["shard"], r["part"]) for r in got if r["doc_id"] == 7)
    assert len(got) == 10_002 and len(parts) == 10 and set(parts.values()) == {1000}


def test_no_rows_no_shards(spark):
    assert sharding.assign(docs(spark, []), 100).count() == 0


# ---- 3 licences ----
def brute_licence(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c if c >= "\x80" or c.isdigit() and c < "\x80" or "a" <= c <= "z" else " " for c in text or "").split(" ")
    words = [w for w in words if w]
    at, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licences(spark):
    rnd = random.Random(2)
    parts = ["under", "the", "MIT", "License", "Apache License, Version 2.0", "cc-by-nc", "CC BY", "nc", "é", "under the mit license", "\n", "version", "2"]
    rows = [*ODD, *[(100 + i, " ".join(rnd.choice(parts) for _ in range(rnd.randrange(40)))) for i in range(200)]]
    got = licenses.scan(docs(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == collections.Counter((i, *brute_licence(t)) for i, t, *_ in rows)
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)


def test_more_licences(spark):
    texts = ["released under GPL v3.", "SPDX-License-Identifier: LGPL-2.1-or-later", "// SPDX-License-Identifier: CC-BY-ND-4.0 OR AGPL-3.0-or-later\n", "see the LGPLv3"]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {0: "gpl-3", 1: "lgpl", 2: "agpl-3,cc-by-nd", 3: "lgpl"}
    assert licenses.scan(docs(spark, [])).count() == 0


def test_licence_expressions():
    assert licenses.postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert licenses.evaluate("(MIT OR GPL-3.0-only) AND Apache-2.0 WITH LLVM-exception") == ({"mit", "gpl-3", "apache-2"}, True)
    assert licenses.evaluate("MIT AND (GPL-2.0+ OR AGPL-3.0)") == ({"mit", "gpl-2", "agpl-3"}, False)
    assert licenses.evaluate(") and (") == (set(), False) and licenses.evaluate("MIT OR") == ({"mit"}, True)


# ---- 4 neighbours ----
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, p string, cell string")


def brute_neighbours(rows, k=5, every=50):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, dtype=np.float32).astype(np.float64)
    cos = lambda a, b: float(np.dot(a, b)) / (np.sqrt(float(np.dot(a, a))) * np.sqrt(float(np.dot(b, b))))
    return {q: sorted((-cos(v, good[q]), i) for i, v in good.items() if i != q)[:k] for q in good if q % every == 0}


def test_neighbours(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=8).tolist(), "", "") for i in range(600)]
    rows += [(1000 + i, [1.0] * 8, "", "") for i in range(120)]  # many equal vectors
    rows += [(5001, None, "", ""), (5050, [0.0] * 8, "", ""), (5100, [float("nan")] * 8, "", ""), (5150, [None] + [1.0] * 7, "", ""), (5200, [float("inf")] * 8, "", ""), (5250, [], "", ""), (5300, [1.0] * 3, "", ""), (None, [1.0] * 8, "", ""), rows[0]]
    got = neighbors.nearest(vectors(spark, rows), sample=400, block=64).collect()
    want = brute_neighbours(rows)
    have = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        have[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(have) == set(want) and all(len(v) == 5 for v in have.values())
    hits = sum(len({i for i, _ in have[q]} & {i for _, i in w}) for q, w in want.items())
    assert hits >= 0.9 * 5 * len(want)
    assert [i for i, _ in have[1000]] == [1001, 1002, 1003, 1004, 1005] and [i for i, _ in have[1100]] == [1000, 1001, 1002, 1003, 1004]
    for q, found in have.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)


@pytest.mark.parametrize("sample, block", [(20_000, 4096), (200, 40)])
def test_recall_in_64_dimensions(spark, sample, block):
    """Clustered vectors: at least 0.9 of the true neighbours, with a few large cells and with many that are cut again."""
    rnd = np.random.default_rng(7)
    centres = rnd.normal(size=(20, 64))
    x = (centres[rnd.integers(0, 20, 3000)] + 0.5 * rnd.normal(size=(3000, 64))).astype(np.float32)
    got = neighbors.nearest(vectors(spark, [(i, v, "", "") for i, v in enumerate(x.tolist())]), sample=sample, block=block).collect()
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits, asked = 0, range(0, 3000, 50)
    for q in asked:
        near = unit @ unit[q]
        near[q] = -2
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-near)[:5].tolist()))
    assert len(got) == 5 * len(asked) and hits >= 0.9 * len(got)


def test_few_neighbours(spark):
    assert neighbors.nearest(vectors(spark, [])).count() == 0
    assert [(r["query_id"], r["vec_id"]) for r in neighbors.nearest(vectors(spark, [(50, [1.0, 0.0], "", ""), (51, [0.0, 1.0], "", "")])).collect()] == [(50, 51)]


def test_chi_square():
    assert abs(neighbors.chi_square(neighbors.chi_square_quantile(0.9, 8), 8) - 0.9) < 1e-9 and abs(neighbors.chi_square_quantile(0.95, 8) - 15.507) < 0.001


# ---- 5 mixing ----
def test_mixture(spark):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randrange(300), "en", rnd.choice(["a", "b", "c", None, "é"])) for i in range(400)] + [(9, "a b", "en", "a"), (9, "a b", "en", "a"), (None, None, "en", "zz"), (None, "x", "en", None)]
    got = mixing.Mix(docs(spark, rows)).taken().collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(order, brute_targets([size[s] for s in order], [i % 3 + 1 for i in range(len(order))], 3.0), strict=True))
    taken = collections.Counter()
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= max(100, 0.02 * want[s])
    key = lambda r: (r["doc_id"] or -1, r["size"], r["source"] or "", r["taken"])
    assert sorted(got, key=key) == sorted(mixing.Mix(docs(spark, rows)).taken().collect(), key=key)
    assert mixing.Mix(docs(spark, [])).taken().count() == 0


def brute_targets(sizes, weights, cap):
    """The level of water in vessels as wide as the weights and as high as the caps: found by bisection."""
    total, low, high = sum(sizes), 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(cap * s, w * mid) for s, w in zip(sizes, weights, strict=True)) < total else (low, mid)
    return [min(cap * s, w * low) for s, w in zip(sizes, weights, strict=True)]


@pytest.mark.parametrize("weights", [None, "given"])
def test_very_many_sources(spark, monkeypatch, weights):
    """Numbered, weighed and drawn in DataFrames: the same targets, and every source near its own."""
    monkeypatch.setattr(mixing, "MOST_SOURCES", 20)
    monkeypatch.setattr(mixing, "PER_GROUP", 32)
    rnd = random.Random(11)
    names = [None, "", *(rnd.choice("aé日\U0001F600z") + f"host{i}" for i in range(300))]
    rows = [(i, "w " * rnd.choice([0, 3, 40, 900]), "en", rnd.choice(names)) for i in range(1500)] + [(5000 + i, "x " * 2000, "en", "hot") for i in range(60)]
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len(t.split())
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    given = [1.0 + i % 7 for i in range(len(order))] if weights else None
    mix = mixing.Mix(docs(spark, rows), given, shards=8)
    info = {r["source"]: r for r in mix.sources.collect()}
    want = dict(zip(order, brute_targets([size[s] for s in order], given or [i % 3 + 1 for i in range(len(order))], 3.0), strict=True))
    assert [r["source"] for r in sorted(info.values(), key=lambda r: r["src"])] == order
    assert all(r["target"] == pytest.approx(want[s]) and r["dealt"][-1] == r["quota"] for s, r in info.items())
    shards = np.diff(np.array([r["dealt"] for r in info.values()]).sum(axis=0), prepend=0)
    assert abs(shards - shards.mean()).max() <= 8
    taken = collections.Counter()
    for r in mix.taken().collect():
        assert r["taken"] <= 3 * r["size"] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(100, 0.02 * want[s]) for s in order)
    slots = mix.slots().collect()
    assert len(slots) == sum(r["quota"] for r in info.values()) and max(r["shard"] for r in slots) == 7


def test_targets_and_permutation():
    assert mixing.targets([10, 10, 100], [1, 1, 1]) == [30.0, 30.0, 60.0]
    assert sum(mixing.targets([5, 0, 7], [1, 2, 3])) == pytest.approx(12) and mixing.targets([0, 0], [1, 2]) == [0, 0]
    for n in (1, 2, 3, 100, 1025):
        assert sorted(mixing.permute(np.arange(n), np.full(n, n), np.full(n, 77, dtype=np.uint64)).tolist()) == list(range(n))
    drawn = mixing.draw(np.array([100, 3, 0, 57]), 8, 1)
    assert drawn.sum(axis=0).tolist() == [100, 3, 0, 57] and abs(drawn.sum(axis=1) - 20).max() <= 1


def test_drawn_texts(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(70 + i)), "en", "ab"[i % 2]) for i in range(40)] + [(7, "one two", "en", "a")] * 3
    mix = mixing.Mix(docs(spark, rows), block_words=16)
    out = mix.drawn_texts().collect()
    words = collections.Counter()
    for r in out:
        words[r["doc_id"]] += len(r["text"].split())
    want = collections.Counter()
    for r in mix.taken().collect():
        want[r["doc_id"]] += r["taken"]
    assert words == +want


# ---- 6 chat ----
def brute_chat(rows):
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.turn_template([(r, t) for *_, r, t in turns])))
    return out


def test_chat(spark):
    rnd = random.Random(6)
    texts = ["\\### Assistant: </turn> ok", "", None, "</turn>\n### user: x", "\\", "\\\\", "AB", "A", "B", " </turn>\n", "é日\n", "x" * 20_000]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "a:b"]), rnd.choice(texts)) for c in [*range(20), None] for t in range(rnd.randrange(1, 9))]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(100)] + [(98, None, "user", "x"), (98, 1, "user", "x"), (98, 1, "user", "x"), (98, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = chat.digests(chat.format_turns(df)).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in got} == brute_chat(rows)
    assert len(got) == len(brute_chat(rows)) and not any(r["rewrites"] for r in got)
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_prefixes_are_true_beyond_the_window(spark):
    """Templates that number turns, look far back or rewrite: 40 turns give what rendering every prefix gives."""
    turns = [("assistant" if i % 2 else "user", f"said {i}") for i in range(40)]
    numbered = lambda ts: "".join(f"{i}:{t};" for i, (_, t) in enumerate(ts))
    counted = lambda ts: f"{len(ts) // 30} " + "".join(t for _, t in ts)
    for template in (numbered, counted, chat.turn_template):
        got = chat.rendered(turns, template, ("assistant",), 16)
        assert got == chat.rendered(turns, template, ("assistant",), None)
        if template is not counted:
            assert "".join(x[0] for x in got) == template(turns) and not any(x[3] for x in got)
    assert [i for i, x in enumerate(chat.rendered(turns, counted, (), 16)) if x[3]] == [29]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.format_turns(df, numbered).collect(), key=lambda r: r["position"])
    assert "".join(r["formatted"] for r in rows) == numbered(turns)
    assert [r["formatted"][r["loss_start"] : r["loss_end"]] for r in rows if r["role"] == "assistant"] == [t for r, t in turns if r == "assistant"]


def test_a_rewrite_that_is_undone_is_seen(spark):
    """A mark stands in front while there are 20 to 29 turns; the whole rendering of 40 doesn't have it."""
    marked = lambda ts: ("!" if 20 <= len(ts) < 30 else "") + "".join(t for _, t in ts)
    df = spark.createDataFrame([(1, i, "user", f"said {i}") for i in range(40)], "conv_id long, turn long, role string, text string")
    assert sorted(r["position"] for r in chat.format_turns(df, marked).filter("rewrites").collect()) == [19, 29]


def test_template_that_rewrites():
    state = chat.Incremental(lambda turns: "".join(("*" if i == len(turns) - 1 else "") + t for i, (_, t) in enumerate(turns)), 8)
    assert [state.add("user", x, False)[3] for x in "abc"] == [False, True, True]


# ---- 7 pieces ----
def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(8)
    letters = "abcdefghinorstuABEé▁ \n\t.,_-/0123😀日本　"
    rows = [*ODD, *[(100 + i, "".join(rnd.choice(letters) for _ in range(rnd.randrange(300)))) for i in range(500)], (9000, " " * 999), (9001, "ab" * 800)]
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.encode(docs(spark, rows), path).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t, *_ in rows:
        ids = sp.encode(t or "")
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    assert got == want
    assert pieces.encode(docs(spark, []), path).count() == 0


def test_long_words_equal_the_library(monkeypatch):
    """Words without a space: a million letters in seconds, and short words by the heap as by rounds."""
    import time

    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    sp, rnd = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(1)
    texts = ["".join(rnd.choice(x) for _ in range(n)) for x, n in (("abcdefghijklmnopqrstuvwxyz", 1_000_000), ("e", 30_000), ("日本語の文字é😀", 40_000), ("QUJDREVGabc+/=019", 100_000), ("aetoinshrdl", 1001))]
    began = time.time()
    got = pieces.Codec(path).encode(texts)
    assert time.time() - began < 60
    for t, (ids, n, decoded) in zip(texts, got, strict=True):
        want = sp.encode(t)
        assert n == len(want) and ids == ",".join(map(str, want)) and decoded == sp.decode(want)
    table = pieces.PieceTable(path)
    words = ["".join(rnd.choice("aabcdeehilnorst▁é") for _ in range(rnd.randrange(1, 40))) for _ in range(300)]
    assert [x.tolist() for x in table.merge(words)] == [table.merge_long(w).tolist() for w in words]


# ---- 8 language ----
def test_language(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", F.lit("clash").alias("piece"))
    odd = spark.createDataFrame([(None, "the of and", None, "x"), (10**9, None, "en", "x"), (10**9 + 1, "123 !?", "de", "x"), (10**9 + 2, "", None, "x"), (10**9 + 3, "the and that is with " * 3000, None, "x"), (10**9 + 4, "w" * 5000, None, "x")], "doc_id long, text string, lang string, piece string")
    model = tokenizer("piece_bpe_32k.model")
    out = language.identify(d.unionByName(odd), model).collect()
    assert len(out) == d.count() + 6 and all(0 <= r["score"] <= 1 for r in out)
    pred = {r["doc_id"]: r["lang_pred"] for r in out}
    assert [pred[10**9 + i] for i in range(4)] == ["und", "und", "und", "en"] and pred[None] == "en"
    held = d.filter(language.crc_remainder("doc_id") == 0).collect()
    assert np.mean([pred[r["doc_id"]] == r["lang"] for r in held]) >= 0.95
    none = language.identify(d.withColumn("lang", F.lit(None).cast("string")), model).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}


def test_forward_sums_all_segmentations():
    v = language.vocabulary(tokenizer("piece_bpe_32k.model"))
    known = {p: v.start[i] for i, p in enumerate(v.pieces)}

    def total(word):
        if not word:
            return 1.0
        first = known.get(word[0], v.start[v.unknown]) * total(word[1:])
        return first + sum(known[word[:k]] * total(word[k:]) for k in range(2, len(word) + 1) if word[:k] in known)

    assert any(len(p) > 12 for p in v.pieces)
    for word in ("the", "enant", "chzu", "ß", "日本", "international", "responsibility"):
        got = np.exp(v.logs([word], v.start[:, None])[1][0, 0])
        assert got == pytest.approx(total("▁" + word), rel=1e-9)
    # a long run of letters: the same sum in logarithms, one position after another
    long = "internationalresponsibilities" * 60
    letters, logs = "▁" + long, [0.0]
    for j in range(1, len(letters) + 1):
        ways = [logs[i] + np.log(known.get(letters[i:j], v.start[v.unknown] if j == i + 1 else 0.0)) for i in range(max(0, j - v.longest), j) if j == i + 1 or letters[i:j] in known]
        logs.append(np.logaddexp.reduce(ways))
    assert v.logs([long], v.start[:, None])[1][0, 0] == pytest.approx(logs[-1], rel=1e-9)
    counts = v.expected(collections.Counter({long: 1}))
    assert counts @ np.array([len(p) for p in v.pieces] + [1, 0]) == pytest.approx(len(letters), rel=1e-6)
    counts = v.expected(collections.Counter({"the": 2}))
    assert counts @ np.array([len(p) for p in v.pieces] + [1, 0]) == pytest.approx(8)


# ---- 9 n-gram join ----
def brute_join(rows):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(a & b)
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                part[root(i)] = root(j)
    low = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return collections.Counter((d, len(sets[i]), low.get(root(i))) if sets[i] else (d, 0, d) for i, (d, *_) in enumerate(rows))


def edited(words, rnd, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("hot, room, spread", [(16, 10**6, 256), (2, 2000, 3)])
def test_join(spark, hot, room, spread):
    rnd = random.Random(9)
    rows, n = [(1, "a b c"), (2, None), (3, ""), (None, "A b  c"), (5, "a b c"), (5, "a b c"), (6, "x y"), (7, "word " * 4000), (8, "word " * 5), (None, "only here without id")], 100
    common = [f"c{k}" for k in range(40)]
    for length in (6, 9, 12, 20, 50, 66, 70, 90, 130, 400, 2000):
        base = [f"w{length}_{rnd.randrange(10**6)}" for _ in range(length)]
        for copies in range(8):
            rows.append((n, edited(base, rnd, copies * max(1, length // 60))))
            rows.append((n + 1, edited(base + ["tail"] * 0 + [f"t{k}" for k in range(copies * length // 40)], rnd, 1)))
            n += 2
    for k in range(60):  # a passage that many unlike documents share, and a large group of near copies
        rows.append((n, " ".join(common + [f"u{k}_{i}" for i in range(60)])))
        rows.append((n + 1, edited(common * 3, rnd, rnd.randrange(5))))
        n += 2
    rows.append((None, edited(common * 3, rnd, 3)))  # a near copy without an id
    rows.append((rows[-2][0], "another text of a known id " * 4))
    rnd.shuffle(rows)
    got = collections.Counter(tuple(r) for r in ngram_join.join(docs(spark, rows), keys_per_bucket=3000, most=hot, room=room, spread=spread).collect())
    assert got == brute_join(rows)


def test_classes_by_their_first_half(spark):
    digests = [bytes([b]) + bytes(range(15)) for b in (0, 127, 128, 255)]
    df = spark.createDataFrame([(bytearray(d),) for d in digests], "cls binary").select("cls", ngram_join.short_column("cls").alias("short"))
    assert {bytes(r["cls"]): r["short"] for r in df.collect()} == {d: ngram_join.short_of(d) for d in digests}


def test_links_within():
    """Links connect exactly what brute force connects, within one part and between two."""
    rnd = np.random.default_rng(5)
    sets = [np.unique(np.r_[np.arange(30)[rnd.random(30) < 0.9], rnd.integers(100, 140, 4)]).astype(np.uint64) for _ in range(40)]

    def parts(pairs):
        part = list(range(len(sets)))
        for i, j in pairs:
            part = [part[i] if x == part[j] else x for x in part]
        return {frozenset(np.flatnonzero(np.array(part) == x)) for x in part}

    for side in (np.full(40, 2), np.arange(40) % 2):
        all_pairs = [(i, j) for i in range(40) for j in range(i) if ngram_join.linked(sets[i], sets[j]) and (side[i] == 2 or side[i] != side[j])]
        got = ngram_join.links_within(sets, np.arange(40), side)
        assert parts(got) == parts(all_pairs) and len(got) < 40 and set(got) <= {*all_pairs, *((j, i) for i, j in all_pairs)}


def test_join_of_nothing(spark):
    assert ngram_join.join(docs(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.join(docs(spark, [(1, None)])).collect()] == [(1, 0, 1)]


def test_one_deletion_neighbourhoods():
    """Sets that lack segments still meet: for any two similar sets some key is equal."""
    rnd = np.random.default_rng(3)
    for n in [*range(1, 70), 85, 86, 97, 130, 400]:
        for _ in range(4):
            a = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
            k = rnd.integers(0, max(1, n // 7) + 1)
            b = np.unique(np.concatenate([a[k:], rnd.integers(0, 1 << 63, rnd.integers(0, k + 1)).astype(np.uint64)]))
            if ngram_join.linked(a, b):
                keys = [{(s, x) for s, _, ks in ngram_join.keys_of(y) for x in ks.tolist()} for y in (a, b)]
                assert keys[0] & keys[1]


# ---- 10 fingerprints ----
def test_fingerprints(spark):
    rnd = random.Random(10)
    rows = [(i, t) for i, t in enumerate([None, "", "a b", "a b", "é" * 10, " \n", "word " * 3000])] + [(50 + i, " ".join(f"w{rnd.randrange(90)}" for _ in range(rnd.randrange(400)))) for i in range(60)] + [(-9, "low one here")]
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_edits(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    sets = lambda t: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())(t.lower().split())
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    far = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        e = t[: len(t) - third] + after[:third]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        far += [abs(r["near_edited"] - like(sets(t), sets(e))), abs(r["near_next"] - like(sets(t), sets(after)))]
        if len(sets(t)) < fingerprint.K:
            assert r["n_shingles"] == len(sets(t))
    assert max(far) < 0.2 and np.mean(far) < 0.03
    assert got[2]["fingerprint"] == got[3]["fingerprint"] and got[0]["fingerprint"] == got[1]["fingerprint"] == ""
    assert fingerprint.fingerprint_edits(docs(spark, [])).count() == 0
    one = fingerprint.fingerprint_edits(docs(spark, [(5, "a b c d e f g")])).first()
    assert one["near_next"] == 1.0
    odd = fingerprint.fingerprint_edits(docs(spark, ODD)).collect()
    first = {}
    for r in odd:
        first.setdefault(r["doc_id"], r)
    assert len(odd) == len(ODD) and first[1]["fingerprint"] == first[5]["fingerprint"] != "" == first[2]["fingerprint"] == first[3]["fingerprint"]
    assert collections.Counter((r["doc_id"], r["n_chars"]) for r in odd) == collections.Counter((i, len(t or "")) for i, t in ODD)


@pytest.mark.parametrize("ids", ["far", "equal", "null", "spread"])
def test_next_document(spark, ids):
    """However ids lie, the next document is right and no bucket is much larger than others."""
    rnd = random.Random(11)
    some = {"far": [*range(600), 10**15], "equal": [5] * 500 + list(range(100)), "null": [None] * 500 + list(range(100)), "spread": [rnd.randrange(-(2**62), 2**62) for _ in range(600)]}[ids]
    rows = [(i, f"text {k % 590}") for k, i in enumerate(some)]
    df = docs(spark, rows)
    hashed = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]], r[1]))
    want = collections.Counter((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    assert collections.Counter(tuple(r) for r in fingerprint.with_next(df, rows_per_bucket=8).collect()) == want
    size = fingerprint.with_bucket(df.select("doc_id", "text"), 8).groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert size <= 40


def test_sketches_merge(spark):
    words = [f"w{i}" for i in range(2000)]
    df = spark.createDataFrame([(" ".join(words[:1200]), " ".join(words[1196:]), " ".join(words))], "a string, b string, c string")
    for c in "abc":
        df = fingerprint.with_sketch(df, c, f"s{c}")
    r = df.select((fingerprint.merge(F.col("sa"), F.col("sb")) == F.col("sc")).alias("same"), fingerprint.distinct_shingles(F.col("sc")).alias("n"), fingerprint.containment(F.col("sa"), F.col("sc")).alias("inside")).first()
    assert r["same"] and abs(r["n"] / 1996 - 1) < 0.3 and r["inside"] > 0.8
