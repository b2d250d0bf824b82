"""Line dedup, spelling variants and conversation repair against brute force, with nulls, empty and long texts, ties, repeats, empty tables
and extra columns whose names the operators use themselves."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from corvane.llm import line_dedup, spelling, turn_repair
from corvane.llm.entries import QUERIES
from corvane.llm.line_dedup import dedup

DOC = "doc_id long, text string, lines string, k1 string, at string, word string, n long"
TURN = "conv_id long, turn long, role string, text string, here string, fault string, kind string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "w", 1) for i, t in rows], DOC)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# ---- 11 lines ----
def brute_lines(rows, chars=20, least=3):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    split = [(i, (t or "").split("\n")) for i, t in rows]
    holds = defaultdict(set)
    for i, ls in split:
        for x in ls:
            if len(key(x)) >= chars:
                holds[key(x)].add(i)
    last = {k: max((i for i in ids if i is not None), default=None) for k, ids in holds.items() if len(ids) >= least}
    out = []
    for i, ls in split:
        kept = [x for x in ls if key(x) not in last or last[key(x)] == i]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("common", [4096, 3])
def test_lines(spark, monkeypatch, common):
    monkeypatch.setattr(line_dedup, "COMMON", common)
    rnd, hot = random.Random(3), "The very same Line of all of them"
    pool = [f"{rnd.choice('AbÄß')} line number {i} of the pool" for i in range(30)] + ["short", "", "é" * 20, "é" * 19, " " + "x" * 19]
    dress = lambda x: rnd.choice(["", " ", "\t\r"]) + (x.upper() if rnd.random() < 0.2 and x.isascii() else x) + rnd.choice(["", "\x0b ", "\r"])
    rows = [(rnd.choice([None, *range(60)]), "\n".join(dress(rnd.choice(pool)) for _ in range(rnd.randint(0, 9)))) for _ in range(90)]
    rows += [(i, f"{hot}\n{hot.upper()} \nown {i}") for i in range(100, 160)] + [(200, None), (201, ""), (202, "\n\n"), (None, hot), (203, "\n".join([hot, "a b c"] * 4000)), (203, hot)]
    rows += rows[:5]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in dedup(docs(spark, rows)).collect()]
    assert Counter(got) == Counter(brute_lines(rows))
    assert sum(x[2] for x in got) > 300
    assert dedup(docs(spark, [])).count() == 0


def test_line_thresholds(spark):
    rows = [(i, "ten chars!\nother") for i in range(2)]
    assert Counter((r["doc_id"], r["text"]) for r in dedup(docs(spark, rows), least_chars=10, least_docs=2).collect()) == Counter([(0, "other"), (1, "ten chars!\nother")])
    assert all(r["n_dropped"] == 0 for r in dedup(docs(spark, rows), least_chars=11, least_docs=2).collect())


# ---- 12 spelling ----
def brute_words(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def apart(a, b):
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    near = {w: [x for x in words if apart(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x.encode()), default=None)
        if best and words[best] >= 2 * words[w]:
            form[w] = best
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return out


def variants(df):
    rows = df.collect()
    found = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("few", [spelling.FEW, 4, 0])
def test_variants(spark, few):
    rnd = random.Random(few)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(5, 8))): rnd.choice([3, 3, 4, 6, 7, 12, 24, 25, 50]) for _ in range(250)}
    words |= {"x" * 300: 3, "x" * 299: 9, "x" * 150 + "y" + "x" * 149: 4}
    df = spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n long, len int")
    got = variants(spelling.group_variants(df, few=few))
    assert got == brute_variants(words)
    assert any(form and root != form for _, form, root, *_ in got)


def test_words_of_texts(spark):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("aeiouÀéstn") for _ in range(rnd.randint(4, 9))) for _ in range(60)]
    rows = [(rnd.choice([None, *range(40)]), " ".join(rnd.choice(base) + rnd.choice(["", "s", ",x", "1", "_"]) for _ in range(200))) for _ in range(60)]
    rows += [(1, None), (2, ""), (3, "12 34 日本 ß÷ß×"), (4, "Verylong" * 4000 + " " + "tail " * 5), (5, "Éclair ÉCLAIR éclair " * 5)] + rows[:3]
    words = spelling.counted(spelling.damaged(spelling.runs(docs(spark, rows))))
    want = brute_words(rows)
    assert {r["word"]: r["n"] for r in words.collect()} == want
    assert variants(spelling.group_variants(words)) == brute_variants(want)
    assert spelling.group_variants(spelling.counted(spelling.runs(docs(spark, [])))).count() == 0


# ---- 13 conversations ----
def brute_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_edits(rows, faults):
    """Cheapest path over (row, state) by (cost, audit)."""
    step = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
    heap, seen = [(0, "", 0, "0", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in "0A":
            return cost, audit, out
        if (i, state) in seen:
            continue
        seen.add((i, state))
        options = [(2, "I", i, c, name, "") for c, name in (("u", "user"), ("a", "assistant"))]
        if i < len(rows):
            (_, role, text), cut = rows[i], faults[i] == "truncated"
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                options += [(cut, "K", i + 1, role[:1], role, text), *((2 + cut, "R", i + 1, c, name, text) for c, name in (("u", "user"), ("a", "assistant")))]
        for more, letter, at, c, name, text in options:
            if (state, c) in step:
                heapq.heappush(heap, (cost + more, audit + letter, at, step[state, c], (*out, f"{name}:{text}")))


def brute_conversations(rows):
    known = lambda x: " " if x is None else str(x)
    convs = defaultdict(list)
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{known(c)}:{known(t)}".encode()) % 20
        role, text = "user" if kind == 4 else known(role), "" if kind == 1 else re.sub("[.!?]", "", known(text)) if kind == 2 else known(text)
        convs[c] += [(t, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = set()
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        faults, nums = brute_faults(turns), [t for t, *_ in turns if t is not None]
        cost, audit, kept = brute_edits(turns, faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        gaps = max(nums) - min(nums) + 1 - len(set(nums)) if nums else 0
        out.add((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def talk(spark, rows):
    return spark.createDataFrame([(*r, "h", "f", "k") for r in rows], TURN)


def test_repair(spark):
    rnd = random.Random(13)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "$", "", None], ["Same.", "same", " ", "\n", None, "é!", "end? ", "cut", "."]
    rows = [(rnd.choice([None, *range(300)]), rnd.choice([None, *range(12)]), rnd.choice(roles), rnd.choice([f"own {i}.", f"own {i}", *texts])) for i in range(2500)]
    rows += [(1000 + i, t, ("user", "assistant")[t % 2], f"turn {t}.") for i in range(200) for t in range(rnd.choice([1, 2, 6]))]
    rows += [(2000, t, "user", f"all by one {t}." + "x" * 3000 * (t % 7 == 0)) for t in range(301)] + [(2001, t, "user", "the same.") for t in range(300)] + [(2002, 5, "user", "long " * 200_000 + "?")]
    rows += rows[:7]
    df = turn_repair.digests(turn_repair.repair(turn_repair.damage(talk(spark, rows)), here="here"))
    got = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    want = brute_conversations(rows)
    assert len(got) == len(want) and set(got) == want
    assert any(x[-2] == "" and x[0] is not None and x[0] >= 1000 for x in got)  # of some conversation nothing is left
    assert turn_repair.digests(turn_repair.repair(talk(spark, []))).count() == 0


def test_edits(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 2, "assistant", "Hello."), (1, 3, "assistant", "And"), (1, 3, "assistant", "And"), (1, None, "user", " ")]
    got = [tuple(r) for r in turn_repair.repair(talk(spark, rows)).select("turn", "action", "role", "text", "cost", "fault", "said_as").collect()]
    assert got == [
        (None, "D", "user", " ", 3, "blank", "user"),
        (0, "K", "system", "Be kind.", 0, "", "system"),
        (2, "R", "user", "Hello.", 2, "", "assistant"),
        (3, "K", "assistant", "And", 1, "truncated", "assistant"),
        (3, "D", "assistant", "And", 3, "duplicate", "assistant"),
    ]


def test_first_edit_may_depend_on_the_last_row():
    p = turn_repair.Parser(turn_repair.Tables(turn_repair.GRAMMAR))
    audits = {}
    for n in (400, 401):
        rows = [(1, i, "user", f"{i}.", True, "") for i in range(n)]
        audits[n] = "".join(x[4] for x in reversed(list(turn_repair.backward(reversed(list(turn_repair.forward(rows)))))))
    assert audits == {400: "KR" * 200, 401: "KI" + "KR" * 200}
    assert p.close() == "0,"


# ---- the registered queries on their tables ----
@pytest.mark.parametrize("name, sort", [("op12_spelling", "word"), ("op13_turn_repair", "conv_id")])
def test_queries(spark, sf_dir, name, sort):
    table = {"op12_spelling": ("documents", ["doc_id", "text"]), "op13_turn_repair": ("conversations", ["conv_id", "turn", "role", "text"])}[name]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{table[0]}.parquet").select(*table[1]).collect()]
    df = QUERIES[name](spark, sf_dir)
    if name == "op12_spelling":
        assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        words = brute_words(rows)
        by_form = defaultdict(set)  # one-deletion keys, so that all words can be compared
        for w in words:
            for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
                by_form[k].add(w)
        near = defaultdict(set)
        for ws in by_form.values():
            for w in ws:
                near[w] |= {x for x in ws if apart(w, x)}
        got = {r["word"]: r for r in df.collect()}
        assert {w: r["n"] for w, r in got.items()} == words and all(got[w]["n_near"] == len(near[w]) for w in words)
        for w in words:
            best = min(near[w], key=lambda x: (-words[x], x.encode()), default=None)
            assert got[w]["form"] == (best if best and words[best] >= 2 * words[w] else None)
    else:
        assert df.columns == COLUMNS and {tuple(r) for r in df.collect()} == brute_conversations(rows)
