"""The published cases, on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvane.functions import classify as C
from corvane.functions import text as X
from corvane.operators import dashboard as D
from corvane.operators import history as H
from corvane.operators import knowledge as K
from corvane.operators import learners as L
from corvane.operators import retrieval as R
from corvane.operators import rollup as U
from corvane.operators import tickets as T
from corvane.streaming import streams as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def texts(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", f("t").alias("x")).orderBy("i")
    return [r["x"] for r in rows.collect()]


STATS = "courseid long, blockinstanceid long, daterecorded date, role string, route string, agentid long, model string, messages long, errors long, prompttokens long, cachedtokens long, completiontokens long, totaltokens long"
DAY = dt.date(2024, 1, 2)


def stat(role, model, prompt, cached, completion, day=DAY):
    return (1, 0, day, role, "tutor", 0, model, 1, 0, prompt, cached, completion, prompt + completion)


PRICES = [("gpt-5-mini", dt.date(1970, 1, 1), 0.25, 2.0, 0.025), ("gpt-4.1-mini", dt.date(1970, 1, 1), 0.4, 1.6, 0.1), ("g", dt.date(1970, 1, 1), 1.0, 1.0, 1.0), ("g", dt.date(2024, 2, 1), 2.0, 2.0, 2.0)]
PRICE = "model string, valid_from date, input double, output double, cached double"


def test_cached_prices(spark):
    stats = spark.createDataFrame([stat("assistant", "gpt-5-mini", 1000, 800, 100), stat("assistant", "gpt-4.1-mini", 500, 0, 50)], STATS)
    got = {r["model"]: r["cost"] for r in D.cost_by_model(stats, spark.createDataFrame(PRICES, PRICE)).collect()}
    assert got == pytest.approx({"gpt-5-mini": 0.00027, "gpt-4.1-mini": 0.00028})
    assert D.cost_kpis(stats, spark.createDataFrame(PRICES, PRICE)).first()["cachedshare"] == pytest.approx(800 / 1500)


def test_dated_names_and_price_changes(spark):
    rows = [stat("assistant", "models/GPT-5-mini-20250101", 10, 0, 0), stat("assistant", "g-2024-01-01", 10, 0, 0, dt.date(2024, 2, 1)), stat("assistant", "g", 10, 0, 0), stat("assistant", "nobody", 10, 0, 0)]
    got = U.with_prices(spark.createDataFrame(rows, STATS), U.price_periods(spark.createDataFrame(PRICES, PRICE))).collect()
    assert {r["model"]: r["price"] and r["price"]["input"] for r in got} == {"models/GPT-5-mini-20250101": 0.25, "g-2024-01-01": 2.0, "g": 1.0, "nobody": None}


def test_price_lines(spark):
    lines = spark.createDataFrame([("My-Model | 1 | 2 | 0.1",), ("other-model | 3 | 4",), ("# no",), ("",), ("short | 1",), ("gpt-5-mini|9|9|9",)], "value string")
    base = spark.createDataFrame([("gpt-5-mini", 0.25, 2.0, 0.025)], "model string, input double, output double, cached double")
    assert {tuple(r) for r in U.load_price_table(lines, base).collect()} == {("my-model", 1.0, 2.0, 0.1), ("other-model", 3.0, 4.0, 3.0), ("gpt-5-mini", 9.0, 9.0, 9.0)}


def test_tool_payload(spark):
    got = spark.createDataFrame([('{"tool": "a", "ok": true}',), ('{"ok": "0"}',), ("nothing",), ('{"tool": "b", "ok": false}',)], "other string").select(*U.parse_tool_payload()).collect()
    assert [tuple(r) for r in got] == [("a", True), ("unknown", False), ("unknown", False), ("b", False)]


def test_rollup_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, DAY, 5), (2, dt.date(2024, 1, 3), 6)], "courseid long, daterecorded date, n long")
    for _ in range(2):
        U.write_rollup(df, str(tmp_path / "r"))
    U.write_rollup(df.filter("courseid = 1").withColumn("n", F.lit(7).cast("long")), str(tmp_path / "r"))
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [6, 7]


def test_tokens_and_names(spark):
    assert one(spark, X.tokenize(F.lit("¿Qué es la técnica Si - No - Si?"))) == ["qué", "técnica", "si-no-si"]
    assert one(spark, X.name_terms(F.lit("Necesito el FODA y Paro-Pienso-Procedo"))) == ["paro-pienso-procedo", "foda"]
    assert one(spark, X.focus_query(F.lit("Explain the FODA for me"))) == "foda"
    assert one(spark, X.focus_query(F.lit("a few words"))) == ""
    assert one(spark, X.term_hits(F.lit("iar, iar; diario"), F.lit("iar"))) == 2
    assert one(spark, X.term_hits(F.lit("photosynthesis photosynthetic"), F.lit("photo"))) == 2
    assert one(spark, X.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0


def test_summaries_and_secrets(spark):
    a, b = texts(spark, ["No  puedo ENTRAR, al aula", "no puedo entrar al áula"], X.summary_hash)
    assert a == b
    assert texts(spark, ["one two three", "uno dos tres cuatro"], X.fingerprint) == ["", "uno dos tres cuatro"]
    assert texts(spark, ["key sk-abcdefghij12 end"], X.redact_secrets) == ["key sk-[REDACTED] end"]
    assert texts(spark, ["hi\nstate.intent = x\nbye\nSummary: all"], X.strip_internal_state) == ["hi\n\nbye"]
    import hashlib
    import hmac

    assert one(spark, X.pseudonymise(F.lit("a@b.c"), b"k")) == hmac.new(b"k", b"a@b.c", hashlib.sha256).hexdigest()[:32]
    assert texts(spark, ["<p>a&nbsp;&amp; b</p><script>x</script><br>c"], X.html_to_plain) == ["a & b c"]
    assert texts(spark, ["it&#39;s &#233;&#xE9; &#x1F600; &amp;#38; &#0; &#xD800; &#99999999;", "plain"], X.html_to_plain) == ["it's éé 😀 &#38; &#0; &#xD800; &#99999999;", "plain"]


def test_human_requests(spark):
    said = ["quiero hablar con una persona", "¿cómo puedo contactar con soporte?", "¿cómo hablo con soporte? necesito hablar con alguien", "quiero saber cómo contactar con soporte", "soporte técnico", "what is photosynthesis", "hazlo tú", "raise a ticket please"]
    assert texts(spark, said, C.human_request_kind) == ["request", "howto", "request", "howto", "request", "", "request", "request"]


def test_rules(spark):
    assert texts(spark, ["Pick the correct: a) x b) y", "a) x b) y", "true or false: water is wet"], C.looks_like_quiz) == [True, False, True]
    assert texts(spark, ["what is my grade?", "what is a rubric grade", "when is the essay due"], C.looks_like_platform_query) == [True, False, True]
    assert texts(spark, ["gracias", "gracias, revisa otra vez", "gracias?"], C.is_courtesy) == [True, False, False]
    assert texts(spark, ["hola", "¿y eso?", "uno dos tres cuatro cinco"], C.carries_a_request) == [False, True, True]
    assert texts(spark, ["contact the support team", "the course starts now"], C.recommends_support) == [True, False]
    assert texts(spark, ['{"intent":"tutor"}', '{"intent":"asistente","confidence":0.5}', "x", '{"intent":"tutor","confidence":0.7,"needs_clarification":true}'], C.interpret_intent) == ["tutor", "ambiguous", "ambiguous", "ambiguous"]
    assert texts(spark, ["what is the due date for this course", "no gracias thanks", "¿cuándo es la entrega del curso?"], C.detect_language) == ["English", "", "Spanish"]
    assert one(spark, C.accepts_an_offer(F.lit("sí, quiero que lo reporten"), F.lit("Puedo preparar la solicitud"))) is True
    assert one(spark, C.accepts_an_offer(F.lit("no"), F.lit("Puedo preparar la solicitud"))) is False
    assert texts(spark, ["  ", "x" * 4001, "a\x07b"], lambda c: C.guardrail_check(c)[0]) == ["emptymessage", "messagetoolong", ""]


def test_headings_and_chunks(spark):
    assert texts(spark, ["Unidad 2", "3.2 Title", "II.1 Pasos", "SHORT CAPS", "A sentence.", "Unidad 3 ....... 62", "plain words"], K.is_heading) == [True, True, True, True, False, False, False]
    lines = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(["Unidad 1", "Paso I", "1.1 Deep", "body", "Unidad 2", "body"])], "doc string, page int, at int, line string")
    paths = [r["path"] for r in K.heading_paths(lines).orderBy("at").collect()]
    assert paths[3] == "Unidad 1 › Paso I › 1.1 Deep" and paths[5] == "Unidad 2"
    docs = spark.createDataFrame([(1, "a" * 60 + "\n\n" + "b" * 60 + "\n\n" + "c" * 250)], "doc_id long, text string")
    got = [r["content"] for r in K.paragraph_chunks(docs, size=100, overlap=10).orderBy("chunkindex").collect()]
    assert got[0] == "a" * 60 and got[1] == "b" * 10 + "\n\n" + "b" * 60 and got[2] == "c" * 100
    figs = spark.createDataFrame([("d", 1, "Unidad 1\nFigure 3: The cycle.\nfigure 3: the cycle"), ("d", 2, "no caption")], "doc string, page int, text string")
    found = K.figure_captions(figs, "doc", "page", "text").collect()
    assert [(r["page"], r["label"]) for r in found] == [(1, "figure 3: the cycle")] and found[0]["content"].startswith("[Section: Unidad 1 › figure 3: the cycle | p. 1]\n[FIGURE REFERENCE]")
    assert texts(spark, ["i. also note this", "I. Note this", "iv) Title", "v.2 part"], K.is_heading) == [False, True, True, True]


def test_sections_of_chunks(spark):
    """Headings and pages carry over pages; a chunk that begins with its heading has only the page; none without headings."""
    pages = spark.createDataFrame([(1, 1, "Unidad 1\nPaso I\n\n" + "first " * 10), (1, 2, "more " * 10 + "\n\nUnidad 2\n\nlast"), (2, 1, "plain text here")], "doc_id long, page int, text string")
    got = [r["content"] for r in K.paragraph_chunks(pages.filter("doc_id = 1"), page="page", size=80, overlap=5).orderBy("chunkindex").collect()]
    assert got[0].startswith("[Section: Unidad 1 › Paso I | p. 1]\nUnidad 1\nPaso I\n\nfirst") and got[1].startswith("[Section: Unidad 1 › Paso I | p. 2]\n") and "\n\nmore" in got[1]
    assert got[1].endswith("Unidad 2\n\nlast") or got[2].startswith("[Section: Unidad 2 | p. 2]")
    assert [r["content"] for r in K.paragraph_chunks(pages.filter("doc_id = 2")).collect()] == ["plain text here"]
    assert K.paragraph_chunks(pages.filter("doc_id = 3")).count() == 0


def test_fallbacks_within_words(spark):
    """Heads are found as substrings, also across the ends of words."""
    said = ["sorry i cannot answer that now", "xsorry i cannot answer thatx", "i cannot", "please say it again", "a b", ""]
    replies = spark.createDataFrame([(1, i, t) for i, t in enumerate(said)], "conversationid long, turn long, words string")
    for heads in (["sorry i cannot answer that"], ["say it"], ["ag"], ["b"], ["x y z"], [""], []):
        got = H.used_fallback(replies, spark.createDataFrame([(h,) for h in heads], "fp string"), "words")
        assert {r["turn"]: r["fallback"] for r in got.collect()} == {i: any(h and h in t for h in heads) for i, t in enumerate(said)}


def test_offer_gate(spark):
    """Every outcome: what blocks, silence after a refusal, no trigger, an opening request without a problem, allowed."""
    script = {
        1: [("user", "quiero hablar con una persona")],
        2: [("user", "hola"), ("assistant", "dime"), ("user", "quiero hablar con una persona")],
        3: [("user", "hola")],
        4: [("user", "no puedo entrar"), ("assistant", "x"), ("user", "sigue fallando"), ("user", "y ahora"), ("user", "otra vez")],
        5: [("user", "quiero hablar con una persona")],
    }
    turns = spark.createDataFrame([(c, i, r, t) for c, ts in script.items() for i, (r, t) in enumerate(ts)], "conversationid long, turn long, role string, content string")
    trigger = F.when(F.col("conversationid") == 3, "").otherwise("asked")
    blocked = spark.createDataFrame([(5, "quota"), (5, ""), (1, ""), (1, "")], "conversationid long, denied string")
    refusals = spark.createDataFrame([(4, 1), (9, 1)], "conversationid long, refused long")
    got = T.offer_gate(turns, turns.filter("role = 'user'").withColumn("trigger", trigger), blocked, refusals, 2)
    assert {(r["conversationid"], r["turn"]): r["reason"] for r in got.collect()} == {
        (1, 0): "needdetail", (2, 0): "allowed", (2, 2): "allowed", (3, 0): "notrigger", (4, 0): "allowed", (4, 2): "refused", (4, 3): "refused", (4, 4): "allowed", (5, 0): "quota",
    }


def test_links(spark):
    """A link stays if it goes to the own host or stands in the content of its own scope, in any case and anywhere; targets that are no address go."""
    said = "see [a](https://OK.org/x) and [b](https://bad.org/y) and [c](https://in.org/z)[d](support_url)[]( )"
    rows = [(1, 1, said), (2, 2, said), (3, 1, "none"), (4, 1, None), (5, 1, "[e](https://u@ok.org:80/q?x#y)[f](https://ok.org.evil.net)[g](HTTPS://in.ORG/z)"), (1, 1, said)]
    t = spark.createDataFrame(rows, "i int, courseid long, t string")
    chunks = spark.createDataFrame([(1, "go to HTTPS://IN.org/Zebra now"), (2, "https://in.org/"), (1, None)], "courseid long, content string")
    got = sorted((r["i"], r["t"]) for r in K.clean_links(t, "t", chunks, "ok.org").collect() if r["t"])
    kept = "see [a](https://OK.org/x) and b and [c](https://in.org/z)d[]( )"
    assert got == [(1, kept), (1, kept), (2, "see [a](https://OK.org/x) and b and cd[]( )"), (3, "none"), (5, "[e](https://u@ok.org:80/q?x#y)f[g](HTTPS://in.ORG/z)")]
    assert K.clean_links(t, "t", chunks, "ok.org").columns == t.columns


CHUNK = "courseid long, doc_id long, chunkindex long, filename string, content string"


def test_titled_section_wins(spark):
    chunks = spark.createDataFrame([(1, 1, 0, "f", "sandwich sandwich sandwich mention"), (1, 2, 0, "f", "[Section: Sandwich]\nthe tool"), (2, 3, 0, "f", "sandwich elsewhere"), (1, 4, 0, "f", "other")], CHUNK)
    q = spark.createDataFrame([(9, 1, "what is the sandwich")], "queryid long, courseid long, query string")
    top = R.lexical_top(q, chunks, 2)
    assert [(r["doc_id"], r["place"]) for r in top.orderBy("place").collect()] == [(2, 1), (1, 2)]
    none = spark.createDataFrame([(9, 1, "zebra quagga")], "queryid long, courseid long, query string")
    empty = R.lexical_top(none, chunks, 2)
    assert empty.count() == 0 and R.weak_retrieval(none, empty).first()["weak"] and R.term_coverage(none, empty).first()["coverage"] == 0.0


def test_round_robin(spark):
    rows = [(1, p, i + 1, n, n) for p, names in enumerate((["A1", "A2", "A3", "A4"], ["B1", "A2", "B3", "B4"])) for i, n in enumerate(names)]
    lists = spark.createDataFrame(rows, "queryid long, pass int, rank int, filename string, content string")
    assert [r["filename"] for r in R.merge_ranked(lists, 6).orderBy("place").collect()] == ["A1", "B1", "A2", "A3", "B3", "A4"]


def test_gate(spark):
    ts = [dt.datetime(2024, 1, 1, h) for h in (8, 9, 10, 23)]
    rows = [(i, 1, 0, u, 1, "x", "h", st, t, t) for i, (u, st, t) in enumerate([(5, "sent", ts[0]), (5, "failed", ts[1]), (6, "queued", ts[2]), (0, "draft", ts[3])])]
    t = spark.createDataFrame(rows, "ticketid long, courseid long, blockinstanceid long, userid long, conversationid long, category string, summaryhash string, status string, timecreated timestamp_ntz, timemodified timestamp_ntz")
    assert [r["denied"] for r in T.escalation_gate(t, True, 1, 30, 2).orderBy("ticketid").collect()] == ["", "quota", "", "capability"]
    assert {r["denied"] for r in T.escalation_gate(t, False, 1, 30, 2).collect()} == {"disabled"}
    assert [r["duplicate"] for r in T.duplicates(t, 24).orderBy("ticketid").collect()] == [False, True, False, False]


def test_learner_states(spark):
    d = dt.date
    e = spark.createDataFrame([(1, 1, False, d(2020, 1, 1), None), (2, 1, False, d(2020, 1, 1), d(2021, 1, 1)), (3, 1, False, d(2030, 1, 1), None), (4, 1, True, d(2020, 1, 1), None), (5, 2, False, d(2020, 1, 1), None), (6, 3, False, d(2020, 1, 1), None)], "userid long, courseid long, suspended boolean, timestart date, timeend date")
    c = spark.createDataFrame([(1, True, None), (2, False, None), (3, True, d(2022, 1, 1))], "courseid long, visible boolean, enddate date")
    got = {r["userid"]: r["status"] for r in L.access_status(e, c, "2024-01-01").collect()}
    assert got == {1: "active", 2: "expired", 3: "not_started", 4: "suspended", 5: "course_hidden", 6: "course_ended"}
    attempts = spark.createDataFrame([(1, 1, 1, "finished", False), (1, 1, 2, "overdue", False), (1, 1, 3, "finished", True)], "userid long, quizid long, attempt int, state string, preview boolean")
    assert tuple(L.quiz_attempt_state(attempts, spark.createDataFrame([(1, 0)], "quizid long, allowed int")).select("finished", "inprogress", "allowed").first()) == (1, 1, None)
    assert L.attempts_in_order(attempts, 2).count() == 2
    posts = spark.createDataFrame([(1, 7, 1, 10), (2, 7, 1, 11)], "postid long, userid long, discussionid long, created long")
    assert tuple(L.forum_participation(posts, spark.createDataFrame([(1, 3, 1)], "discussionid long, forumid long, firstpostid long")).first()) == (7, 3, 2, 1, 11)
    notes = spark.createDataFrame([(1, i, i, None, f"s{i}") for i in range(7)] + [(1, 99, 99, 5, "read")], "userid long, noteid long, timecreated long, timeread long, subject string")
    r = L.unread_notifications(notes).first()
    assert r["unread"] == 7 and [x for x in r["latest"] if x] == ["s6", "s5", "s4", "s3", "s2"]
    groups = spark.createDataFrame([(1, 1, 2, "b"), (1, 1, 1, "a"), (1, 1, 1, "a")], "userid long, courseid long, groupid long, groupname string")
    assert L.member_groups(groups).first()["groups"] == ["a", "b"]
    items = spark.createDataFrame([(1, 1, "mod", False), (2, 1, "course", False), (3, 1, "mod", True)], "itemid long, courseid long, itemtype string, hidden boolean")
    g = L.gradebook_items(items, spark.createDataFrame([(1, 9, 5.0), (2, 9, 7.0)], "itemid long, userid long, grade double")).collect()
    assert [(x["itemid"], x["grade"], x["coursetotal"]) for x in g] == [(1, 5.0, 7.0)]


def test_enrolment_methods(spark):
    d = dt.date
    m = spark.createDataFrame(
        [(1, 1, "self", "k", 0, None, None, True, 0, None), (2, 1, "self", "", 4, None, None, True, 0, None), (3, 1, "self", "", 0, d(2030, 1, 1), None, True, 0, None), (4, 1, "self", "", 0, None, None, True, 1, None), (5, 1, "fee", "", 0, None, None, True, 0, None), (6, 1, "manual", "", 0, None, None, True, 0, None)],
        "methodid long, courseid long, method string, password string, cohortid long, opens date, closes date, newenrols boolean, seats int, cost double",
    )
    got = L.enrolment_availability(m, spark.createDataFrame([(7, 1)], "userid long, courseid long"), spark.createDataFrame([(8, 4)], "userid long, methodid long"), spark.createDataFrame([], "userid long, cohortid long"), "2024-01-01")
    assert {r["methodid"]: (r["available"], r["reason"]) for r in got.collect()} == {1: (True, "needs_key"), 2: (False, "cohort_only"), 3: (False, "not_open_yet"), 4: (False, "full"), 5: (True, None), 6: (None, None)}
    assert {r["methodid"]: r["cost"] for r in L.enrolment_restriction(m, 5.0).collect()}[5] == 5.0


def test_search_and_credentials(spark):
    acts = spark.createDataFrame([(1, "2.6 Actividad individual"), (2, "2.3. Webinar: Semana 2"), (3, "Otra cosa")], "cmid long, name string")
    assert L.activity_search(acts, "actividad 2.6", 1).first()["cmid"] == 1
    assert L.activity_search(acts, "2.3 Webinar Semana 2", 1).first()["cmid"] == 2
    issues = spark.createDataFrame([(1, 5, 1, dt.date(2024, 1, 1), "c1")], "userid long, templateid long, courseid long, issued date, code string")
    certs = L.certificate_credentials(issues, spark.createDataFrame([(5, "T")], "templateid long, name string"), spark.createDataFrame([], "templateid long, cmid long, visible boolean"), spark.createDataFrame([(1, "Course")], "courseid long, fullname string"))
    badges = spark.createDataFrame([(1, "badge", "B", "badges")], "userid long, type string, name string, source string")
    out = L.credentials(certs, badges)
    assert out.columns == L.CREDENTIAL and out.count() == 2


def test_late_facts_rebuild_their_day(spark, tmp_path):
    sink = S.rollup_sink(str(tmp_path / "facts"), str(tmp_path / "rollup"), U.build_userstats)
    make = lambda *ts: spark.createDataFrame([(i, 1, 7, 0, "user", t) for i, t in enumerate(ts)], "messageid long, courseid long, userid long, blockinstanceid long, role string, timecreated timestamp")
    sink(make(dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 2, 5)), 0)
    sink(make(dt.datetime(2024, 1, 1, 9)), 1)
    sink(make(dt.datetime(2024, 1, 1, 9)), 1)
    got = {str(r["daterecorded"]): r["numquestions"] for r in spark.read.parquet(str(tmp_path / "rollup")).collect()}
    assert got == {"2024-01-01": 2, "2024-01-02": 1}


def test_availability_without_pairs_in_a_shuffle(spark):
    """Users and methods meet after what users are in was gathered: only the users' own rows are shuffled."""
    users = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "userid long, courseid long")
    m = spark.createDataFrame([(i, 1, "self", 7 if i == 3 else 0, "", None, None, None, True, 0) for i in range(1, 5)], "methodid long, courseid long, method string, cohortid long, password string, cost double, opens date, closes date, newenrols boolean, seats long")
    enrolled = spark.createDataFrame([(1, 2), (1, 2), (2, None), (9, 1)], "userid long, methodid long")
    members = spark.createDataFrame([(2, 7), (2, 7), (3, None)], "userid long, cohortid long")
    got = L.enrolment_availability(m, users, enrolled, members, "2024-01-01")
    reasons = {(r["userid"], r["methodid"]): r["reason"] for r in got.collect()}
    assert reasons == {(u, i): "already_enrolled" if (u, i) == (1, 2) else "cohort_only" if i == 3 and u != 2 else None for u in (1, 2, 3) for i in range(1, 5)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Join" in line][0].count("Inner") == 1


def test_vague_of_any_script(spark):
    """A pointing word ends where no letter of any script follows, in the query and in its SQL."""
    import duckdb

    from corvane.functions.classify import is_vague
    from corvane.plans import ORACLE_SQL

    rows = [(1, 1, "user", "responde ñesta larga pregunta sobre mitosis"), (1, 2, "user", "responde esta larga pregunta sobre mitosis"), (1, 3, "user", "responde ité larga pregunta sobre mitosis"), (1, 4, "user", "algo, (esto) responde larga pregunta siempre")]
    want = [(1, False), (2, True), (3, False), (4, True)]
    got = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("turn", is_vague("text").alias("vague"))
    assert sorted(map(tuple, got.collect())) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert con.execute(f"SELECT turn, vague FROM ({ORACLE_SQL['x27_is_vague']}) WHERE conversationid = 1 ORDER BY turn").fetchall() == want


def test_pairs_of_users_and_methods_lie_method_by_method(spark):
    """Pairs come out as long runs of one method, which take little in a file (finding F2 of round 4); users twice in a course come twice, ones of no course never."""
    day = dt.date(2023, 1, 1)
    m = spark.createDataFrame([(i, i % 2, "self", 0, "", None, day, dt.date(2025, 1, 1), True, 0) for i in range(40)], "methodid long, courseid long, method string, cohortid long, password string, cost double, opens date, closes date, newenrols boolean, seats long")
    users = [*((u, u % 3) for u in range(600)), (0, 0), (700, None)]
    got = L.enrolment_availability(m, spark.createDataFrame(users, "userid long, courseid long"), spark.createDataFrame([(3, 4)], "userid long, methodid long"), spark.createDataFrame([], "userid long, cohortid long"), "2024-01-01").collect()
    assert sorted((r["userid"], r["methodid"]) for r in got) == sorted((u, i) for u, c in users for i in range(40) if i % 2 == c)
    assert sum(a["methodid"] != b["methodid"] for a, b in zip(got, got[1:], strict=False)) < len(got) / 20
