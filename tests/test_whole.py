"""Queries that once did a part of their job: each on inputs where the part and the whole differ."""

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from corvane.plans import ORACLE_SQL, QUERIES
from corvane.sources import adapters as A

LONG = "alpha " * 25 + "respiration photosynthesis"  # the last terms stand after character 120


def tables(spark, path, **frames):
    """A folder of tables with the given frames."""
    for name, df in frames.items():
        df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


# ---- questions are whole ----
@pytest.fixture(scope="module")
def asked(spark, tmp_path_factory):
    docs = [(5, "It is photosynthesis that feeds the leaf. " * 3, "en", "web", 120), (10, "nothing of it here", "en", "web", 18), (6, "photosynthesis of another course", "en", "web", 30)]
    vectors = [(i, [float(i), 1.0], 0) for i in (5, 6, 10)]
    return tables(
        spark, tmp_path_factory.mktemp("asked"),
        benchmark=spark.createDataFrame([(5, LONG)], "item_id long, text string"),
        documents=spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        embeddings=spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int"),
    )


@pytest.mark.parametrize("name", ["x3_tokenize", "x31_search_terms", "k5_lexical_score", "k6_hybrid_score", "k7_select_top_k", "k8_term_coverage"])
def test_questions_are_whole(name, spark, asked):
    whole = ORACLE_SQL[name].replace("substring(text, 1, 120) AS query", "text AS query")
    assert difference(QUERIES[name](spark, asked), connect(asked), whole) is None


def test_late_terms_are_found(spark, asked):
    assert A.questions(spark, asked).first()["query"] == LONG
    assert "photosynthesis" in QUERIES["x6_focus_query"](spark, asked).first()["focus"]
    assert not QUERIES["k9_weak_retrieval"](spark, asked).first()["weak"]
    for name in ("t9_hybrid_top_k", "w17_k10_multi_pass"):
        assert (5, 0) in {(r["doc_id"], r["chunkindex"]) for r in QUERIES[name](spark, asked).collect()}
    assert [r["doc_id"] for r in QUERIES["k11_retrieval_report"](spark, asked).filter("selected").collect()] == [5]


# ---- users are the customers, repetition is of what was said ----
@pytest.fixture(scope="module")
def raised(spark, tmp_path_factory):
    users = [2, 5, 300, 501, 512, 1203]
    events = spark.createDataFrame([(i, f"2024-01-10 00:00:{i:02d}", users[i % 6], "error", 1.0, '{"k": 2}') for i in range(60)], "event_id long, ts string, user_id long, event_type string, value double, props string")
    return tables(
        spark, tmp_path_factory.mktemp("raised"),
        events=events.withColumn("ts", F.col("ts").cast("timestamp_ntz")),
        customer=spark.createDataFrame([(i,) for i in users], "c_custkey long"),
        nation=spark.createDataFrame([(i, f"N{i}", 0) for i in range(25)], "n_nationkey int, n_name string, n_regionkey int"),
    )


@pytest.mark.parametrize("name", ["t4_audit_total", "t4_j4_audit_page", "f8_support_filters"])
def test_all_users(name, spark, raised):
    whole = ORACLE_SQL[name].replace(" WHERE userid < 200 AND userid % 9 <> 2", "").replace(" AND userid < 200 AND userid % 9 <> 2", "")
    assert "userid < 200" not in whole
    assert difference(QUERIES[name](spark, raised), connect(raised), whole) is None


def test_said_twice(spark, tmp_path):
    said = {0: "Please tell me about the leaf", 2: "And what else is there to know", 4: "yes", 6: "yes", 8: "please, tell me about the LEAF!"}
    turns = [(1, t, "user", said[t]) for t in said] + [(1, t + 1, "assistant", "Please tell me about the leaf") for t in said]
    path = tables(spark, tmp_path, conversations=spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert {r["turn"]: r["repeats"] for r in QUERIES["w8_repetition"](spark, path).filter("conversationid = 1").collect()} == {0: False, 2: False, 4: False, 6: False, 8: True}


# ---- every chunk is embedded ----
def _keyed_sql(name):
    """The registered SQL over all chunks, by document and chunk."""
    return ORACLE_SQL[name].replace(" WHERE chunkindex = 0 AND ", " WHERE ").replace(" WHERE chunkindex = 0", "").replace("SELECT doc_id FROM docchunks", "SELECT doc_id, chunkindex FROM docchunks").replace("SELECT doc_id, CASE", "SELECT doc_id, chunkindex, CASE")


@pytest.mark.parametrize("name", ["f13_pending_embedding", "k13_attach_embeddings"])
def test_all_chunks_are_embedded(name, spark, tmp_path):
    docs = [(i, "word " * 700, "en", "web", 3500) for i in (1, 3, 4, 6, 9)]
    path = tables(
        spark, tmp_path,
        documents=spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        embeddings=spark.createDataFrame([(i, [0.5, 1.0], 0) for i in (1, 3, 6)], "vec_id long, embedding array<float>, label int"),
    )
    got = QUERIES[name](spark, path)
    assert {r["chunkindex"] for r in got.collect()} == {0, 1, 2, 3}
    assert difference(got, connect(path), _keyed_sql(name)) is None


# ---- urls are looked up in chunks, and the last area of a file wins ----
def test_urls_in_chunks_and_last_area(spark, tmp_path):
    rows = [(3, "see HTTPS://a.org/X and more", "en", "web", 28), (4, "same text", "en", "web", 9), (5, "same text", "en", "web", 9), (8, "same text", "en", "web", 9)]
    path = tables(
        spark, tmp_path,
        documents=spark.createDataFrame([(i, t.replace("HTTPS", "https"), *r) for i, t, *r in rows], "doc_id long, text string, lang string, source string, n_chars long"),
        pages=spark.createDataFrame([(1, "https://b.org/p", '<a href="https://A.org/x">x</a>'), (2, None, None)], "page_id long, url string, html string"),
    )
    got = {(r["page_id"], r["url"]): r["contained"] for r in QUERIES["j11_url_in_chunks"](spark, path).collect()}
    assert got == {(1, "https://b.org/p"): False, (1, "https://A.org/x"): True}
    assert {(r["area"], r["filename"]) for r in QUERIES["w12_last_area"](spark, path).collect()} == {(0, "web/3"), (2, "web/8")}
