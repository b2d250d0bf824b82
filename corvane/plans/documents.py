"""Queries over the knowledge base and retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.text import ACCENTED, PLAIN
from corvane.operators import containment as C
from corvane.operators import history as H
from corvane.operators import index_store as I
from corvane.operators import knowledge as K
from corvane.operators import retrieval as R
from corvane.plans.registry import query
from corvane.session import shared_folder, table
from corvane.sources import adapters as A


def shared(s):
    """A new folder where driver and executors can write."""
    return f"{shared_folder(s, 'spark-index-')}/index-{uuid.uuid4().hex}"


def docs(s, d):
    return table(s, d, "documents")


def files(s, d):
    return docs(s, d).select(F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("contenthash"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("filename"), "text")


def lines(s, d):
    return K.page_lines(docs(s, d), "source", "doc_id", "text")


query("s10_ingest_documents", "", r"""WITH f AS (SELECT sha1(text) AS contenthash, source || '/' || doc_id AS filename, text, row_number() OVER (PARTITION BY sha1(text) ORDER BY source || '/' || doc_id) AS n FROM documents),
a AS (SELECT contenthash, filename, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160), ' ', 'g') AS x FROM f WHERE n = 1),
b AS (SELECT contenthash, filename, regexp_replace(x, '[\x{200B}-\x{200D}\x{2060}\x{FEFF}]|[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') AS x FROM a),
c AS (SELECT contenthash, filename, trim(regexp_replace(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS x FROM b)
SELECT contenthash, filename, CASE WHEN length(regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')) < 10 THEN 'EMPTY' ELSE 'READY' END AS status, CAST(length(x) AS INTEGER) AS charcount FROM c""")(
    lambda s, d: K.ingest_documents(files(s, d)).drop("extractedtext")
)
query("k3_window_chunks", "docchunks", "SELECT doc_id, chunkindex, md5(content) AS content FROM docchunks")(lambda s, d: A.chunks(s, d).select("doc_id", "chunkindex", F.md5(F.col("content").cast("binary")).alias("content")))
query("k3_paragraph_chunks")(lambda s, d: K.paragraph_chunks(docs(s, d), page="doc_id").select("doc_id", "chunkindex", F.char_length("content").alias("chars")))
_LINES = r"""WITH l AS (SELECT source AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
t AS (SELECT doc, page, pos, regexp_replace(trim(line), '(?i)^(?:p[aá]gina|page|p[aá]g\.?)\s*\d+\b\s*', '') AS line FROM l WHERE NOT regexp_matches(trim(line), '\.{4,}')),
o AS (SELECT doc, lower(trim(line)) AS norm, count(DISTINCT page) AS n FROM t WHERE length(trim(line)) >= 25 GROUP BY ALL), p AS (SELECT doc, count(DISTINCT page) AS pages FROM t GROUP BY 1),
b AS (SELECT doc, norm FROM o JOIN p USING (doc) WHERE pages >= 4 AND n >= ceil(pages * CAST(0.02 AS DOUBLE)))"""
query("a22_boilerplate", "", f"{_LINES} SELECT doc, norm FROM b")(lambda s, d: K.boilerplate(lines(s, d), share=0.02))
query("k1_denoise", "", f"{_LINES.replace('0.02', '0.6')} SELECT doc, page, md5(string_agg(line, chr(10) ORDER BY pos)) AS text FROM t WHERE (doc, lower(trim(line))) NOT IN (SELECT doc, norm FROM b) GROUP BY ALL")(
    lambda s, d: K.denoise(docs(s, d), "source", "doc_id", "text").withColumn("text", F.md5(F.col("text").cast("binary")))
)
# heading words end where no letter, digit or underscore follows; of roman numbers without a further number a capital must follow
_WORDS = lambda p: p.removeprefix("(?iU)")[:-2].replace("'", "''")
_IS_HEADING = f"""length(line) BETWEEN 3 AND 120 AND NOT regexp_matches(line, '[.,;]\\s*$') AND NOT regexp_matches(line, '\\.{{4,}}') AND (regexp_matches(line, '(?i){_WORDS(K.HEADING)}($|[^\\p{{L}}\\p{{N}}_])')
OR regexp_matches(line, '^\\d{{1,2}}(\\.\\d{{1,2}}){{0,3}}[.)]?\\s+\\p{{Lu}}') OR regexp_matches(line, '^(?i:[ivxlcdm]{{1,6}})(\\.\\d{{1,2}}[.)]?\\s+\\p{{L}}|[.)]\\s+\\p{{Lu}})') OR (length(line) <= 80 AND regexp_matches(line, '\\p{{Lu}}') AND NOT regexp_matches(line, '\\p{{Ll}}')))"""
_LEVEL = f"CASE WHEN regexp_matches(line, '(?i){_WORDS(K.LEVEL_1)}($|[^\\p{{L}}\\p{{N}}_])') THEN 1 WHEN regexp_matches(line, '(?i){_WORDS(K.LEVEL_2)}($|[^\\p{{L}}\\p{{N}}_])') THEN 2 ELSE 3 END"
query("k2_headings", "", f"{_LINES} SELECT line, count(*) AS n, max({_LEVEL}) AS level FROM t WHERE {_IS_HEADING} GROUP BY 1")(lambda s, d: lines(s, d).filter(K.is_heading("line")).groupBy("line").agg(F.count("*").alias("n"), F.max(K.heading_level("line")).alias("level")))
query("w13_heading_paths")(lambda s, d: K.heading_paths(K.page_lines(docs(s, d), "doc_id", "doc_id", "text")).groupBy("doc").agg(F.max("path").alias("path"), F.count("*").alias("lines")))
query("k4_figure_captions")(lambda s, d: K.figure_captions(docs(s, d), "source", "doc_id", "text"))


def _index(s, d):
    """An index that lacks some files, has some gone, renamed or cut by an older version."""
    f = docs(s, d).select("doc_id", F.sha1(F.col("text").cast("binary")).alias("contenthash"), "source").groupBy("contenthash").agg(F.min("doc_id").alias("doc_id"), F.min("source").alias("source"))
    had = f.filter("doc_id % 7 <> 0").select("contenthash", F.when(F.col("doc_id") % 11 == 0, "old name").otherwise(F.col("source")).alias("filename"), F.when(F.col("doc_id") % 13 == 0, 1).otherwise(2).alias("version"))
    return had, f.filter("doc_id % 5 <> 0").select("contenthash", F.col("source").alias("filename"))


query("k12_index_sync", "", """WITH f AS (SELECT sha1(text) AS contenthash, min(doc_id) AS doc_id FROM documents GROUP BY 1)
SELECT contenthash, CASE WHEN doc_id % 5 = 0 THEN 'delete' WHEN doc_id % 7 = 0 THEN 'add' WHEN doc_id % 13 = 0 THEN 'rebuild' WHEN doc_id % 11 = 0 THEN 'update' ELSE 'keep' END AS action FROM f WHERE NOT (doc_id % 5 = 0 AND doc_id % 7 = 0)""")(
    lambda s, d: (lambda x: K.index_changes(x[0], x[1], 2))(_index(s, d))
)


def _vectored(s, d):
    """Chunks with a vector, some of them another model's; the others have none. A document's vector is that of each of its chunks."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    chunks = A.chunks(s, d).select("doc_id", "chunkindex", "courseid")
    none = F.lit(None).cast("array<double>")
    kept = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1.0))).otherwise(none)
    return chunks.withColumns({"embedding": kept, "embeddingmodel": F.when(F.col("doc_id") % 6 == 0, "m2").when(F.col("doc_id") % 3 == 0, "m1")}), v


query("f13_pending_embedding", "docchunks", "SELECT doc_id, chunkindex FROM docchunks WHERE doc_id % 6 <> 0")(lambda s, d: K.pending_embedding(_vectored(s, d)[0], "m2").select("doc_id", "chunkindex"))
query("k13_attach_embeddings", "docchunks", """SELECT doc_id, chunkindex, CASE WHEN doc_id % 6 = 0 THEN 'm2' WHEN vec_id IS NOT NULL THEN 'm2' WHEN doc_id % 3 = 0 THEN 'm1' END AS embeddingmodel,
CASE WHEN doc_id % 6 = 0 THEN 1.0 WHEN vec_id IS NOT NULL THEN round(CAST(embedding[1] AS DOUBLE), 6) WHEN doc_id % 3 = 0 THEN 1.0 END AS first FROM docchunks LEFT JOIN embeddings ON vec_id = doc_id""")(
    lambda s, d: (lambda x: K.attach_embeddings(x[0], x[1], "doc_id", "m2").select("doc_id", "chunkindex", "embeddingmodel", F.get("embedding", F.lit(0)).alias("first")))(_vectored(s, d))
)
query("k14_scope_cap", "docchunks", "SELECT courseid, doc_id, chunkindex FROM (SELECT *, row_number() OVER (PARTITION BY courseid ORDER BY doc_id, chunkindex) AS n FROM docchunks) WHERE n <= 2000")(lambda s, d: R.scope_chunks(A.chunks(s, d)).select("courseid", "doc_id", "chunkindex"))


def sited(s, d):
    """Documents whose text names the address of the page of their number, in capitals and with more behind it; a course is a scope."""
    site = table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit(" SEE "), F.upper("url"), F.lit("/print.")).alias("more"))
    text = F.concat(F.coalesce("text", F.lit("")), F.coalesce("more", F.lit("")))
    return docs(s, d).join(site, "doc_id", "left").select((F.col("doc_id") % 5).alias("courseid"), text.alias("content"))


_SITED = "sited AS (SELECT doc_id % 5 AS courseid, coalesce(text, '') || coalesce(' SEE ' || upper(url) || '/print.', '') AS content FROM documents LEFT JOIN pages ON page_id = doc_id)"


def addresses(s, d):
    """Addresses as they are, without what follows # or ?, with a letter more, and in another course."""
    p = table(s, d, "pages").filter("url IS NOT NULL")
    ways = F.array(F.struct("url", F.lit(0).alias("shift")), F.struct(F.regexp_replace("url", "[?#].*", "").alias("url"), F.lit(0).alias("shift")), F.struct(F.concat("url", F.lit("x")).alias("url"), F.lit(0).alias("shift")), F.struct("url", F.lit(1).alias("shift")))
    return p.select("page_id", F.explode(ways).alias("w")).select("page_id", "w.url", ((F.col("page_id") + F.col("w.shift")) % 5).alias("courseid")).distinct()


query("j11_url_in_content", "", f"""WITH {_SITED}, u AS (SELECT page_id, url, page_id % 5 AS courseid FROM pages UNION SELECT page_id, regexp_replace(url, '[?#].*', ''), page_id % 5 FROM pages
UNION SELECT page_id, url || 'x', page_id % 5 FROM pages UNION SELECT page_id, url, (page_id + 1) % 5 FROM pages)
SELECT *, EXISTS (SELECT 1 FROM sited t WHERE t.courseid = u.courseid AND contains(lower(t.content), lower(u.url))) AS contained FROM u WHERE url IS NOT NULL""")(lambda s, d: C.contained_urls(addresses(s, d), sited(s, d), "courseid"))


def linked_turns(s, d):
    """Turns with three links behind them: to the page of their conversation's number, to the own site and to no address."""
    p = table(s, d, "pages").select(F.col("page_id").alias("conversationid"), "url")
    more = F.concat(F.lit(" [its page]("), F.coalesce("url", F.lit("https://nowhere.example.org/a(b")), F.lit(") and [home](https://CAMPUS.example.org/x), [help](support_url)."))
    t = A.turns(s, d).join(p, "conversationid", "left")
    return t.select("conversationid", "turn", ((F.col("conversationid") + F.col("turn") % 2) % 5).alias("courseid"), F.concat("content", more).alias("content"))


query("f14_clean_links", "turns", f"""WITH {_SITED}, t AS (SELECT conversationid, turn, (conversationid + turn % 2) % 5 AS courseid, content || ' ' AS content, coalesce(url, 'https://nowhere.example.org/a(b') AS url FROM turns LEFT JOIN pages ON page_id = conversationid),
k AS (SELECT DISTINCT t.courseid, t.url, EXISTS (SELECT 1 FROM sited x WHERE x.courseid = t.courseid AND contains(lower(x.content), lower(t.url))) AS known FROM (SELECT DISTINCT courseid, url FROM t) t)
SELECT conversationid, turn, courseid, content || CASE WHEN known THEN '[its page](' || url || ')' ELSE 'its page' END || ' and [home](https://CAMPUS.example.org/x), help.' AS content FROM t JOIN k USING (courseid, url)""")(
    lambda s, d: K.clean_links(linked_turns(s, d), "content", sited(s, d), "campus.example.org")
)


def listing(s, d, left_out: int, old: bool):
    """A listing of files: of each text of a course one, the last by name. The old one has other names and other rights."""
    name = F.concat(F.when((F.col("doc_id") % 3 == 0) & F.lit(old), "old/").otherwise(F.lit("")), "source", F.lit("/"), F.col("doc_id").cast("string"))
    rows = docs(s, d).filter((F.col("text") != "") & (F.col("doc_id") % left_out != 0))
    rows = rows.select((F.col("doc_id") % 5).alias("courseid"), F.sha1(F.col("text").cast("binary")).alias("contenthash"), F.struct(name.alias("filename"), (F.col("lang") != "de").alias("citable"), "text").alias("x"))
    return rows.groupBy("courseid", "contenthash").agg(F.max("x").alias("x")).select("courseid", "contenthash", "x.*")


def cut_files(files):
    return K.window_chunks(files, "text", A.CHUNK, A.STEP)


def _vectors(store, every=2):
    """A vector for every second chunk, or all."""
    return store.read().filter(F.col("chunkindex") % every == 0).select("courseid", "contenthash", "chunkindex", F.array(F.col("chunkindex") + 0.5).alias("vector"))


def _applied(s, d):
    """An index of yesterday's files with vectors, brought up to today's."""
    store = I.ChunkStore.create(s, shared(s), 16)
    store.apply(listing(s, d, 7, True), cut_files, 1, whole=True)
    store.sweep(_vectors(store), "m", 1)
    store.apply(listing(s, d, 11, False), cut_files, 1, whole=True)
    return store.read().select("courseid", "contenthash", "filename", "citable", "chunkindex", F.md5(F.col("content").cast("binary")).alias("content"), F.col("embedding").isNotNull().alias("embedded"))


query("k12_index_applied", "", """WITH f AS (SELECT doc_id, doc_id % 5 AS courseid, sha1(text) AS contenthash, source || '/' || doc_id AS filename, lang <> 'de' AS citable, text FROM documents WHERE text <> ''),
old AS (SELECT DISTINCT courseid, contenthash FROM f WHERE doc_id % 7 <> 0), new AS (SELECT * FROM f WHERE doc_id % 11 <> 0 QUALIFY row_number() OVER (PARTITION BY courseid, contenthash ORDER BY filename DESC) = 1)
SELECT courseid, contenthash, filename, citable, CAST(i AS BIGINT) AS chunkindex, md5(substring(text, CAST(i * 1000 + 1 AS BIGINT), 1200)) AS content, i % 2 = 0 AND (courseid, contenthash) IN (SELECT (courseid, contenthash) FROM old) AS embedded
FROM new, unnest(range(CAST(greatest(1, ceil((length(text) - 200) / 1000.0)) AS BIGINT))) u(i)""")(_applied)


def _swept(s, d):
    """Three runs of a sweep of at most 50 courses over an index of 120."""
    store = I.ChunkStore.create(s, shared(s), 16)
    texts = docs(s, d).filter("text <> ''").select("text", F.sha1(F.col("text").cast("binary")).alias("contenthash")).distinct()
    files = texts.withColumns({"courseid": F.conv(F.left("contenthash", F.lit(6)), 16, 10).cast("long") % 120, "filename": F.lit("f"), "citable": F.lit(True)})
    store.apply(files, cut_files, 1, whole=True)
    for run in (1, 2, 3):
        store.sweep(_vectors(store, 1), "m", run)
    return store.read().groupBy("courseid").agg(F.min("sweep").alias("first"), F.max("sweep").alias("last"), F.count("*").alias("chunks"))


query("g8_embedding_sweep", "", """WITH f AS (SELECT DISTINCT CAST('0x' || left(sha1(text), 6) AS BIGINT) % 120 AS courseid, text FROM documents WHERE text <> ''),
n AS (SELECT courseid, sum(CAST(greatest(1, ceil((length(text) - 200) / 1000.0)) AS BIGINT)) AS chunks FROM f GROUP BY 1), r AS (SELECT *, (row_number() OVER (ORDER BY courseid) - 1) // 50 + 1 AS run FROM n)
SELECT courseid, run AS first, run AS last, CAST(chunks AS BIGINT) AS chunks FROM r""")(_swept)
query("j11_url_containment", "", r"""SELECT page_id, count(DISTINCT u) AS urls FROM (SELECT page_id, unnest(regexp_extract_all(html, 'https?://[^\s)"''<>]+')) AS u FROM pages) GROUP BY 1""")(
    lambda s, d: A.pages(s, d).select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"https?://[^\s)\"'<>]+"), F.lit(0))).alias("u")).groupBy("page_id").agg(F.countDistinct("u").alias("urls"))
)
_URL = r"https?://[^\s)\"'<>]+"
query("j11_url_in_chunks", "docchunks", r"""WITH k AS (SELECT DISTINCT lower(unnest(regexp_extract_all(content, 'https?://[^\s)"''<>]+'))) AS k FROM docchunks),
u AS (SELECT DISTINCT page_id, unnest(list_append(regexp_extract_all(html, 'https?://[^\s)"''<>]+'), url)) AS url FROM pages)
SELECT page_id, url, lower(url) IN (SELECT k FROM k) AS contained FROM u WHERE url IS NOT NULL""")(
    lambda s, d: K.url_containment(A.pages(s, d).select("page_id", F.explode(F.array_union(F.array("url"), F.coalesce(F.regexp_extract_all("html", F.lit(_URL), F.lit(0)), F.array().cast("array<string>")))).alias("url")).filter("url IS NOT NULL").distinct(), K.content_urls(A.chunks(s, d)))
)
query("w12_last_area", "", """SELECT contenthash, area, filename FROM (SELECT sha1(text) AS contenthash, doc_id % 3 AS area, source || '/' || doc_id AS filename,
row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id % 3 DESC, source || '/' || doc_id DESC) AS n FROM documents WHERE text IS NOT NULL) WHERE n = 1""")(
    lambda s, d: K.last_area(docs(s, d).filter("text IS NOT NULL").select(F.sha1(F.col("text").cast("binary")).alias("contenthash"), (F.col("doc_id") % 3).alias("area"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("filename")))
)
query("x9_cosine", "", "SELECT a.vec_id AS queryid, b.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label % 2 = b.label % 2 WHERE b.vec_id <> a.vec_id")(
    lambda s, d: (lambda e: R.semantic_scores(e, e, "scope").filter("vec_id <> queryid").withColumn("cosine", F.round("cosine", 6)))(table(s, d, "embeddings").withColumn("scope", F.col("label") % 2))
)


def _tops(s, d):
    e = table(s, d, "embeddings").select((F.col("label") % 2).alias("scope"), "vec_id", F.col("embedding").alias("vector"))
    asked = e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "queryid")
    return R.semantic_top(asked, e, 11, "scope").filter("vec_id <> queryid").withColumn("place", F.row_number().over(W.partitionBy("queryid").orderBy(F.desc("cosine"), "vec_id"))).filter("place <= 10")


query("x9_cosine_top", "", """SELECT a.vec_id AS queryid, b.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 7) AS cosine,
CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 7) DESC, b.vec_id) AS INTEGER) AS place
FROM embeddings a JOIN embeddings b ON a.label % 2 = b.label % 2 WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id QUALIFY place <= 10""")(_tops)
_FOLD = f"translate(lower({{}}), '{ACCENTED}', '{PLAIN}')"
_DASHES = "[\\s\\-\\x{2010}-\\x{2015}_/]+"
_SCORED = f"""WITH t AS (SELECT queryid, courseid, unnest(list_distinct(list_concat(list_filter(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3),
list_transform(regexp_extract_all(lower(query), '\\p{{L}}+(?:\\s*[\\-\\x{{2010}}-\\x{{2015}}]\\s*\\p{{L}}+)+'), lambda x: regexp_replace(x, '{_DASHES}', '-', 'g'))))) AS term FROM questions),
f AS (SELECT *, {_FOLD.format('term')} AS ft FROM t),
c AS (SELECT *, {_FOLD.format('content')} AS h, {_FOLD.format('filename')} AS fn, ' ' || regexp_replace({_FOLD.format('content')}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' ' AS w, regexp_replace({_FOLD.format('content')}, '{_DASHES}', '-', 'g') AS j FROM docchunks),
x AS (SELECT queryid, doc_id, chunkindex, term, contains(fn, ft) AS named, CASE WHEN contains(ft, '-') THEN (length(j) - length(replace(j, ft, ''))) // length(ft) WHEN length(ft) >= 5 THEN (length(h) - length(replace(h, ft, ''))) // length(ft) ELSE (length(w) - length(replace(w, ' ' || ft || ' ', ''))) // (length(ft) + 2) END AS n FROM c JOIN f USING (courseid)),
s AS (SELECT queryid, doc_id, chunkindex, sum(CASE WHEN n > 0 THEN (1 + ln(CAST(n AS DOUBLE))) * length(term) ELSE CAST(0 AS DOUBLE) END + CASE WHEN named THEN 2 ELSE 0 END) AS score FROM x GROUP BY ALL)"""
query("k5_lexical_score", "questions docchunks", f"{_SCORED} SELECT queryid, doc_id, chunkindex, round(score, 5) AS lexical FROM s WHERE score > 0")(
    lambda s, d: R.lexical_scores(A.questions(s, d), A.chunks(s, d)).filter("lexical > 0").select("queryid", "doc_id", "chunkindex", F.round("lexical", 5).alias("lexical"))
)
query("k7_select_top_k", "questions docchunks", f"{_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY queryid ORDER BY round(score, 9) DESC, doc_id, chunkindex) AS place FROM s WHERE score > 0) SELECT queryid, place, doc_id, chunkindex, round(score, 5) AS score FROM r WHERE place <= 6")(
    lambda s, d: R.select_top_k(R.top_scores(A.questions(s, d), A.chunks(s, d), 6), 6).select("queryid", F.col("place").cast("bigint").alias("place"), "doc_id", "chunkindex", F.round("score", 5).alias("score"))
)



def titled(s, d):
    """Every fourth document's chunks stand behind a line with their section: the first words of the chunk."""
    crumb = F.array_join(F.slice(F.filter(F.split(F.left("content", F.lit(80)), " "), lambda w: w != ""), 1, 3), " ")
    line = F.concat(F.lit("[Section: "), F.regexp_replace(crumb, r"[\]\[\n\r|]", ""), F.lit("]\n"))
    return A.chunks(s, d).withColumn("content", F.when(F.col("doc_id") % 4 == 0, F.concat(line, "content")).otherwise(F.col("content")))


_TITLED = _SCORED.replace("FROM docchunks)", "FROM titled)")
query("k7_sections", "questions docchunks", f"""WITH crumbs AS (SELECT *, regexp_replace(array_to_string(list_filter(string_split(left(content, 80), ' '), lambda w: w <> '')[1:3], ' '), '[\\]\\[\\n\\r|]', '', 'g') AS crumb FROM docchunks),
titled AS (SELECT * REPLACE (CASE WHEN doc_id % 4 = 0 THEN '[Section: ' || crumb || ']' || chr(10) || content ELSE content END AS content, CASE WHEN doc_id % 4 = 0 THEN crumb ELSE '' END AS crumb) FROM crumbs),
{_TITLED[5:]}, g AS (SELECT doc_id, chunkindex, courseid, {_FOLD.format('crumb')} AS h FROM titled WHERE crumb <> ''),
w2 AS (SELECT *, ' ' || regexp_replace(h, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' ' AS w, regexp_replace(h, '{_DASHES}', '-', 'g') AS j FROM g),
e AS (SELECT queryid, doc_id, chunkindex, count(*) AS heads FROM w2 JOIN f USING (courseid) WHERE CASE WHEN contains(ft, '-') THEN contains(j, ft) WHEN length(ft) >= 5 THEN contains(h, ft) ELSE contains(w, ' ' || ft || ' ') END GROUP BY ALL),
z AS (SELECT queryid, doc_id, chunkindex, coalesce(heads, 0) AS heads, round(s.score + 15 * coalesce(heads, 0), 9) AS score FROM s LEFT JOIN e USING (queryid, doc_id, chunkindex) WHERE s.score > 0 OR heads > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY queryid ORDER BY score DESC, doc_id, chunkindex) AS best, heads > 0 AND row_number() OVER (PARTITION BY queryid ORDER BY heads DESC, score DESC, doc_id, chunkindex) <= 3 AS reserved FROM z),
k AS (SELECT *, row_number() OVER (PARTITION BY queryid ORDER BY reserved DESC, score DESC, doc_id, chunkindex) AS n FROM r WHERE best <= 6 OR reserved)
SELECT queryid, row_number() OVER (PARTITION BY queryid ORDER BY heads > 0 DESC, heads DESC, score DESC, doc_id, chunkindex) AS place, doc_id, chunkindex, heads > 0 AS heading, round(score, 5) AS score FROM k WHERE n <= 6""")(
    lambda s, d: R.select_top_k(R.top_scores(A.questions(s, d), titled(s, d), 6), 6).select("queryid", F.col("place").cast("bigint").alias("place"), "doc_id", "chunkindex", "heading", F.round("score", 5).alias("score"))
)


def _hybrid(s, d):
    """Chunks whose document has a vector get it; a question's vector is the one of its number."""
    e = table(s, d, "embeddings")
    vectors = e.select(F.col("vec_id").alias("queryid"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return R.hybrid_scores(R.lexical_scores(A.questions(s, d), A.chunks(s, d), vectors=vectors))


query("k6_hybrid_score", "questions docchunks", f"""{_SCORED}, m AS (SELECT queryid, max(score) AS top FROM s GROUP BY 1)
SELECT s.queryid, s.doc_id, s.chunkindex, round(coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), CAST(0 AS DOUBLE)) + CAST(0.25 AS DOUBLE) * CASE WHEN top > 0 THEN score / top ELSE 0 END, 5) AS score
FROM s JOIN m USING (queryid) LEFT JOIN embeddings a ON a.vec_id = s.doc_id LEFT JOIN embeddings b ON b.vec_id = s.queryid WHERE s.score > 0 OR (a.vec_id IS NOT NULL AND b.vec_id IS NOT NULL)""")(lambda s, d: _hybrid(s, d).select("queryid", "doc_id", "chunkindex", F.round("score", 5).alias("score")))
query("k8_term_coverage", "questions docchunks", f"""{_SCORED}, r AS (SELECT queryid, doc_id, chunkindex FROM (SELECT *, row_number() OVER (PARTITION BY queryid ORDER BY round(score, 9) DESC, doc_id, chunkindex) AS place FROM s WHERE score > 0) WHERE place <= 6),
g AS (SELECT f.queryid, term, bool_or(coalesce(contains(CASE WHEN contains(term, '-') THEN j ELSE h END, ft), false)) AS found FROM f LEFT JOIN r USING (queryid) LEFT JOIN c USING (doc_id, chunkindex) WHERE length(term) >= 4 GROUP BY ALL)
SELECT q.queryid, round(coalesce(avg(CAST(found AS DOUBLE)), 1.0), 6) AS coverage FROM questions q LEFT JOIN g USING (queryid) GROUP BY 1""")(
    lambda s, d: R.term_coverage(A.questions(s, d), R.lexical_top(A.questions(s, d), A.chunks(s, d), 6)).withColumn("coverage", F.round("coverage", 6))
)
_TOP = "SELECT *, row_number() OVER (PARTITION BY queryid ORDER BY round(score, 9) DESC, doc_id, chunkindex) AS place FROM s WHERE score > 0"
query("k9_weak_retrieval", "questions docchunks", f"""{_SCORED}, r AS (SELECT * FROM ({_TOP}) WHERE place <= 6), m AS (SELECT queryid, max(score) AS top FROM r GROUP BY 1),
g AS (SELECT f.queryid, term, bool_or(coalesce(contains(CASE WHEN contains(term, '-') THEN j ELSE h END, ft), false)) AS found FROM f LEFT JOIN r USING (queryid) LEFT JOIN c USING (doc_id, chunkindex) WHERE length(term) >= 4 GROUP BY ALL),
v AS (SELECT queryid, bool_or(found) AS held FROM g GROUP BY 1) SELECT q.queryid, top IS NULL OR top < 8 OR NOT coalesce(held, true) AS weak FROM questions q LEFT JOIN m USING (queryid) LEFT JOIN v USING (queryid)""")(
    lambda s, d: R.weak_retrieval(A.questions(s, d), R.lexical_top(A.questions(s, d), A.chunks(s, d), 6))
)
query("w17_k10_multi_pass")(lambda s, d: R.multi_pass(A.questions(s, d), A.chunks(s, d), 6).select("queryid", "place", "pass", "doc_id", "chunkindex"))


def _asked_in_conversations(s, d):
    """The questions of conversations, short ones with an earlier turn in front; a conversation's scope is its number."""
    asked = H.retrieval_query(A.turns(s, d)).filter("query <> ''")
    return asked.select((F.col("conversationid") * 1000 + F.col("turn")).alias("queryid"), "query", (F.col("conversationid") % 5).alias("courseid"))


query("k10_conversation_passes")(lambda s, d: R.multi_pass(_asked_in_conversations(s, d), A.chunks(s, d), 6).select("queryid", "place", "pass", "doc_id", "chunkindex"))
query("k11_retrieval_report", "questions docchunks", f"""{_SCORED}, r AS (SELECT * FROM ({_TOP}) WHERE place <= 10)
SELECT queryid, place AS position, doc_id, chunkindex, '' AS section, round(score, 4) AS score, false AS heading, place <= 6 AS selected, left(trim(regexp_replace(content, '\\s+', ' ', 'g')), 160) AS snippet FROM r JOIN docchunks USING (doc_id, chunkindex)""")(
    lambda s, d: R.retrieval_report(R.top_scores(A.questions(s, d), A.chunks(s, d), 10), A.chunks(s, d), 6, 10).withColumn("position", F.col("position").cast("bigint"))
)
query("t9_hybrid_top_k", "questions docchunks", f"""{_SCORED}, m AS (SELECT queryid, max(score) AS top FROM s GROUP BY 1),
y AS (SELECT s.queryid, s.doc_id, s.chunkindex, CASE WHEN b.vec_id IS NULL THEN score ELSE coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), CAST(0 AS DOUBLE)) + CASE WHEN top > 0 THEN CAST(0.25 AS DOUBLE) * score / top ELSE 0 END END AS score
FROM s JOIN m USING (queryid) LEFT JOIN embeddings a ON a.vec_id = s.doc_id LEFT JOIN embeddings b ON b.vec_id = s.queryid)
SELECT queryid, row_number() OVER (PARTITION BY queryid ORDER BY round(score, 7) DESC, doc_id, chunkindex) AS place, doc_id, chunkindex FROM y WHERE round(score, 7) > 0 QUALIFY place <= 6""")(
    lambda s, d: R.select_top_k(_hybrid(s, d).withColumn("score", F.round("score", 7)), 6).select("queryid", F.col("place").cast("bigint").alias("place"), "doc_id", "chunkindex")
)
