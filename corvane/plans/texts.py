"""Queries over text functions and classifiers, on every stored turn, question and page."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import classify as C
from corvane.functions import text as X
from corvane.operators import history as H
from corvane.plans.registry import query
from corvane.session import table
from corvane.sources import adapters as A

ACCENTS = f"translate(lower({{}}), '{X.ACCENTED}', '{X.PLAIN}')"
SUMMARY = f"trim(regexp_replace({ACCENTS.format('content')}, '[^a-z0-9]+', ' ', 'g'))"


def turns(s, d, **cols):
    return A.said(s, d).select("conversationid", "turn", *(c.alias(n) for n, c in cols.items()))


query("s7_html_to_plain", "", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(x, '(?i)</?(p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|section|article|header|footer|blockquote|pre)\b[^>]*>', ' ', 'g') AS x FROM a),
c AS (SELECT page_id, regexp_replace(x, '<[^>]*>', '', 'g') AS x FROM b),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS x FROM c),
f AS (SELECT page_id, trim(regexp_replace(x, '\s+', ' ', 'g')) AS x FROM e)
SELECT page_id, md5(CASE WHEN length(x) > 2000 THEN left(x, 1999) || '…' ELSE x END) AS plain FROM f""")(lambda s, d: A.pages(s, d).select("page_id", F.md5(X.html_to_plain("html").cast("binary")).alias("plain")))
query("s8_s9_normalize_text", "", r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160), ' ', 'g') AS x FROM documents),
b AS (SELECT doc_id, regexp_replace(x, '[\x{200B}-\x{200D}\x{2060}\x{FEFF}]|[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') AS x FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') AS x FROM b),
e AS (SELECT doc_id, trim(regexp_replace(x, '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS x FROM c)
SELECT doc_id, md5(x) AS clean, length(regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')) < 10 AS empty FROM e""")(lambda s, d: table(s, d, "documents").select("doc_id", F.md5(X.normalize_text("text").cast("binary")).alias("clean"), X.is_effectively_empty("text").alias("empty")))
query("f7_guardrail_check", "said", "SELECT conversationid, turn, CASE WHEN trim(content) = '' THEN 'emptymessage' WHEN length(trim(content)) > 800 THEN 'messagetoolong' ELSE '' END AS errorcode FROM said")(lambda s, d: turns(s, d, errorcode=C.guardrail_check("content", 800)[0]))
query("x1_fold_accents", "said", f"SELECT conversationid, turn, {ACCENTS.format('content')} AS folded FROM said")(lambda s, d: turns(s, d, folded=X.fold_accents(F.lower("content"))))
query("x2_normalize_separators", "said", r"SELECT conversationid, turn, regexp_replace(content, '[\s\-\x{2010}-\x{2015}_/]+', '-', 'g') AS joined FROM said")(lambda s, d: turns(s, d, joined=X.normalize_separators("content")))
query("x3_tokenize", "questions", r"SELECT queryid, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(query), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 3))), ' ') AS terms FROM questions")(
    lambda s, d: A.questions(s, d).select("queryid", F.array_join(F.array_sort(X.tokenize("query")), " ").alias("terms"))
)
query("x4_compound_terms", "said", r"SELECT conversationid, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(lower(content), '\p{L}+(?:\s*[\-\x{2010}-\x{2015}]\s*\p{L}+)+'), lambda x: regexp_replace(x, '[\s\-\x{2010}-\x{2015}_/]+', '-', 'g')))), ' ') AS terms FROM said")(
    lambda s, d: turns(s, d, terms=F.array_join(F.array_sort(X.compound_terms(F.lower("content"))), " "))
)
# compounds, then runs of capitals and digits between spaces doubled so that each has its own; the first four
_NAMES = """list_transform(regexp_extract_all(lower({0}), '\\p{{L}}+(?:\\s*[\\-\\x{{2010}}-\\x{{2015}}]\\s*\\p{{L}}+)+'), lambda x: regexp_replace(x, '[\\s\\-\\x{{2010}}-\\x{{2015}}_/]+', '-', 'g'))"""
_CAPS = """list_transform(list_filter(regexp_extract_all(' ' || regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' ', ' ([\\p{{Lu}}\\p{{N}}]{{2,8}}) ', 1), lambda x: regexp_matches(x, '\\p{{Lu}}')), lambda x: lower(x))"""
_ONCE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def _names_sql(view: str, text: str) -> str:
    return f"n0 AS (SELECT *, list_concat({_NAMES.format(text)}, {_CAPS.format(text)}) AS l FROM {view}), n AS (SELECT *, {_ONCE.format('l')}[1:4] AS names FROM n0)"


query("x5_name_terms", "said", f"WITH {_names_sql('said', 'content')} SELECT conversationid, turn, array_to_string(names, ' ') AS names FROM n")(lambda s, d: turns(s, d, names=F.array_join(X.name_terms("content"), " ")))
query("x6_focus_query", "questions", f"""WITH {_names_sql('questions', 'query')}, w0 AS (SELECT *, list_concat(list_filter(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3), {_NAMES.format('query')}) AS t0 FROM n),
w AS (SELECT *, list_filter({_ONCE.format('t0')}, lambda w: length(w) >= 6) AS long FROM w0), f AS (SELECT queryid, query, CASE WHEN len(names) > 0 THEN array_to_string(names, ' ') WHEN len(long) >= 2 THEN array_to_string(long, ' ') ELSE '' END AS focus FROM w)
SELECT queryid, CASE WHEN focus = lower(trim(query)) THEN '' ELSE focus END AS focus FROM f""")(lambda s, d: A.questions(s, d).select("queryid", X.focus_query("query").alias("focus")))
query("x7_term_hits", "said", f"""WITH t AS (SELECT conversationid, turn, {ACCENTS.format('content')} AS h FROM said), u AS (SELECT *, ' ' || regexp_replace(h, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' ' AS w FROM t)
SELECT conversationid, turn, CAST((length(w) - length(replace(w, ' the ', ''))) / 5 AS BIGINT) AS short_hits, CAST((length(h) - length(replace(h, 'ation', ''))) / 5 AS BIGINT) AS long_hits FROM u""")(
    lambda s, d: turns(s, d, short_hits=X.term_hits(X.fold_accents(F.lower("content")), F.lit("the")), long_hits=X.term_hits(X.fold_accents(F.lower("content")), F.lit("ation")))
)
query("x8_breadcrumb", "said", "SELECT conversationid, turn, 'Unit ' || turn AS crumb, md5(content) AS body FROM said")(
    lambda s, d: (lambda c: turns(s, d, crumb=X.breadcrumb(c), body=F.md5(X.strip_breadcrumb(c).cast("binary"))))(F.concat(F.lit("[Section: Unit "), F.col("turn").cast("string"), F.lit("]\n"), F.col("content")))
)
query("x10_summary_hash", "said", f"SELECT conversationid, turn, CASE WHEN {SUMMARY} = '' THEN '' ELSE sha1({SUMMARY}) END AS summaryhash FROM said")(lambda s, d: turns(s, d, summaryhash=X.summary_hash("content")))
query("x11_clean_summary", "said", r"SELECT conversationid, turn, left(trim(regexp_replace(content, '\s+', ' ', 'g')), 150) AS summary, CASE WHEN role IN ('user', 'system') THEN role ELSE 'otro' END AS category FROM said")(
    lambda s, d: turns(s, d, summary=X.clean_summary("content", 150), category=X.clean_category("role", ["user", "system"]))
)
query("x13_fingerprint", "said", f"WITH w AS (SELECT conversationid, turn, list_filter(string_split({SUMMARY}, ' '), lambda x: x <> '') AS w FROM said) SELECT conversationid, turn, CASE WHEN len(w) < 4 THEN '' ELSE array_to_string(w[1:12], ' ') END AS fp FROM w")(lambda s, d: turns(s, d, fp=X.fingerprint("content")))
query("x14_used_fallback", "said", f"""WITH f AS (SELECT array_to_string(list_filter(string_split({SUMMARY}, ' '), lambda x: x <> '')[1:12], ' ') AS fp FROM said WHERE role = 'assistant' AND conversationid % 20 = 0)
SELECT conversationid, turn, EXISTS (SELECT 1 FROM f WHERE length(fp) > 0 AND contains({SUMMARY}, fp)) AS fallback FROM said WHERE role = 'assistant'""")(lambda s, d: _used_fallback(s, d))


def _used_fallback(s, d):
    """Replies that hold one of the configured fallback texts: here some of the stored replies."""
    t = A.said(s, d).filter("role = 'assistant'").withColumn("words", X.normalize_summary("content"))
    config = t.filter("conversationid % 20 = 0").select(F.array_join(F.slice(F.split("words", " "), 1, 12), " ").alias("fp")).filter("fp <> ''")
    return H.used_fallback(t, config, "words")




def re2(pattern: str) -> str:
    """A pattern in the SQL's dialect, which has no look-around and whose word edges and classes know ASCII alone."""
    if pattern.startswith("\\b"):
        pattern = "(?:^|[^\\w])" + pattern.removeprefix("\\b").removesuffix("\\b") + "(?:[^\\w]|$)"
    return pattern.replace("[^\\w]", "[^\\p{L}\\p{N}_]").replace("\\s", "[\\s\\p{Z}]").replace("'", "''")


def _sql_like(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{re2(pattern)}')"


def _sql_near(text: str, a: str, b: str, gap: int) -> str:
    return f"({_sql_like(text, f'(?:{a}).{{0,{gap}}}(?:{b})')} OR {_sql_like(text, f'(?:{b}).{{0,{gap}}}(?:{a})')})"


_LOW = "a AS (SELECT conversationid, turn, lower(trim(content)) AS t FROM said)"
query("x15_human_request_kind", "said", f"""WITH {_LOW} SELECT conversationid, turn, CASE WHEN {_sql_like('t', C.DELEGATE)} OR {_sql_like('t', C.TICKET)} THEN 'request'
WHEN {_sql_near('t', C.REACH, C.WHO, 40)} THEN CASE WHEN {_sql_like('t', C.HOWTO)} AND (NOT {_sql_like('t', C.WANTS)} OR {_sql_like('t', C.KNOWING)}) THEN 'howto' ELSE 'request' END
WHEN {_sql_like('t', C.SET_PHRASES)} THEN 'request' ELSE '' END AS result FROM a""")(lambda s, d: turns(s, d, result=C.human_request_kind("content")))
query("x17_recommends_support", "said", f"WITH {_LOW} SELECT conversationid, turn, {_sql_near('t', C.SEND_REACH, C.SEND_WHO, 60)} OR {_sql_near('t', C.FORM_VERBS, C.FORM, 60)} AS result FROM a")(lambda s, d: turns(s, d, result=C.recommends_support("content")))
# what a concept's question must not go on with is taken out first
_OWN = [("qu[eé] es ", "mi |mis "), ("qu[eé] son ", "mi |mis "), ("what is ", "my "), ("what are ", "my "), ("o que [eé] ", "minha |minhas |meu |meus ")]
_ASKED, _CONCEPT = "lower(content)", C.CONCEPTUAL
for _head, _tail in _OWN:
    _ASKED, _CONCEPT = f"regexp_replace({_ASKED}, '{_head}({_tail})', '# ', 'g')", _CONCEPT.replace(f"{_head}(?!{_tail})", _head)
query("x22_looks_like_platform_query", "said", f"SELECT conversationid, turn, NOT {_sql_like(_ASKED, _CONCEPT)} AND ({_sql_like('lower(content)', C.PERSONAL)} OR {_sql_like('lower(content)', C.INHERENT)}) AS result FROM said")(
    lambda s, d: turns(s, d, result=C.looks_like_platform_query("content"))
)
_OPTION = "regexp_matches(lower(content), '(^|[\\s(\\[]){}[).]\\s')"
query("x21_looks_like_quiz", "said", f"""SELECT conversationid, turn, regexp_matches(lower(content), '{C.TRUE_FALSE}') OR ({_OPTION.format('a')} AND {_OPTION.format('b')} AND regexp_matches(lower(content), '{C.ANSWER_CUE}')) AS result FROM said""")(lambda s, d: turns(s, d, result=C.looks_like_quiz("content")))
_STATE = r"""trim(regexp_replace(regexp_replace(regexp_replace({0}, '(?m)^\s*state\.[A-Za-z_]+\s*=.*$', '', 'g'), '(?is)\n\s*(summary|resumen|conversation_summary)\s*:.*$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'))"""
query("x29_strip_internal_state", "said", f"SELECT conversationid, turn, {_STATE.format('content')} AS result FROM said")(lambda s, d: turns(s, d, result=X.strip_internal_state("content")))
query("x29_stated_turns", "said", "SELECT conversationid, turn, " + _STATE.format("'before' || chr(10) || 'state.step = 3' || chr(10) || content || chr(10) || ' Summary: x'") + " AS result FROM said")(
    lambda s, d: turns(s, d, result=X.strip_internal_state(F.concat(F.lit("before\nstate.step = 3\n"), F.col("content"), F.lit("\n Summary: x"))))
)
query("x16_states_a_problem", "said", f"""SELECT conversationid, turn, len(list_filter(regexp_split_to_array(trim(content), '\\s+'), lambda x: x <> '')) > 10
OR regexp_matches(lower(content), '(^|[^\\p{{L}}\\p{{N}}_]){C.PROBLEM[2:-2].replace("'", "''")}($|[^\\p{{L}}\\p{{N}}_])') AS problem FROM said""")(lambda s, d: turns(s, d, problem=C.states_a_problem("content")))
query("x18_accepts_an_offer", "said", f"""WITH a AS (SELECT conversationid, turn, lower(trim(content)) AS t, lower(trim(coalesce(lag(content) OVER (PARTITION BY conversationid ORDER BY turn), ''))) AS r FROM said)
SELECT conversationid, turn, r <> '' AND {_sql_like('r', C.OFFERED)} AND t <> '' AND len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) <= 12
AND NOT ({_sql_like('t', C.REFUSAL)} AND NOT {_sql_like('t', C.STILL_A_PROBLEM)}) AND ({_sql_like('t', C.ASSENT)} OR {_sql_like('t', C.URGENCY)}) AS accepts FROM a""")(lambda s, d: A.said(s, d).withColumn("reply", F.expr("lag(content) OVER (PARTITION BY conversationid ORDER BY turn)")).select("conversationid", "turn", C.accepts_an_offer("content", "reply").alias("accepts")))
query("x23_carries_a_request", "said", "SELECT conversationid, turn, trim(content) <> '' AND (contains(content, '?') OR contains(content, '¿') OR len(list_filter(regexp_split_to_array(trim(content), '\\s+'), lambda x: x <> '')) >= 5) AS asks FROM said")(lambda s, d: turns(s, d, asks=C.carries_a_request("content")))
query("x23_is_courtesy")(lambda s, d: turns(s, d, courtesy=C.is_courtesy("content")))
query("x24_interpret_intent", "", """WITH e AS (SELECT event_id, event_type, value, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN k % 5 = 4 OR event_type = 'error' THEN 'ambiguous' WHEN k % 3 = 0 AND k % 5 >= 3 THEN 'ambiguous' WHEN k / 100.0 < 0.65 OR (k % 2 = 1 AND k / 100.0 < 0.8) THEN 'ambiguous' ELSE CASE WHEN k % 2 = 0 THEN 'tutor' ELSE 'assistant' END END AS intent FROM e""")(lambda s, d: _intents(s, d))


def _intents(s, d):
    """Router output made from the events: name, confidence, clarification flag, some of it broken."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    name = F.when((k % 3 == 0) & (k % 5 >= 3), "Ambigua").when(k % 2 == 0, "tutor").otherwise(" Asistente")
    body = F.to_json(F.struct(name.alias("intent"), (k / 100.0).alias("confidence"), (k % 2 == 1).alias("needs_clarification")))
    raw = F.when((k % 5 == 4) | (F.col("event_type") == "error"), F.lit("not json")).otherwise(body)
    return table(s, d, "events").select("event_id", C.interpret_intent(raw).alias("intent"))


def _count(words: str) -> str:
    listed = ", ".join(f"'{w}'" for w in words.split())
    return f"len(list_filter(words, lambda w: w IN ({listed})))"


_LANG = ", ".join(f"{_count(w)} + CASE WHEN regexp_matches(t, '{C.LETTER_BONUS[n][0]}') THEN {C.LETTER_BONUS[n][1]} ELSE 0 END AS {n}" if n in C.LETTER_BONUS else f"{_count(w)} AS {n}" for n, w in C.STOP_WORDS.items())
query("x25_detect_language", "said", f"""WITH a AS (SELECT conversationid, turn, lower(trim(content)) AS t, regexp_split_to_array(lower(trim(content)), '[^\\p{{L}}]+') AS words FROM said), b AS (SELECT *, {_LANG} FROM a),
c AS (SELECT *, list_reverse_sort([Spanish, English, Portuguese, French]) AS o FROM b)
SELECT conversationid, turn, CASE WHEN length(t) < 8 OR len(words) < 3 OR o[1] < 2 OR o[1] - o[2] < 2 THEN '' WHEN Spanish = o[1] THEN 'Spanish' WHEN English = o[1] THEN 'English' WHEN Portuguese = o[1] THEN 'Portuguese' ELSE 'French' END AS language FROM c""")(
    lambda s, d: turns(s, d, language=C.detect_language("content"))
)
_MARKS = ", ".join("(" + " + ".join(f"(length(t) - length(replace(t, '{m}', ''))) // {len(m)}" for m in ms) + f") AS m_{n}" for n, ms in C.REPLY_MARKERS.items())
query("x26_reply_language", "said", f"""WITH a AS (SELECT conversationid, turn, ' ' || lower(regexp_replace(content, '<[^>]*>', '', 'g')) || ' ' AS t FROM said), b AS (SELECT *, {_MARKS} FROM a), c AS (SELECT *, list_reverse_sort([m_es, m_pt, m_en]) AS o FROM b)
SELECT conversationid, turn, CASE WHEN o[1] < 2 OR o[1] < 2 * o[2] THEN '' WHEN m_es = o[1] THEN 'es' WHEN m_pt = o[1] THEN 'pt' ELSE 'en' END AS language FROM c""")(lambda s, d: turns(s, d, language=C.reply_language("content")))
_BEFORE, _AFTER = "(^|[^\\p{L}\\p{N}_])", "($|[^\\p{L}\\p{N}_])"
_TERMS = f"list_distinct(list_concat(list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3), {_NAMES.format('t')}))"
query("x27_is_vague", "said", f"""WITH a AS (SELECT conversationid, turn, trim(content) AS t, len(list_filter(regexp_split_to_array(trim(content), '\\s+'), lambda x: x <> '')) AS words FROM said)
SELECT conversationid, turn, t <> '' AND (words <= 4 OR len({_TERMS}) <= 1 OR (words <= 9 AND regexp_matches(lower(t), '{_BEFORE}{C.DEICTIC[2:-2]}{_AFTER}'))) AS vague FROM a""")(lambda s, d: turns(s, d, vague=C.is_vague("content")))
query("x28_redact_secrets", "", r"SELECT doc_id, md5(regexp_replace('key sk-abc12345-' || text, '\b(sk-|AIza)[A-Za-z0-9_\-]{8,}', '\1[REDACTED]', 'g')) AS redacted FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.md5(X.redact_secrets(F.concat(F.lit("key sk-abc12345-"), F.col("text"))).cast("binary")).alias("redacted"))
)
_PADS = {x: "".join(f"\\x{b ^ x:02X}" for b in b"rotate me".ljust(64, b"\0")) for x in (0x36, 0x5C)}
query("x30_pseudonymise", "", f"SELECT c_custkey, left(sha256('{_PADS[0x5C]}'::BLOB || unhex(sha256('{_PADS[0x36]}'::BLOB || encode(c_name)))), 32) AS alias FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", X.pseudonymise("c_name", b"rotate me").alias("alias")))
query("x31_search_terms", "questions", r"""WITH a AS (SELECT queryid, trim(regexp_replace(translate(lower(query), 'áàäâãåāéèëêēíìïîīóòöôõøōúùüûūñçýÿšž', 'aaaaaaaeeeeeiiiiiooooooouuuuuncyysz'), '[^\p{L}\p{N}]+', ' ', 'g')) AS n FROM questions)
SELECT queryid, array_to_string(list_sort(list_distinct(list_filter(string_split(n, ' '), lambda w: length(w) >= 3 OR (length(w) >= 2 AND regexp_matches(w, '[0-9]'))))), ' ') AS terms FROM a""")(
    lambda s, d: A.questions(s, d).select("queryid", F.array_join(F.array_sort(X.search_terms("query")), " ").alias("terms"))
)
