"""Text functions: each takes and gives columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-case Latin letters with diacritics, and the letters they fold to.
ACCENTED = "áàäâãåāéèëêēíìïîīóòöôõøōúùüûūñçýÿšž"
PLAIN = "aaaaaaaeeeeeiiiiiooooooouuuuuncyysz"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold_accents(text) -> Column:
    return F.translate(_c(text), ACCENTED, PLAIN)


def normalize_separators(text) -> Column:
    """Runs of space, dash, underscore and slash become one hyphen."""
    return F.regexp_replace(_c(text), r"[\s\-\x{2010}-\x{2015}_/]+", "-")


def compound_terms(lowered) -> Column:
    """Distinct dash-joined names of a lower-cased text, with single hyphens."""
    found = F.regexp_extract_all(_c(lowered), F.lit(r"\p{L}+(?:\s*[\-\x{2010}-\x{2015}]\s*\p{L}+)+"), F.lit(0))
    return F.array_distinct(F.transform(found, normalize_separators))


def simple_terms(text) -> Column:
    """Distinct lower-cased words of at least three letters or digits."""
    return F.array_distinct(F.filter(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+"), lambda w: F.char_length(w) >= 3))


def tokenize(text) -> Column:
    return F.array_union(simple_terms(text), compound_terms(F.lower(_c(text))))


def name_terms(text) -> Column:
    """At most four names: compounds, then runs of two to eight capitals and digits with a capital among them."""
    caps = F.regexp_extract_all(_c(text), F.lit(r"(?<![\p{L}\p{N}])[\p{Lu}\p{N}]{2,8}(?![\p{L}\p{N}])"), F.lit(0))
    caps = F.transform(F.filter(caps, lambda x: F.regexp_like(x, F.lit(r"\p{Lu}"))), F.lower)
    return F.slice(F.array_union(compound_terms(F.lower(_c(text))), caps), 1, 4)


def focus_query(text) -> Column:
    """The names of a question, else its words of six letters and more if there are two, else nothing; never the question itself."""
    names, long = name_terms(text), F.filter(tokenize(text), lambda w: F.char_length(w) >= 6)
    focus = F.when(F.size(names) > 0, F.array_join(names, " ")).when(F.size(long) >= 2, F.array_join(long, " ")).otherwise("")
    return F.when(focus == F.lower(F.trim(_c(text))), "").otherwise(focus)


def spaced_words(folded) -> Column:
    """A folded text with two spaces between words and one at each end, in which `` word `` finds whole words."""
    return F.concat(F.lit(" "), F.regexp_replace(_c(folded), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))


def term_hits(haystack, term, spaced=None) -> Column:
    """Occurrences of a term in folded text: as a substring if long or compound, else as a whole word. ``spaced``: the
    haystack's spaced_words, where they are at hand."""
    h, t = _c(haystack), fold_accents(term)
    words = spaced_words(h) if spaced is None else _c(spaced)
    count = lambda text, part: ((F.char_length(text) - F.char_length(F.replace(text, part, F.lit("")))) / F.char_length(part)).cast("bigint")
    whole = F.concat(F.lit(" "), t, F.lit(" "))
    return F.when(F.char_length(t) == 0, F.lit(0)).when((F.char_length(t) >= 5) | t.contains("-"), count(h, t)).otherwise(count(words, whole))


def breadcrumb(content) -> Column:
    """The text between ``[Section: `` at the start and the first ``]`` that ends a line."""
    return F.regexp_extract(_c(content), r"(?s)^\[Section: (.*?)\]\n", 1)


def strip_breadcrumb(content) -> Column:
    return F.regexp_replace(_c(content), r"(?s)^\[Section: .*?\]\n", "")


def decode_numeric(text) -> Column:
    """Numeric character references, decimal and hexadecimal, become their characters; those of no character stay."""
    found = F.array_distinct(F.regexp_extract_all(_c(text), F.lit(r"&#(\d{1,7}|[xX][0-9A-Fa-f]{1,6});"), F.lit(1)))

    def put(t: Column, ref: Column) -> Column:
        hexed = F.lower(F.left(ref, F.lit(1))) == "x"
        code = F.when(hexed, F.conv(F.substring(ref, 2, 6), 16, 10)).otherwise(F.when(~hexed, ref)).cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
        known = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        return F.when(known, F.replace(t, F.concat(F.lit("&#"), ref, F.lit(";")), F.when(known, char))).otherwise(t)

    return F.aggregate(found, _c(text), put)


def html_to_plain(html, most: int = 2000) -> Column:
    """Visible text: block tags become spaces, other tags go, entities are decoded, white space collapses, the end is cut."""
    x = F.regexp_replace(_c(html), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?i)</?(p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|section|article|header|footer|blockquote|pre)\b[^>]*>", " ")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    x = F.replace(decode_numeric(x), F.lit("&amp;"), F.lit("&"))
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.char_length(x) > most, F.concat(F.left(x, F.lit(most - 1)), F.lit("…"))).otherwise(x)


def normalize_text(text) -> Column:
    """Unix line ends, plain spaces, no zero-width or control characters, single blanks, at most one empty line."""
    x = F.regexp_replace(_c(text), r"\r\n?", "\n")
    x = F.regexp_replace(x, r"\x{00A0}", " ")
    x = F.regexp_replace(x, r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]|[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r" ?\n ?", "\n")
    return F.btrim(F.regexp_replace(x, r"\n{3,}", "\n\n"), F.lit(" \n"))


def is_effectively_empty(text, least: int = 10) -> Column:
    return F.char_length(F.regexp_replace(normalize_text(text), r"[^\p{L}\p{N}]", "")) < least


def normalize_summary(text) -> Column:
    """Lower case, plain letters, words separated by single spaces."""
    return F.trim(F.regexp_replace(fold_accents(F.lower(_c(text))), r"[^a-z0-9]+", " "))


def summary_hash(text) -> Column:
    n = normalize_summary(text)
    return F.when(n == "", "").otherwise(F.sha1(n.cast("binary")))


def fingerprint(text, words: int = 12) -> Column:
    """The first words of the normalised text; nothing for fewer than four."""
    w = F.filter(F.split(normalize_summary(text), " "), lambda x: x != "")
    return F.when(F.size(w) < 4, "").otherwise(F.array_join(F.slice(w, 1, words), " "))


def clean_summary(text, most: int = 1500) -> Column:
    return F.left(html_to_plain(text, 1 << 30), F.lit(most))


def clean_category(category, known: list[str], other: str = "otro") -> Column:
    c = F.lower(F.trim(_c(category)))
    return F.when(c.isin(known), c).otherwise(other)


def redact_secrets(text) -> Column:
    """Keys that begin like provider keys keep their prefix only."""
    return F.regexp_replace(_c(text), r"\b(sk-|AIza)[A-Za-z0-9_\-]{8,}", "$1[REDACTED]")


def strip_internal_state(text) -> Column:
    x = F.regexp_replace(_c(text), r"(?m)^\s*state\.[A-Za-z_]+\s*=.*$", "")
    x = F.regexp_replace(x, r"(?is)\n\s*(summary|resumen|conversation_summary)\s*:.*$", "")
    return F.trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def hmac_sha256_hex(message, key: bytes) -> Column:
    """HMAC-SHA256 as lower-case hexadecimal, from built-in functions."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in block).hex()))
    inner = F.sha2(F.concat(pad(0x36), _c(message).cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def pseudonymise(address, secret: bytes) -> Column:
    return F.left(hmac_sha256_hex(address, secret), F.lit(32))


def normalize_for_search(text) -> Column:
    """Lower-cased and folded; dots stay between digits, other punctuation becomes a space."""
    x = fold_accents(F.lower(_c(text)))
    x = F.regexp_replace(x, r"(?<=[0-9])\.(?=[0-9])", "\u0001")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}\x01]+", " ")
    return F.trim(F.replace(x, F.lit("\u0001"), F.lit(".")))


def search_terms(text) -> Column:
    """Terms of three characters, or two with a digit; the whole query if there are none."""
    n = normalize_for_search(text)
    terms = F.filter(F.array_distinct(F.split(n, " ")), lambda w: (F.char_length(w) >= 3) | ((F.char_length(w) >= 2) & F.regexp_like(w, F.lit("[0-9]"))))
    return F.when((F.size(terms) == 0) & (n != ""), F.array(n)).otherwise(terms)


def word_count(text) -> Column:
    return F.size(F.filter(F.split(F.trim(_c(text)), r"\s+"), lambda w: w != ""))


def cosine(a, b) -> Column:
    """Cosine of two arrays; 0 when lengths differ or one is zero."""
    a, b = _c(a), _c(b)
    zero, plus = F.lit(0.0), lambda s, x: s + x
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, plus)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), zero, plus))
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot / size).otherwise(0.0)
