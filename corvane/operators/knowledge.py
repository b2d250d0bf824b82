"""Knowledge base: documents to clean, tagged chunks, kept in step with their sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import is_effectively_empty, normalize_text
from corvane.operators.containment import contained_urls

MOST_CHARS = 2_000_000
# Heading words by level, caption words, page labels.
HEADING = r"(?iU)^(unidad|cap[ií]tulo|tema|m[oó]dulo|secci[oó]n|parte|anexo|ap[eé]ndice|paso|lecci[oó]n|bloque|unit|chapter|section|module|part|appendix|step|lesson|topic|unidade|se[cç][aã]o|passo)\b"
LEVEL_1 = r"(?iU)^(unidad|unit|m[oó]dulo|module|tema|parte|part|bloque|unidade)\b"
LEVEL_2 = r"(?iU)^(paso|step|cap[ií]tulo|chapter|lecci[oó]n|lesson|passo)\b"
NUMBERED = r"^\d{1,2}(\.\d{1,2}){0,3}[.)]?\s+\p{Lu}"
ROMAN = r"(?i)^[ivxlcdm]{1,6}(\.\d{1,2}[.)]?\s+\p{L}|[.)]\s+(?-i:\p{Lu}))"
CAPTION = r"(?i)^(?:cuadro|figura|tabla|gr[aá]fico|gr[aá]fica|ilustraci[oó]n|imagen|esquema|box|figure|table|chart|exhibit|diagram|quadro|imagem)\s*(?:n[.\x{00BA}\x{00B0}]?\s*)?\d{1,3}\s*[:.\-\x{2013}\x{2014}]\s*\S"
PAGE_LABEL = r"(?i)^(?:p[aá]gina|page|p[aá]g\.?)\s*\d+\b\s*"
DOTS = r"\.{4,}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ingest_documents(files: DataFrame) -> DataFrame:
    """One row per content hash (of several, the smallest file name): clean text, its status and length."""
    one = files.withColumn("nth", F.row_number().over(W.partitionBy("contenthash").orderBy("filename"))).filter("nth = 1").drop("nth")
    clean = one.withColumn("extractedtext", F.left(normalize_text("text"), F.lit(MOST_CHARS)))
    status = F.when(F.col("text").isNull(), "FAILED").when(is_effectively_empty("extractedtext"), "EMPTY").otherwise("READY")
    return clean.select("contenthash", "filename", status.alias("status"), F.coalesce(F.char_length("extractedtext"), F.lit(0)).alias("charcount"), "extractedtext")


def window_chunks(docs: DataFrame, text_col: str, size: int, step: int) -> DataFrame:
    """Chunks of ``size`` characters, one every ``step``; no text gives no chunk."""
    n = F.greatest(F.lit(1), F.ceil((F.char_length(text_col) - (size - step)) / F.lit(float(step)))).cast("bigint")
    rows = docs.filter(F.col(text_col) != "").withColumn("chunkindex", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return rows.withColumn("content", F.substring(text_col, (F.col("chunkindex") * step + 1).cast("int"), F.lit(size))).drop(text_col)


def page_lines(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """doc, page, at, line: the trimmed lines of pages without contents entries and page labels."""
    lines = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.trim("line")).filter(~F.regexp_like("line", F.lit(DOTS)))
    return lines.withColumn("line", F.regexp_replace("line", PAGE_LABEL, ""))


def boilerplate(lines: DataFrame, least_chars: int = 25, share: float = 0.6, least_pages: int = 4) -> DataFrame:
    """doc and norm: long lines that stand on most pages of their document."""
    norm = F.lower(F.trim("line"))
    seen = lines.withColumn("norm", norm).filter(F.char_length("norm") >= least_chars)
    on = seen.groupBy("doc", "norm").agg(F.countDistinct("page").alias("on"))
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages")).filter(F.col("pages") >= least_pages)
    return on.join(pages, "doc").filter(F.col("on") >= F.ceil(F.col("pages") * F.lit(share).cast("double"))).select("doc", "norm")


def denoise(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """doc, page, text: pages without contents entries, page labels and boilerplate lines."""
    lines = page_lines(pages, doc, page, text)
    kept = lines.withColumn("norm", F.lower(F.trim("line"))).join(boilerplate(lines), ["doc", "norm"], "left_anti")
    whole = kept.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("x"))
    return whole.select("doc", "page", F.array_join(F.col("x.line"), "\n").alias("text"))


def is_heading(line) -> Column:
    x = _c(line)
    like = lambda p: F.regexp_like(x, F.lit(p))
    capitals = (F.char_length(x) <= 80) & like(r"\p{Lu}") & ~like(r"\p{Ll}")
    return F.char_length(x).between(3, 120) & ~like(r"[.,;]\s*$") & ~like(DOTS) & (like(HEADING) | like(NUMBERED) | like(ROMAN) | capitals)


def heading_level(line) -> Column:
    return F.when(F.regexp_like(_c(line), F.lit(LEVEL_1)), 1).when(F.regexp_like(_c(line), F.lit(LEVEL_2)), 2).otherwise(3)


def heading_paths(lines: DataFrame, doc: str = "doc", order: tuple[str, ...] = ("page", "at")) -> DataFrame:
    """Add path: the headings in force at each line, one of each level at most; a heading ends those of deeper levels."""
    w = W.partitionBy(doc).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    nth = F.row_number().over(W.partitionBy(doc).orderBy(*order))
    df = lines.withColumn("__n", nth).withColumn("__level", F.when(is_heading("line"), heading_level("line")))
    last = lambda k, c: F.last(F.when(F.col("__level") == k, F.col(c)), ignorenulls=True).over(w)
    for k in (1, 2, 3):
        df = df.withColumns({f"__h{k}": last(k, "line"), f"__p{k}": last(k, "__n")})
    zero = lambda k: F.coalesce(f"__p{k}", F.lit(0))
    live2 = F.when(zero(2) > zero(1), F.col("__h2"))
    live3 = F.when((zero(3) > zero(1)) & (zero(3) > zero(2)), F.col("__h3"))
    return df.withColumn("path", F.concat_ws(" › ", "__h1", live2, live3)).drop("__n", "__level", *(f"__{x}{k}" for x in "hp" for k in (1, 2, 3)))


def decorated(content, path, page) -> Column:
    """Content behind a line that names its section and page (0 or null: none): the breadcrumb of a chunk that doesn't begin with it."""
    crumb = F.when(~_c(content).startswith(_c(path)) & (_c(path) != ""), _c(path))
    bits = F.concat_ws(" | ", crumb, F.when(_c(page) > 0, F.concat(F.lit("p. "), _c(page).cast("string"))))
    return F.when(bits == "", _c(content)).otherwise(F.concat(F.lit("[Section: "), bits, F.lit("]\n"), _c(content)))


def paragraphs_of(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """doc, page, par, paragraph, path: the headings in force after the paragraph's own lines."""
    cut = F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\n{2,}")).alias("par", "paragraph")
    rows = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), cut).withColumn("paragraph", F.regexp_replace("paragraph", r"^\s+|\s+$", "")).filter("paragraph <> ''")
    lines = rows.select("doc", "page", "par", F.posexplode(F.split("paragraph", "\n")).alias("at", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    paths = heading_paths(lines, order=("page", "par", "at")).groupBy("doc", "page", "par").agg(F.max_by("path", "at").alias("path"))
    return rows.join(paths, ["doc", "page", "par"])


def figure_captions(pages: DataFrame, doc: str, page: str, text: str, with_pages: bool = True) -> DataFrame:
    """One locator chunk for each distinct numbered caption and page (doc, page, label, content): its section is where the caption stands,
    and the caption itself."""
    lines = paragraphs_of(pages, doc, page, text).select("doc", "page", "par", "path", F.posexplode(F.split("paragraph", "\n")).alias("at", "line")).withColumn("line", F.trim("line"))
    hit = F.char_length("line").between(8, 200) & ~F.regexp_like("line", F.lit(DOTS)) & F.regexp_like("line", F.lit(CAPTION))
    found = lines.filter(hit).withColumn("label", F.regexp_replace("line", r"[ .;]+$", ""))
    rows = found.groupBy("doc", "page", F.lower("label").alias("k")).agg(F.max_by(F.struct("label", "path"), F.struct("par", "at")).alias("x")).select("doc", "page", "x.*")
    body = F.concat(F.lit('[FIGURE REFERENCE] "'), "label", F.lit('": a figure or table stands here; what it shows may be an image that the text does not repeat.'))
    path = F.concat_ws(" › ", F.nullif("path", F.lit("")), "label")
    return rows.select("doc", "page", "label", decorated(body, path, F.col("page") if with_pages else F.lit(0)).alias("content"))


def _cut(paragraphs: list[tuple[str, str, int]], size: int, overlap: int) -> list[tuple[str, str, int]]:
    """(content, path, page) of chunks: paragraphs gathered up to ``size`` characters. A chunk has the section and page where it began; a
    full one passes on the last ``overlap`` characters of what it would have been."""
    out: list[tuple[str, str, int]] = []
    held, at = "", ("", 0)

    def close(text: str) -> None:
        if text.strip():
            out.append((text.strip(), *at))

    for text, path, page in paragraphs:
        here = (path, page)
        if not held:
            at = here
        while len(text) > size:
            close(held)
            held, at = "", here
            close(text[:size])
            text = text[size - overlap :]
        whole = f"{held}\n\n{text}" if held else text
        if len(whole) <= size:
            held = whole
        else:
            close(held)
            held, at = f"{whole.strip()[-overlap:]}\n\n{text}".strip(), here
    close(held)
    return out


_CUT = T.ArrayType(T.StructType().add("content", "string").add("path", "string").add("page", "long"))


def paragraph_chunks(pages: DataFrame, doc: str = "doc_id", text: str = "text", page: str | None = None, size: int = 2500, overlap: int = 250) -> DataFrame:
    """doc, chunkindex, content: chunks along paragraphs with section and, of texts in pages, page in front. Headings are found in
    DataFrame functions; only the gathering of one document's paragraphs is Python, in Arrow batches."""
    rows = paragraphs_of(pages.withColumn("__page", F.col(page) if page else F.lit(0)), doc, "__page", text)
    whole = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "par", "paragraph", "path"))).alias("x"))

    def cut(docs: pd.Series) -> pd.Series:
        return docs.map(lambda x: [{"content": c, "path": p, "page": n} for c, p, n in _cut([(r["paragraph"], r["path"], r["page"]) for r in x], size, overlap)])

    chunks = F.pandas_udf(cut, _CUT)
    df = whole.select("doc", F.posexplode(chunks("x")).alias("chunkindex", "c"))
    return df.select(F.col("doc").alias(doc), "chunkindex", decorated("c.content", "c.path", F.col("c.page")).alias("content"))


def index_changes(index: DataFrame, files: DataFrame, version: int) -> DataFrame:
    """contenthash and action: add what is new or was cut by another version, update metadata, delete what is gone."""
    had = index.groupBy("contenthash").agg(F.min(F.struct("filename", "version")).alias("x")).select("contenthash", F.col("x.filename").alias("old_name"), "x.version")
    both = had.join(files.select("contenthash", "filename"), "contenthash", "full")
    action = (
        F.when(F.col("filename").isNull(), "delete")
        .when(F.col("version").isNull(), "add")
        .when(F.col("version") != version, "rebuild")
        .when(F.col("old_name") != F.col("filename"), "update")
        .otherwise("keep")
    )
    return both.select("contenthash", action.alias("action"))


def pending_embedding(chunks: DataFrame, model: str) -> DataFrame:
    return chunks.filter(F.col("embedding").isNull() | ~F.col("embeddingmodel").eqNullSafe(F.lit(model)))


def attach_embeddings(chunks: DataFrame, vectors: DataFrame, key: str, model: str) -> DataFrame:
    """Fill missing or other-model vectors from a table of vectors, rounded to six decimals; others stay."""
    stale = F.col("embedding").isNull() | ~F.col("embeddingmodel").eqNullSafe(F.lit(model))
    joined = chunks.join(vectors.select(key, F.col("vector").alias("__new")), key, "left")
    use = stale & F.col("__new").isNotNull()
    fresh = F.transform("__new", lambda x: F.round(x.cast("double"), 6))
    return joined.withColumns({"embedding": F.when(use, fresh).otherwise(F.col("embedding")), "embeddingmodel": F.when(use, F.lit(model)).otherwise(F.col("embeddingmodel"))}).drop("__new")


# Fixed value: a Markdown link.
LINK = r"\[([^\]]*)\]\(([^)\s]*)\)"


def clean_links(texts: DataFrame, text_col: str, chunks: DataFrame, own_host: str, scope: str = "courseid") -> DataFrame:
    """Markdown links stay if they go to the own host, or to a url that stands anywhere in the content of the text's own scope, in any case;
    others become their text. ``chunks``: scope and content."""
    links = lambda group: F.regexp_extract_all(text_col, F.lit(LINK), F.lit(group))
    key = [F.xxhash64(F.lit(i), text_col).alias(f"__k{i}") for i in (1, 2)]
    found = texts.select(scope, *key, F.explode(links(2)).alias("url")).distinct()
    asked = contained_urls(found.select(scope, "url").distinct(), chunks, scope)
    own = F.lower(F.regexp_extract("url", r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)) == own_host.lower()
    ok = found.join(asked.filter(own | F.col("contained")), [scope, "url"]).groupBy(scope, "__k1", "__k2").agg(F.collect_set("url").alias("__ok"))
    df = texts.withColumns({f"__k{i}": F.xxhash64(F.lit(i), text_col) for i in (1, 2)}).join(ok, [scope, "__k1", "__k2"], "left")
    df = df.withColumns({"__between": F.split(text_col, LINK, -1), "__all": links(0), "__labels": links(1), "__urls": links(2), "__ok": F.coalesce("__ok", F.array().cast("array<string>"))})
    kept = lambda i: F.when(F.array_contains("__ok", F.get("__urls", i)), F.get("__all", i)).otherwise(F.get("__labels", i))
    whole = F.transform(F.sequence(F.lit(0), F.size("__between") - 1), lambda i: F.concat(F.get("__between", i), F.coalesce(kept(i), F.lit(""))))
    text = F.when(F.col(text_col).isNotNull(), F.array_join(whole, ""))
    return df.withColumn(text_col, text).select(*texts.columns)


def content_urls(chunks: DataFrame) -> DataFrame:
    """The distinct urls that occur in content: the equi-join side of containment."""
    return chunks.select(F.explode(F.regexp_extract_all("content", F.lit(r"https?://[^\s)\"'<>]+"), F.lit(0))).alias("url")).distinct()


def url_containment(urls: DataFrame, known_urls: DataFrame) -> DataFrame:
    """Add contained: whether the indexed content has the url (column ``url`` of both), ignoring case."""
    known = known_urls.select(F.lower("url").alias("__k")).distinct().withColumn("contained", F.lit(True))
    return urls.withColumn("__k", F.lower("url")).join(known, "__k", "left").drop("__k").withColumn("contained", F.coalesce("contained", F.lit(False)))


def last_area(files: DataFrame) -> DataFrame:
    """The files by content hash: of a hash in several areas the one of the last area, there the last by name."""
    nth = F.row_number().over(W.partitionBy("contenthash").orderBy(F.desc("area"), F.desc("filename")))
    return files.withColumn("__n", nth).filter("__n = 1").drop("__n")
