"""Ranking chunks for whole batches of questions."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.functions.text import ACCENTED, PLAIN, breadcrumb, focus_query, fold_accents, normalize_separators, strip_breadcrumb, tokenize
from corvane.session import checkpointed, counted_batches, ship_code

WEIGHT = 0.25


def scope_chunks(chunks: DataFrame, scope: str = "courseid", most: int = 2000, order: tuple[str, ...] = ("doc_id", "chunkindex")) -> DataFrame:
    """The first ``most`` chunks of each scope."""
    nth = F.row_number().over(W.partitionBy(scope).orderBy(*order))
    return chunks.withColumn("__n", nth).filter(F.col("__n") <= most).drop("__n")


#: Letters that a long term shares with a word it stands in: its first ones are the key of that match.
GRAM, SHORT_GRAM = 5, 3


def grams(text, size: int):
    """Distinct runs of ``size`` characters; none of a shorter text."""
    t = F.col(text)
    return F.when(F.char_length(t) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(t) - size + 1), lambda i: F.substring(t, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def occurrences(text, part):
    """How often a part stands in a text, counted without overlaps."""
    return ((F.char_length(text) - F.char_length(F.replace(text, part, F.lit("")))) / F.char_length(part)).cast("bigint")


def words_with(terms: DataFrame, words: DataFrame) -> DataFrame:
    """term, word, times for distinct folded terms (without hyphens) and distinct words: a term of five characters or more in any
    word that contains it, a shorter one in itself. Terms meet words by their first GRAM characters, never all with all."""
    short = terms.filter(F.char_length("term") < GRAM).join(words, F.col("term") == F.col("word")).select("term", "word", F.lit(1).cast("bigint").alias("times"))
    keyed = words.select("word", F.explode(grams("word", GRAM)).alias("gram"))
    long = terms.filter(F.char_length("term") >= GRAM).withColumn("gram", F.left("term", F.lit(GRAM))).join(keyed, "gram").filter(F.contains("word", "term"))
    return short.unionByName(long.select("term", "word", occurrences(F.col("word"), F.col("term")).alias("times")))


#: Rows up to which a side is broadcast, and terms up to which every word meets them.
FEW, FEW_TERMS = 500_000, 20_000


def few(kept: DataFrame) -> DataFrame:
    """A kept table, which joins broadcast if it has few rows."""
    return F.broadcast(kept) if kept.count() <= FEW else kept


def compound_hits(terms: DataFrame, texts: DataFrame, by: list[str]) -> DataFrame:
    """(by), field, tid, n for terms (scope, term, tid) with hyphens. Candidates are the texts with a word that holds the term's longest part (all texts
    of the scope, if no part has SHORT_GRAM letters); there the term is counted in the text with hyphens for separators."""
    scope = by[0]
    longest = F.array_max(F.transform(F.split("term", "-"), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
    parts = terms.withColumn("part", longest)
    words = worded(texts).select("word").distinct()
    held = parts.select("part").distinct().filter(F.char_length("part") >= SHORT_GRAM).withColumn("gram", F.left("part", F.lit(SHORT_GRAM)))
    held = held.join(words.select("word", F.explode(grams("word", SHORT_GRAM)).alias("gram")), "gram").filter(F.contains("word", "part")).select("part", "word")
    named = few(checkpointed(parts.join(held, "part").select(scope, "word", "tid").distinct()))
    at = worded(texts).join(named, [scope, "word"]).select(*by, "field", "tid").distinct()
    tiny = parts.filter(F.char_length("part") < SHORT_GRAM).select(scope, "tid").join(texts.select(*by, "field"), scope).select(*by, "field", "tid")
    joined = texts.select(*by, "field", normalize_separators("h").alias("joined"))
    n = occurrences(F.col("joined"), F.col("term"))
    return few(checkpointed(at.unionByName(tiny))).join(joined, [*by, "field"]).join(terms.select("tid", "term"), "tid").select(*by, "field", "tid", n.alias("n")).filter("n > 0")


def asked_terms(questions: DataFrame, scope: str = "courseid") -> DataFrame:
    """queryid, scope, term (folded), said (the question's spelling of it)."""
    asked = questions.select("queryid", scope, F.explode(tokenize("query")).alias("said")).withColumn("term", fold_accents("said"))
    return asked.filter("term <> ''")


def worded(texts: DataFrame) -> DataFrame:
    """A row for each word of each text."""
    rest = [c for c in texts.columns if c != "h"]
    return texts.select(*rest, F.explode(F.split("h", r"[^\p{L}\p{N}]+")).alias("word")).filter("word <> ''")


def term_hits_in(terms: DataFrame, chunks: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunkindex"), scope: str = "courseid") -> DataFrame:
    """scope, chunk keys, field, tid, n: where the distinct terms (scope, term, tid) occur in content (field 0), heading (1) and file name (2: once).
    A term's hits in a field are the sum of its rows there.

    Up to FEW_TERMS terms are broadcast and meet the words of chunks by their first GRAM characters, so only hits leave a task. Of more
    terms the distinct ones are matched with the distinct words first, and the words of chunks meet what was matched."""
    by = [scope, *keys]
    # field 0: the content, 1: the heading of chunks that have one
    head = breadcrumb("content")
    fields = F.filter(F.array(F.struct(F.lit(0).alias("field"), F.col("content").alias("t")), F.struct(F.lit(1).alias("field"), head.alias("t"))), lambda x: x["t"] != "")
    texts = chunks.select(*by, F.explode(fields).alias("x")).select(*by, "x.field", fold_accents(F.lower("x.t")).alias("h"))
    plain = terms.filter(~F.contains("term", F.lit("-")))
    if terms.count() <= FEW_TERMS:
        key = F.when(F.char_length("word") >= GRAM, grams("word", GRAM)).otherwise(F.array("word"))
        asked = F.broadcast(plain.withColumn("key", F.left("term", F.lit(GRAM))))
        hits = worded(texts).withColumn("key", F.explode(key)).join(asked, [scope, "key"]).filter(F.contains("word", "term"))
        hits = hits.select(*by, "field", "tid", F.when(F.char_length("term") < GRAM, 1).otherwise(occurrences(F.col("word"), F.col("term"))).cast("bigint").alias("n"))
    else:
        found = words_with(plain.select("term").distinct(), worded(texts).select("word").distinct())
        matched = few(checkpointed(plain.join(found, "term").select(scope, "word", "tid", "times")))
        hits = worded(texts).join(matched, [scope, "word"]).select(*by, "field", "tid", F.col("times").alias("n"))
    compound = terms.filter(F.contains("term", F.lit("-")))
    if not compound.isEmpty():
        hits = hits.unionByName(compound_hits(compound, texts, by))
    # file names: each distinct one once
    names = chunks.select(scope, "filename").distinct().select(scope, "filename", fold_accents(F.lower("filename")).alias("f"))
    keyed = names.withColumn("gram", F.explode(grams("f", SHORT_GRAM)))
    in_name = terms.withColumn("gram", F.left("term", F.lit(SHORT_GRAM))).join(keyed, [scope, "gram"]).filter(F.contains("f", "term"))
    in_name = checkpointed(in_name.select(scope, "filename", "tid"))
    if in_name.isEmpty():
        return hits
    in_name = few(in_name)
    named = chunks.select(*by, "filename").join(in_name, [scope, "filename"]).select(*by, F.lit(2).alias("field"), "tid", F.lit(1).cast("bigint").alias("n"))
    return hits.unionByName(named)


#: Letters of words, what stands between the parts of a compound (as in normalize_separators), and bytes of which none but letters and digits stay in ASCII.
WORD, SEPARATORS = re.compile(r"[^\W_]+"), re.compile(r"[ \t\n\x0b\f\r\-\u2010-\u2015_/]+")
FOLDS, BLANKS = str.maketrans(ACCENTED, PLAIN), np.array([b if b > 127 or chr(b).isalnum() else 32 for b in range(256)], dtype=np.uint8)


class Prefixed:
    """Parts by the first bytes of their UTF-8, to find those that stand in runs of letters."""

    def __init__(self, parts: dict[int, str], size: int):
        self.size, self.by = size, {}
        for i, part in parts.items():
            if len(part) >= size:
                self.by.setdefault(part.encode()[:size], []).append((i, part.encode()))
        self.marks = np.zeros(1 << 20, dtype=bool)
        for gram in self.by:
            self.marks[self.places(np.frombuffer(gram, dtype=np.uint8))] = True

    def places(self, data: np.ndarray) -> np.ndarray:
        """A place among the marks for each run of ``size`` bytes."""
        n, gram = max(0, len(data) - self.size + 1), np.uint64(0)
        for k in range(self.size):
            gram = (gram << np.uint64(8)) | data[k : n + k].astype(np.uint64)
        return (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def within(self, runs: list[bytes]) -> dict[int, dict[int, int]]:
        """By run (its place) the parts in it, with how often they stand there."""
        found: dict[int, dict[int, int]] = {}
        if not self.by:
            return found
        whole = b"\n".join(runs)
        at = np.flatnonzero(self.marks[self.places(np.frombuffer(whole, dtype=np.uint8))])
        of = np.searchsorted(np.cumsum([0, *(len(x) + 1 for x in runs)]), at, side="right") - 1
        for i, place in zip(of.tolist(), at.tolist(), strict=True):
            for k, part in self.by.get(whole[place : place + self.size], ()):
                if whole.startswith(part, place):
                    found.setdefault(i, {})[k] = runs[i].count(part)
        return found


class KnownWords(dict):
    """A number for each run of bytes without ASCII blanks and marks that was seen (a word, or some with other marks between them); 0: no term stands in
    it. The terms of a number and how often they stand there lie between two ``ends``."""

    MOST = 500_000

    def __init__(self, terms: list[str]):
        compound = {i: max(t.split("-"), key=lambda w: (len(w), w)) for i, t in enumerate(terms) if "-" in t}
        plain = {i: t for i, t in enumerate(terms) if i not in compound}
        self.long, self.short = Prefixed({i: t for i, t in plain.items() if len(t) >= GRAM}, GRAM), {t.encode(): i for i, t in plain.items() if len(t) < GRAM}
        self.parts, self.anywhere = Prefixed(compound, SHORT_GRAM), {i for i, part in compound.items() if len(part) < SHORT_GRAM}
        self.terms, self.names, self.name_hits = terms, Prefixed(dict(enumerate(terms)), SHORT_GRAM), {}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ends, self.tids, self.times, self.compounds = [0, 0], [], [], {}

    def learn(self, runs: list[bytes]) -> None:
        """Number new runs. No term but a compound has a mark in it, so a long one stands in a run as often as in its words."""
        folded, mixed = list(runs), [i for i, x in enumerate(runs) if not x.isascii()]
        for i, x in zip(mixed, b"\n".join(runs[i] for i in mixed).decode("utf-8", "replace").translate(FOLDS).split("\n"), strict=False):
            folded[i] = x.encode()
        found, near = self.long.within(folded), self.parts.within(folded)
        for i, x in enumerate(folded):
            for word in (x,) if x.isascii() else (w.encode() for w in WORD.findall(x.decode())):
                if (k := self.short.get(word)) is not None:
                    of = found.setdefault(i, {})
                    of[k] = of.get(k, 0) + 1
        self.update(dict.fromkeys(runs, 0))
        for i in found.keys() | near.keys():
            self[runs[i]] = n = len(self.ends) - 1
            self.tids.extend(found.get(i, ()))
            self.times.extend(found.get(i, {}).values())
            self.ends.append(len(self.tids))
            if i in near:
                self.compounds[n] = set(near[i])

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text (its place), tid and n of lower-cased texts in UTF-8 (binary)."""
        if len(self) > self.MOST:
            self.forget()
        texts = texts.cast(pa.binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        blanked = BLANKS[np.frombuffer(data, dtype=np.uint8)] if data is not None else np.zeros(0, np.uint8)
        runs = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, pa.py_buffer(blanked)], offset=texts.offset))
        words = runs.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.binary()).to_pylist()
        self.learn([x for x in distinct if x not in self])
        numbers = np.fromiter(map(self.__getitem__, distinct), np.int64)
        code, text = numbers[words.indices.to_numpy()], np.repeat(np.arange(len(texts)), runs.value_lengths().to_numpy())
        code, text = code[code > 0], text[code > 0]
        ends, tids, times = (np.array(x, dtype=np.int64) for x in (self.ends, self.tids, self.times))
        size = ends[code + 1] - ends[code]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ends[code], size)
        more = []
        if self.compounds or self.anywhere:
            asked = {i: set(self.anywhere) for i in np.flatnonzero(pc.binary_length(texts).to_numpy()).tolist()} if self.anywhere else {}
            marked = np.zeros(len(ends), dtype=bool)
            marked[list(self.compounds)] = True
            for i, c in set(zip(text[marked[code]].tolist(), code[marked[code]].tolist(), strict=True)):
                asked.setdefault(i, set()).update(self.compounds[c])
            for i, some in asked.items():
                joined = SEPARATORS.sub("-", texts[i].as_py().decode("utf-8", "replace").translate(FOLDS))
                more += [(i, tid, n) for tid in some if (n := joined.count(self.terms[tid]))]
        extra = np.array(more, dtype=np.int64).reshape(-1, 3)
        return np.r_[np.repeat(text, size), extra[:, 0]], np.r_[tids[at], extra[:, 1]], np.r_[times[at], extra[:, 2]]

    def in_names(self, names: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of lower-cased file names, in which a term counts once."""
        if len(self.name_hits) > self.MOST:
            self.name_hits.clear()
        new = list(set(names) - self.name_hits.keys())
        of = self.names.within([(f or "").translate(FOLDS).encode() for f in new])
        self.name_hits.update((f, list(of.get(i, ()))) for i, f in enumerate(new))
        found = [(i, tid) for i, f in enumerate(names) for tid in self.name_hits[f]]
        both = np.array(found, dtype=np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1], np.ones(len(both), dtype=np.int64)


#: Terms of questions (a row for each question and term) up to which the questions go to the chunks, and chunks that are then scored at once.
FEW_ASKED, SCANNED = 20_000, 16_384


def scan_scores(said: pa.Table, terms: list[str], chunks: DataFrame, keys: list[str], scope: str, out: T.StructType, most: int | None) -> DataFrame:
    """lexical_scores of few questions: ``said`` is held by every task, and chunks are read once, where they lie. Only scores leave a task; of chunks that are
    scored at once they are cut to the best of each question."""
    ship_code(chunks.sparkSession)
    rest = ["vector", "vectored"] if "vectored" in chunks.columns else []
    given = chunks.select(scope, *keys, F.lower("content").cast("binary").alias("__t"), F.lower(breadcrumb("content")).cast("binary").alias("__s"), F.lower("filename").alias("__f"), *rest)

    def run(batches):
        known, held, size = KnownWords(terms), [], 0
        of = dict.fromkeys(said.column(scope).to_pylist())
        lists = {x: said.filter(pc.equal(said.column(scope), pa.scalar(x, said.schema.field(scope).type))) for x in of if x is not None}

        def scored():
            whole = pa.Table.from_batches([x for x, _ in held])
            first = np.cumsum([0, *(x.num_rows for x, _ in held[:-1])])
            row, field, tid, n = (np.concatenate(x) for x in zip(*((r + at, f, t, m) for at, (_, hits) in zip(first, held, strict=True) for f, (r, t, m) in ((np.full(len(h[0]), k), h) for k, h in enumerate(hits))), strict=True))
            for x, questions in lists.items():
                rows = whole.append_column("__at", pa.array(np.arange(whole.num_rows))).filter(pc.equal(whole.column(scope), pa.scalar(x, whole.schema.field(scope).type)))
                rows = rows.take(pc.sort_indices(rows, [(k, "ascending") for k in keys]))
                place = np.full(whole.num_rows, -1)
                place[rows.column("__at").to_numpy()] = np.arange(rows.num_rows)
                own = place[row] >= 0
                vectors = None
                if rest:
                    at = np.flatnonzero(rows.column("vectored").fill_null(False).to_numpy())
                    vectors = at, rows.column("vector").take(pa.array(at))
                step = ALL_PAIRS[0] if most is None else max(1, questions.num_rows)
                for lo in range(0, questions.num_rows if rows.num_rows else 0, step):
                    yield from pair_scores(questions.slice(lo, step).combine_chunks(), rows.select(keys), (place[row[own]], field[own], tid[own], n[own]), vectors, scope, out, most).to_batches()

        for batch in batches:
            found = known.hits(batch.column("__t")), known.hits(batch.column("__s")), known.in_names(batch.column("__f").to_pylist())
            held.append((batch.select([scope, *keys, *rest]), found))
            size += batch.num_rows
            if size >= SCANNED:
                yield from scored()
                held, size = [], 0
        if size:
            yield from scored()

    return given.mapInArrow(run, out)


#: Questions and chunks of a tile where all pairs come out, and where each question's best do; tiles of a group of many questions' hits.
ALL_PAIRS, BEST_PAIRS, GROUP = (256, 4096), (32768, 8192), 8


def lexical_scores(questions: DataFrame, chunks: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunkindex"), scope: str = "courseid", most: int | None = None, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """queryid, scope, chunk keys, lexical, headinghits of the pairs of one scope that have a hit: the sum over terms of (1 + ln hits) x length, and 2
    for each term in the file name. With ``most``, of each question at least its ``most`` best pairs by score (lexical + HEAD_SCORE for each heading hit,
    to DIGITS digits) and its ``most`` best with heading hits by these and score, ties by the chunk's keys.
    With ``vectors`` (queryid, vector; some of the chunk keys, vector) also cosine, and all pairs of one scope that both have one.

    Keys name one chunk. Up to FEW_ASKED terms of questions go to where the chunks lie (``scan_scores``). Of more, hits of chunks are dealt to tiles,
    which meet tiles of questions in Arrow batches: a question's hits are summed there, so they are never rows. Where only the best count, tiles form groups
    (``group_tops``), so that hits are shuffled once, and questions and their best once for a group of GROUP tiles."""
    asked = asked_terms(questions, scope)
    if asked.count() + (questions.count() if vectors is not None else 0) <= FEW_ASKED:
        return few_scores(questions, asked, chunks, keys, scope, most, vectors)
    terms = checkpointed(asked.select(scope, "term").distinct().withColumn("tid", F.monotonically_increasing_id()))
    hits = term_hits_in(terms, chunks, keys, scope)
    weights = F.collect_list(F.struct("tid", F.char_length("said").cast("double").alias("size")))
    said = checkpointed(asked.join(few(terms), [scope, "term"]).groupBy("queryid", scope).agg(weights.alias("terms")))
    if vectors is not None:
        scoped = questions.select("queryid", scope).join(said, ["queryid", scope], "left").join(vectors[0].select("queryid", "vector", F.lit(True).alias("vectored")), "queryid", "left")
        said = checkpointed(scoped.filter("terms IS NOT NULL OR vectored"))
        held = chunks.select(scope, *keys).join(vectors[1].withColumn("field", F.lit(VECTOR)), [k for k in keys if k in vectors[1].columns])
        hits = hits.unionByName(held.select(scope, *keys, "field", "vector"), allowMissingColumns=True)
    if most is not None and vectors is None:
        return group_tops(said, hits, chunks, keys, scope, most)
    queries, rows = ALL_PAIRS if most is None else BEST_PAIRS
    # a chunk's rows go to one tile
    sizes = checkpointed(chunks.groupBy(scope).agg(F.ceil(F.count("*") / rows).cast("int").alias("__own")).join(said.groupBy(scope).agg(F.ceil(F.count("*") / queries).cast("int").alias("__others")), scope))
    each = F.explode(F.sequence(F.lit(0), F.col("__others") - 1)).alias("qt")
    dealt = hits.join(F.broadcast(sizes), scope).select(*hits.columns, F.pmod(F.xxhash64(*keys), F.col("__own")).cast("int").alias("ct"), each)
    every = F.explode(F.sequence(F.lit(0), F.col("__own") - 1)).alias("ct")
    tiles = said.join(F.broadcast(sizes), scope).select(*said.columns, F.pmod(F.xxhash64("queryid"), F.col("__others")).cast("int").alias("qt"), every)
    out = T.StructType([said.schema["queryid"], said.schema[scope], *(hits.schema[k] for k in keys)]).add("lexical", "double").add("headinghits", "integer")
    if vectors is not None:
        out = out.add("cosine", "double")
    by = [scope, "qt", "ct"]
    return tiles.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(lambda left, right: tile_scores(left, right, list(keys), scope, out, most), out)


def group_tops(said: DataFrame, hits: DataFrame, chunks: DataFrame, keys: tuple[str, ...], scope: str, most: int) -> DataFrame:
    """The best pairs of many questions, kept as a table. A chunk's hits go to one group, once; the questions of its scope meet each group."""
    rows, spark = BEST_PAIRS[1], chunks.sparkSession
    counts = checkpointed(chunks.groupBy(scope).agg(F.count("*").alias("n")).join(said.select(scope).distinct(), scope))
    scopes, cores = counts.count(), spark.sparkContext.defaultParallelism
    busy = F.least(F.ceil(F.col("n") / rows), F.lit(math.ceil(4 * cores / max(1, scopes))))
    own = F.greatest(F.ceil(F.col("n") / (rows * GROUP)), busy)
    # scopes, a row each, are numbered in one task
    sizes = checkpointed(counts.coalesce(1).select(scope, F.monotonically_increasing_id().alias("__s"), own.alias("__own")))
    total, widest = sizes.agg(F.sum("__own"), F.max("__own")).first()
    group = lambda of: F.col("__s") * F.lit(widest or 1) + of
    dealt = hits.join(F.broadcast(sizes), scope).select(*keys, "field", "tid", "n", group(F.pmod(F.xxhash64(*keys), F.col("__own"))).alias("__group"))
    asking = said.join(F.broadcast(sizes), scope).select(*said.columns, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__own") - 1)).alias("__of"), "__s")
    asking = asking.withColumn("__group", group(F.col("__of"))).drop("__of", "__s")
    out = T.StructType([said.schema["queryid"], said.schema[scope], *(hits.schema[k] for k in keys)]).add("lexical", "double").add("headinghits", "integer")
    both = dealt.unionByName(asking, allowMissingColumns=True).repartition(min(4 * (total or 1), 32 * cores), "__group")
    ship_code(spark)
    # one number to sort by: the group, hits before questions, a chunk's hits side by side
    both = both.withColumn("__asks", F.col("terms").isNotNull().cast("long"))
    order = F.shiftleft("__group", 33) + F.shiftleft("__asks", 32) + F.xxhash64(*keys).bitwiseAND(F.lit(0xFFFFFFFF))
    both = both.withColumn("__low", order).sortWithinPartitions("__low")
    with counted_batches(spark):
        return checkpointed(both.drop("__low").mapInArrow(lambda batches: group_scores(batches, list(keys), scope, out, most), out))


def few_scores(questions: DataFrame, asked: DataFrame, chunks: DataFrame, keys: tuple[str, ...], scope: str, most: int | None, vectors: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """lexical_scores of questions that every task can hold."""
    weights = F.collect_list(F.struct("term", F.char_length("said").cast("double").alias("size")))
    said = asked.groupBy("queryid", scope).agg(weights.alias("terms"))
    if vectors is not None:
        scoped = questions.select("queryid", scope).join(said, ["queryid", scope], "left")
        said = scoped.join(vectors[0].select("queryid", "vector", F.lit(True).alias("vectored")), "queryid", "left").filter("terms IS NOT NULL OR vectored")
        by = [k for k in keys if k in vectors[1].columns]
        chunks = chunks.join(vectors[1].select(*by, "vector", F.lit(True).alias("vectored")).dropDuplicates(by), by, "left")
    out = T.StructType([said.schema["queryid"], said.schema[scope], *(chunks.schema[k] for k in keys)]).add("lexical", "double").add("headinghits", "integer")
    if vectors is not None:
        out = out.add("cosine", "double")
    held = said.toArrow()
    lists = held.column("terms").combine_chunks()
    lists = pc.coalesce(lists, pa.array([[]], lists.type)[0]) if lists.null_count else lists
    flat = lists.flatten()
    words = flat.field("term").dictionary_encode()
    numbered = pa.StructArray.from_arrays([words.indices.cast(pa.int64()), flat.field("size")], ["tid", "size"])
    held = held.set_column(held.schema.get_field_index("terms"), "terms", pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), numbered))
    return scan_scores(held, words.dictionary.to_pylist(), chunks, list(keys), scope, out, most)


HEAD_SCORE, DIGITS = 15.0, 9
#: The field of rows that bring a chunk's vector.
VECTOR = 3


def tile_scores(left: pa.Table, right: pa.Table, keys: list[str], scope: str, schema: T.StructType, most: int | None) -> pa.Table:
    """Scores of a tile's questions (left) and hits (right)."""
    if not left.num_rows or not right.num_rows:
        return to_arrow_schema(schema).empty_table()
    chunk = right.select(keys).to_pandas().groupby(keys, sort=True, dropna=False).ngroup().to_numpy()  # numbers in the order of keys
    example = np.zeros(int(chunk.max()) + 1, dtype=np.int64)
    example[chunk] = np.arange(len(chunk))
    field, vectors = right.column("field").to_numpy(), None
    named = right.select(keys).take(pa.array(example))
    if "vector" in left.column_names:
        at = np.flatnonzero(field == VECTOR)
        vectors = chunk[at], right.column("vector").take(pa.array(at))
        right, chunk, field = (x.filter(pa.array(field != VECTOR)) if isinstance(x, pa.Table) else x[field != VECTOR] for x in (right, chunk, field))
    return pair_scores(left, named, (chunk, field, right.column("tid").to_numpy().astype(np.int64), right.column("n").to_numpy()), vectors, scope, schema, most)


def group_scores(batches, keys: list[str], scope: str, schema: T.StructType, most: int):
    """The best pairs of groups (__group) of hits, which come first, and questions (__asks is 1), which are never all held: a group's hits make tiles,
    which its questions meet some at a time. A question's rows of all tiles of the group are cut to its best."""
    size = BEST_PAIRS[1]
    group = tiles = None
    held: list[pa.RecordBatch] = []
    for batch in batches:
        marks = np.stack([batch.column(x).to_numpy() for x in ("__group", "__asks")])
        ends = [0, *(np.flatnonzero((np.diff(marks) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            if lo == hi:
                continue
            if marks[0, lo] != group:
                group, tiles, held = marks[0, lo], None, []
            part = batch.slice(lo, hi - lo)
            if marks[1, lo] == 0:
                held.append(part.select([*keys, "field", "tid", "n"]))
                continue
            if tiles is None:
                tiles, held = hit_tiles(held, keys, size), []
            left, best = pa.Table.from_batches([part]), {}
            if len(tiles) == 1:
                yield from pair_table(left, [tiles[0][0]], found_pairs(left, tiles[0][0].num_rows, tiles[0][1], None, most), scope, schema).to_batches()
                continue
            for t, (named, postings) in enumerate(tiles):
                for q, rows, *values in found_pairs(left, named.num_rows, postings, None, most):
                    best.setdefault(q, []).append((rows + t * size, *values))
            merged = []
            for q, parts in sorted(best.items()):
                rows, lexical, heads = (np.concatenate(x) for x in zip(*parts, strict=True))
                at = best_of(rows, lexical, heads, most)
                merged.append((q, rows[at], lexical[at], heads[at]))
            yield from pair_table(left, [named for named, _ in tiles], merged, scope, schema).to_batches()


def hit_tiles(held: list[pa.RecordBatch], keys: list[str], size: int) -> list[tuple]:
    """Tiles of ``size`` chunks, in the order of keys, of hits where those of a chunk mostly come side by side: the chunks' keys and postings."""
    if not held:
        return []
    hits = pa.Table.from_batches(held)
    new = np.zeros(hits.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        places = hits.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        new[1:] |= np.diff(places) != 0
    runs = np.flatnonzero(new)
    heads = hits.select(keys).take(pa.array(runs))
    number = heads.to_pandas().groupby(keys, sort=True, dropna=False).ngroup().to_numpy()  # in the order of keys
    example = np.zeros(int(number.max()) + 1, dtype=np.int64)
    example[number] = np.arange(len(number))
    named = heads.take(pa.array(example)).combine_chunks()
    chunk = np.repeat(number, np.diff([*runs.tolist(), hits.num_rows]))
    tile, (field, tid, n) = chunk // size, (hits.column(c).to_numpy() for c in ("field", "tid", "n"))
    tiles = []
    for t in range(int(tile.max()) + 1):
        own, some = tile == t, named.slice(t * size, size)
        tiles.append((some, postings_of(chunk[own] - t * size, field[own], tid[own], n[own], some.num_rows)))
    return tiles


def postings_of(chunk: np.ndarray, field: np.ndarray, tid: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, list[tuple]]:
    """The distinct tids, and by field where each one's postings end, their chunks and their values."""
    tids, term = np.unique(tid, return_inverse=True)
    tids = tids if len(tids) else np.array([-1])
    postings = []
    for f in (0, 1, 2):
        at = field == f
        pairs, inverse = np.unique(term[at].astype(np.int64) * size + chunk[at], return_inverse=True)
        total = np.bincount(inverse, weights=n[at], minlength=len(pairs))
        ends = np.searchsorted(pairs, np.arange(len(tids) + 1, dtype=np.int64) * size)
        postings.append((ends, (pairs % size).astype(np.int32), 1 + np.log(total) if f == 0 else np.ones(len(pairs))))
    return tids, postings


def pair_scores(left: pa.Table, named: pa.Table, hits: tuple[np.ndarray, ...], vectors: tuple[np.ndarray, pa.ChunkedArray] | None, scope: str, schema: T.StructType, most: int | None) -> pa.Table:
    """Scores of questions (left) and chunks: ``named`` has the keys of these, in their order; ``hits`` the chunk (its place there), field, tid and n of each hit,
    ``vectors`` the places of chunks that have one, and these."""
    return pair_table(left, [named], found_pairs(left, named.num_rows, postings_of(*hits, named.num_rows), vectors, most), scope, schema)


def best_of(rows: np.ndarray, lexical: np.ndarray, heads: np.ndarray, most: int) -> np.ndarray:
    """Places, in order, of the ``most`` best rows by score and the ``most`` best with heading hits, of rows in the order of their keys."""
    if len(rows) <= most:
        return np.arange(len(rows))
    score = np.round(lexical + HEAD_SCORE * heads if heads.any() else lexical, DIGITS)
    best, headed = np.sort(_first(score, rows, most)), np.flatnonzero(heads > 0)
    if not len(headed):
        return best
    return np.union1d(best, headed[np.lexsort((headed, -score[headed], -heads[headed]))[:most]])


def found_pairs(left: pa.Table, size: int, prepared: tuple, vectors: tuple[np.ndarray, pa.ChunkedArray] | None, most: int | None) -> list[tuple]:
    """For each question (its place) that has any: its chunks, lexical, heading hits and, with vectors, cosines and whether there is one."""
    tids, postings = prepared
    cosines = paired = None
    if vectors is not None:
        at, others = vectors
        has = np.flatnonzero(left.column("vectored").fill_null(False).to_numpy())
        cosines, paired = np.zeros((left.num_rows, size)), np.zeros((left.num_rows, size), dtype=bool)
        cosines[np.ix_(has, at)] = cosine_matrix(left.column("vector").take(pa.array(has)), others)
        paired[np.ix_(has, at)] = True
    lists = left.column("terms").combine_chunks()
    if lists.null_count:
        lists = pc.coalesce(lists, pa.array([[]], lists.type)[0])
    flat, bounds = lists.flatten(), lists.offsets.to_numpy()
    bounds = bounds - bounds[0]
    asked, sizes = flat.field("tid").to_numpy(), flat.field("size").to_numpy()
    place = np.searchsorted(tids, asked)
    known = tids[np.minimum(place, len(tids) - 1)] == asked

    def summed(f: int, at: np.ndarray, weights: np.ndarray | None) -> np.ndarray | None:
        """By chunk the sum over the terms ``at``."""
        ends, chunks, values = postings[f]
        first, counts = ends[at], ends[at + 1] - ends[at]
        total = int(counts.sum())
        if not total:
            return None
        i = np.arange(total) + np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        return np.bincount(chunks[i], weights=values[i] if weights is None else values[i] * np.repeat(weights, counts), minlength=size)

    found = []
    none = np.zeros(size)
    for q in range(left.num_rows):
        span = slice(bounds[q], bounds[q + 1])
        at, w = place[span][known[span]], sizes[span][known[span]]
        body, heads, names = summed(0, at, w), summed(1, at, None), summed(2, at, None)
        if body is None and heads is None and names is None and (paired is None or not paired[q].any()):
            continue
        lexical = none if body is None else body
        if names is not None:
            lexical = lexical + 2.0 * names
        hit = lexical > 0 if heads is None else (lexical > 0) | (heads > 0)
        rows = np.flatnonzero(hit if paired is None else hit | paired[q])
        if most is not None:
            rows = rows[best_of(rows, lexical[rows], none[rows] if heads is None else heads[rows], most)]
        pairs = () if paired is None else (cosines[q, rows], paired[q, rows])
        found.append((q, rows, lexical[rows], none[rows] if heads is None else heads[rows], *pairs))
    return found


def pair_table(left: pa.Table, named: list[pa.Table], found: list[tuple], scope: str, schema: T.StructType) -> pa.Table:
    """Found pairs as rows; their chunks are places in the tables of ``named`` one behind another."""
    if not found:
        return to_arrow_schema(schema).empty_table()
    q = np.repeat([x[0] for x in found], [len(x[1]) for x in found])
    rows, lexical, heads, *pairs = (np.concatenate(x) for x in list(zip(*found, strict=True))[1:])
    columns = [left.column("queryid").combine_chunks().take(pa.array(q)), left.column(scope).combine_chunks().take(pa.array(q))]
    whole = pa.concat_tables(named) if len(named) > 1 else named[0]
    columns += [whole.column(k).combine_chunks().take(pa.array(rows)) for k in whole.column_names]
    columns += [pa.array(lexical), pa.array(heads.astype(np.int32))]
    if pairs:
        columns.append(pa.array(pairs[0], mask=~pairs[1]))
    return pa.table(columns, schema.names)


def cosine_matrix(left: pa.ChunkedArray, right: pa.ChunkedArray) -> np.ndarray:
    """Cosines of all pairs of vectors: 0 when lengths differ, one is zero or lacks a component."""
    out = np.zeros((len(left), len(right)))
    a, b = vectors_by_length(left), vectors_by_length(right)
    for n in a.keys() & b.keys():
        (i, x), (j, y) = a[n], b[n]
        sizes = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))[None, :]
        some = ~(sizes <= 0)
        out[np.ix_(i, j)] = np.divide(x @ y.T, sizes, out=np.zeros(sizes.shape), where=some)
    return out


def vectors_by_length(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of each length."""
    held = vectors.to_pylist()
    found: dict[int, list[int]] = {}
    for i, v in enumerate(held):
        if v and None not in v:
            found.setdefault(len(v), []).append(i)
    return {n: (np.array(at), np.array([held[i] for i in at], dtype=np.float64)) for n, at in found.items()}


def with_content(rows: DataFrame, chunks: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunkindex"), most: int | None = None) -> DataFrame:
    """Add file name and content, or its first ``most`` characters, to few rows, which are kept: chunks aren't shuffled for them."""
    content = F.col("content") if most is None else F.left("content", F.lit(most)).alias("content")
    return few(checkpointed(rows)).join(chunks.select(*keys, "filename", content), list(keys))


def semantic_scores(queries: DataFrame, corpus: DataFrame, scope: str) -> DataFrame:
    """queryid, vec_id, cosine of all pairs within the scope; queries and corpus: vec_id, scope, embedding. Tiles of queries meet tiles of rows as
    matrix products in Arrow batches; every pair is a row."""
    q = queries.select(scope, F.col("vec_id").alias("queryid"), F.col("embedding").alias("vector"))
    queries, corpus = (df.toDF(*df.columns) for df in (q, corpus.select(scope, "vec_id", F.col("embedding").alias("vector"))))  # may be of one table
    side = 2 * math.isqrt(TILE_QUERIES * TILE_ROWS)  # of all tiles with as many pairs, square ones repeat the fewest rows
    q = tiled(queries, scope, "queryid", side, corpus, side, ("qt", "ct"))
    c = tiled(corpus, scope, "vec_id", side, queries, side, ("ct", "qt"))
    schema = T.StructType([T.StructField("queryid", queries.schema["queryid"].dataType), T.StructField("vec_id", corpus.schema["vec_id"].dataType)]).add("cosine", "double")

    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        cosines = cosine_matrix(left.column("vector"), right.column("vector"))
        ids = left.column("queryid").combine_chunks().take(pa.array(np.repeat(np.arange(left.num_rows), right.num_rows)))
        others = right.column("vec_id").combine_chunks().take(pa.array(np.tile(np.arange(right.num_rows), left.num_rows)))
        return pa.table([ids, others, pa.array(cosines.ravel())], schema.names)

    by = [scope, "qt", "ct"]
    return q.groupBy(*by).cogroup(c.groupBy(*by)).applyInArrow(pairs, schema)


TILE_QUERIES, TILE_ROWS = 256, 4096


def tiled(rows: DataFrame, scope: str, key: str, size: int, other: DataFrame, other_size: int, names: tuple[str, str]) -> DataFrame:
    """Rows of each scope dealt to tiles of about ``size`` (names[0]), each repeated for every tile (names[1]) of the other side."""
    tiles = lambda df, n, name: df.groupBy(scope).agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    counts = tiles(rows, size, "__own").join(tiles(other, other_size, "__others"), scope)
    dealt = rows.join(counts, scope).withColumn(names[0], F.pmod(F.xxhash64(key), F.col("__own")).cast("int"))
    return dealt.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col("__others") - 1))).drop("__own", "__others")


def semantic_top(queries: DataFrame, corpus: DataFrame, k: int, scope: str = "courseid", digits: int = 7) -> DataFrame:
    """queryid, vec_id, cosine (rounded): each query's k nearest rows of its scope, ties to the smaller vec_id; queries (queryid, scope, vector),
    corpus (scope, vec_id, vector). Vectors that are null, zero or of other lengths have no cosine.

    Tiles of queries meet tiles of rows as matrix products in Arrow batches; a tile gives k rows for each of its queries, so no pair is ever a row."""
    queries, corpus = (df.toDF(*df.columns) for df in (queries.select(scope, "queryid", "vector"), corpus.select(scope, "vec_id", "vector")))  # may be of one table
    q = tiled(queries, scope, "queryid", TILE_QUERIES, corpus, TILE_ROWS, ("qt", "ct"))
    c = tiled(corpus, scope, "vec_id", TILE_ROWS, queries, TILE_QUERIES, ("ct", "qt"))
    schema = T.StructType([T.StructField("queryid", queries.schema["queryid"].dataType), T.StructField("vec_id", corpus.schema["vec_id"].dataType)]).add("cosine", "double")

    def by_length(table: pa.Table, key: str) -> dict[int, tuple[pa.Array, np.ndarray]]:
        """The ids and unit vectors of each length."""
        out: dict[int, tuple] = {}
        vectors = [None if v is None or None in v else np.array(v, dtype=np.float64) for v in table.column("vector").to_pylist()]
        norms = [0.0 if v is None else float(np.sqrt((v * v).sum())) for v in vectors]
        for n in {len(v) for v in vectors if v is not None}:
            at = [i for i, (v, x) in enumerate(zip(vectors, norms, strict=True)) if v is not None and len(v) == n and np.isfinite(x) and x > 0]
            if at:
                out[n] = table.column(key).combine_chunks().take(pa.array(at)), np.stack([vectors[i] / norms[i] for i in at])
        return out

    def top(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        rows = by_length(right, "vec_id")
        for n, (ids, vectors) in by_length(left, "queryid").items():
            if n not in rows:
                continue
            others, matrix = rows[n]
            place = np.argsort(np.argsort(others.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
            cosines = np.round(vectors @ matrix.T, digits)
            for i, row in enumerate(cosines):
                best = np.lexsort((place, -row))[:k] if len(row) <= 4 * k else _first(row, place, k)
                found.append(pa.table([pa.array([ids[i].as_py()] * len(best), left.schema.field("queryid").type), others.take(pa.array(best)), pa.array(row[best])], schema.names))
        return pa.concat_tables(found) if found else pa.table([pa.array([], left.schema.field("queryid").type), pa.array([], right.schema.field("vec_id").type), pa.array([], pa.float64())], schema.names)

    by = [scope, "qt", "ct"]
    tops = q.groupBy(*by).cogroup(c.groupBy(*by)).applyInArrow(top, schema)
    return tops.withColumn("__n", F.row_number().over(W.partitionBy("queryid").orderBy(F.desc("cosine"), "vec_id"))).filter(F.col("__n") <= k).drop("__n")


def _first(row: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The k largest of a row, ties by place, without sorting all of it."""
    least = np.partition(row, len(row) - k)[len(row) - k]
    some = np.flatnonzero(row >= least)
    return some[np.lexsort((place[some], -row[some]))[:k]]


def hybrid_scores(pairs: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunkindex")) -> DataFrame:
    """queryid, chunk keys, headinghits, semantic, score. For pairs with a column cosine: cosine + WEIGHT x lexical / best lexical of the query; a chunk
    without a vector keeps the lexical part, a query without vectors the lexical score alone. Heading hits raise the score. Pairs with neither a
    hit nor vectors are not there (their score is 0)."""
    if "cosine" not in pairs.columns:
        scored = pairs.select("queryid", *keys, "headinghits", F.lit(False).alias("semantic"), F.col("lexical").alias("score"))
    else:
        top = checkpointed(pairs.groupBy("queryid").agg(F.max("lexical").alias("top"), F.max(F.col("cosine").isNotNull()).alias("semantic")))
        share = F.when(F.col("top") > 0, F.col("lexical") / F.col("top")).otherwise(0.0)
        score = F.when(F.col("semantic"), F.coalesce("cosine", F.lit(0.0)) + WEIGHT * share).otherwise(F.col("lexical"))
        scored = pairs.join(few(top), "queryid").select("queryid", *keys, "headinghits", "semantic", score.alias("score"))
    boost = F.when(F.col("semantic"), F.least(F.lit(0.4), 0.15 * F.col("headinghits"))).otherwise(HEAD_SCORE * F.col("headinghits"))
    return scored.withColumn("score", F.col("score") + boost)


def select_top_k(scored: DataFrame, k: int, keys: tuple[str, ...] = ("doc_id", "chunkindex")) -> DataFrame:
    """The k chunks of each query, with place: first the reserved heading matches (at most max(1, k / 2), by hits and score), then by score.
    Only positive scores; ties go by the chunk's keys.

    What is chosen is among the best k by score and the reserved ones, both of which Spark cuts before its shuffle."""
    by = W.partitionBy("queryid")
    best = [F.desc("score"), *keys]
    head = F.col("headinghits") > 0
    df = scored.filter("score > 0")
    top = df.withColumn("__n", F.row_number().over(by.orderBy(*best))).filter(F.col("__n") <= k).withColumn("__reserved", F.lit(False))
    reserved = df.filter(head).withColumn("__n", F.row_number().over(by.orderBy(F.desc("headinghits"), *best))).filter(F.col("__n") <= max(1, k // 2)).withColumn("__reserved", F.lit(True))
    # dealt anew: Spark 4.1 may take a union of two sides that lie by queryid for one that does, with other partitions than it has
    both = top.unionByName(reserved).repartition("queryid", *keys).groupBy(*scored.columns).agg(F.max("__reserved").alias("__reserved"))
    both = both.withColumn("__n", F.row_number().over(by.orderBy(F.desc("__reserved"), *best))).filter(F.col("__n") <= k)
    place = F.row_number().over(by.orderBy(F.desc(head), F.desc("headinghits"), *best))
    return both.withColumn("place", place).withColumn("heading", head).drop("__reserved", "__n")


def term_coverage(questions: DataFrame, selected: DataFrame) -> DataFrame:
    """queryid and coverage: the share of a question's terms of four characters and more that stand in some selected chunk."""
    long = F.filter(tokenize("query"), lambda t: F.char_length(t) >= 4)
    terms = questions.select("queryid", F.explode_outer(long).alias("term"))
    texts = selected.select("queryid", fold_accents(F.lower("content")).alias("h"))
    joined = terms.join(texts.withColumn("j", normalize_separators("h")), "queryid", "left")
    inside = F.coalesce(F.when(F.col("term").contains("-"), F.col("j")).otherwise(F.col("h")).contains(fold_accents("term")), F.lit(False))
    found = joined.groupBy("queryid", "term").agg(F.max(inside).alias("found"))
    return found.groupBy("queryid").agg(F.when(F.count("term") == 0, 1.0).otherwise(F.avg(F.when(F.col("term").isNotNull(), F.col("found").cast("double")))).alias("coverage"))


def weak_retrieval(questions: DataFrame, selected: DataFrame, least_semantic: float = 0.35, least_lexical: float = 8.0) -> DataFrame:
    """queryid, weak: nothing found, a best score too low for its kind, or none of the main terms found."""
    best = selected.groupBy("queryid").agg(F.max("score").alias("top"), F.max("semantic").alias("semantic"))
    df = questions.select("queryid", "query").join(best, "queryid", "left").join(term_coverage(questions, selected), "queryid")
    low = F.when(F.col("semantic"), F.col("top") < least_semantic).otherwise(F.col("top") < least_lexical)
    main = F.size(F.filter(tokenize("query"), lambda t: F.char_length(t) >= 4)) > 0
    return df.select("queryid", (F.col("top").isNull() | low | (main & (F.col("coverage") <= 0))).alias("weak"))


#: Characters by which contents are taken for the same.
SAME_START = 200


def merge_ranked(lists: DataFrame, k: int, key: str = "queryid") -> DataFrame:
    """Round-robin of ranked lists (columns pass, rank from 1, filename, content): by depth, then pass; of equal
    (filename, first 200 characters) the first; k in all."""
    same = F.concat_ws("|", "filename", F.left("content", F.lit(SAME_START)))
    first = lists.withColumn("__same", same).withColumn("__d", F.row_number().over(W.partitionBy(key, "__same").orderBy("rank", "pass"))).filter("__d = 1")
    return first.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("rank", "pass"))).filter(F.col("place") <= k).drop("__same", "__d")


def lexical_top(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The k best chunks of each question by terms (scores to DIGITS digits), with file name and content."""
    return with_content(select_top_k(top_scores(questions, chunks, k), k), chunks)


def top_scores(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Scored pairs by terms, to DIGITS digits, from which select_top_k and retrieval_report choose at most k as from all: kept as a table."""
    scored = hybrid_scores(lexical_scores(questions, chunks, most=k)).withColumn("score", F.round("score", DIGITS))
    by, best = W.partitionBy("queryid"), [F.desc("score"), "doc_id", "chunkindex"]
    ranks = {"__n": F.row_number().over(by.orderBy(*best)), "__h": F.row_number().over(by.orderBy(F.desc("headinghits"), *best))}
    return checkpointed(scored.withColumns(ranks).filter((F.col("__n") <= k) | ((F.col("headinghits") > 0) & (F.col("__h") <= k))).drop(*ranks))


def multi_pass(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The question itself and its focus query, each ranked, merged round-robin. Both passes are scored together. Rows name chunks and have no content."""
    focus = questions.withColumn("query", focus_query("query")).filter("query <> ''")
    asked = questions.withColumn("pass", F.lit(0)).unionByName(focus.withColumn("pass", F.lit(1)))
    once = asked.withColumn("queryid", F.struct("queryid", "pass"))
    best = with_content(select_top_k(top_scores(once, chunks, k), k), chunks, most=SAME_START)
    top = best.select(F.col("queryid.queryid").alias("queryid"), F.col("queryid.pass").alias("pass"), *[c for c in ("doc_id", "chunkindex", "filename", "content", "score")], F.col("place").alias("rank"))
    return merge_ranked(top, k).drop("content")


def retrieval_report(scored: DataFrame, chunks: DataFrame, k: int, n: int) -> DataFrame:
    """The n best chunks of each query with breadcrumb, rounded score, heading and selected flags and a snippet."""
    by = W.partitionBy("queryid").orderBy(F.desc("score"), "doc_id", "chunkindex")
    top = scored.withColumn("position", F.row_number().over(by)).filter(F.col("position") <= n)
    chosen = select_top_k(scored, k).select("queryid", "doc_id", "chunkindex", F.lit(True).alias("selected"))
    df = with_content(top.join(chosen, ["queryid", "doc_id", "chunkindex"], "left"), chunks)
    snippet = F.left(F.trim(F.regexp_replace(strip_breadcrumb("content"), r"\s+", " ")), F.lit(160))
    return df.select("queryid", "position", "doc_id", "chunkindex", breadcrumb("content").alias("section"), F.round("score", 4).alias("score"), (F.col("headinghits") > 0).alias("heading"), F.coalesce("selected", F.lit(False)).alias("selected"), snippet.alias("snippet"))
