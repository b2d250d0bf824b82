"""Grouping of spelling variants: words that are one edit apart, joined by asymmetric q-chunks.

Of two words that are one inserted, deleted or replaced code point apart, the shorter (of equal lengths: either) has length L. It is cut
into two disjoint chunks; the edit leaves one of them whole, and the other word has that chunk as a positional gram, shifted by one at
most: the first chunk starts both words, or the last one ends both (an edit before it shifts it by one from the start, and by nothing
from the end). So a word contributes its two chunks, and as the other word the grams that chunks of words of its own length and one less
could meet: other grams are more than one place away from every chunk and would not join. Candidates are verified by edit distance.

A chunk that many words share would give all their pairs. Such a group is split by the same argument: what its words have between the shared
start and end is cut into two chunks again, one of which the edit leaves whole, until groups are small or one code point is
left (then a group is as large as the alphabet at most). No group's pairs are capped or dropped.

Words come from texts by patterns and aggregates that run before any shuffle; only distinct words are joined. Null text has no
words, a null id counts as an empty string, repeated rows count again, texts and words of any length are taken whole; ties go to
the smaller word by code points; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import checkpointed

RUN = "[A-Za-zÀ-ÿ]+"
#: Pairs of a group that are verified without a further split.
FEW = 1024
NODE = ["len", "p", "s", "head", "tail"]


def lowered(x: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    other = F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(other)


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and word for every run of letters."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(lowered(F.col(text_col)), F.lit(RUN), F.lit(0))).alias("word"))


def damaged(words: DataFrame, one_in: int = 97) -> DataFrame:
    """Some runs lose a code point: those whose crc32 with the id is divisible by ``one_in``."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "word").cast("binary"))
    cut = (F.col("h") % F.char_length("word")).cast("int")
    less = F.concat(F.substring("word", F.lit(1), cut), F.substring("word", cut + 2, F.char_length("word")))
    return words.withColumn("h", h).select("doc_id", F.when(F.col("h") % one_in == 0, less).otherwise(F.col("word")).alias("word"))


def counted(words: DataFrame, least_chars: int = 5, least_count: int = 3) -> DataFrame:
    """word and n: the distinct words that are long and frequent enough."""
    return words.filter(F.char_length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def at_nodes(rows: DataFrame) -> DataFrame:
    """Add head and tail: the first p and the last s code points of the word."""
    tail = F.when(F.col("s") > 0, F.substring("word", F.char_length("word") - F.col("s") + 1, F.col("s"))).otherwise("")
    return rows.withColumns({"head": F.substring("word", F.lit(1), F.col("p")), "tail": tail})


def halves(p: Column, s: Column, length: Column) -> Column:
    """The two ways to keep a half of what stands between the first p and the last s of ``length`` code points."""
    first = F.floor((length - p - s) / 2).cast("int")
    return F.array(F.struct((p + first).alias("p"), s.alias("s")), F.struct(p.alias("p"), (length - p - first).alias("s")))


def split(rows: DataFrame) -> DataFrame:
    """word, n, chunk and len of rows at both halves of their node."""
    cut = rows.withColumn("x", F.explode(halves(F.col("p"), F.col("s"), F.col("len"))))
    return at_nodes(cut.select("word", "n", "chunk", "len", "x.p", "x.s"))


def near_pairs(words: DataFrame, few: int = FEW) -> DataFrame:
    """a, n_a, b, n_b: every pair of words (word, n) that are one edit apart, once."""
    size = F.char_length("word")
    roles = F.array(*(F.struct(F.lit(c).alias("chunk"), n.alias("len")) for c, n in ((True, size), (False, size), (False, size - 1))))
    start = words.select("word", "n", F.explode(roles).alias("x")).select("word", "n", "x.*", F.lit(0).alias("p"), F.lit(0).alias("s"))
    rows, pairs = split(start), None
    while True:
        groups = rows.groupBy(*NODE).agg(F.count_if("chunk").alias("chunks"), F.count_if(~F.col("chunk")).alias("grams"))
        big = checkpointed(groups.filter((F.col("chunks") * F.col("grams") > few) & (F.col("len") - F.col("p") - F.col("s") > 1)).select(*NODE))
        last = big.isEmpty()
        small = rows if last else rows.join(big, NODE, "left_anti")
        a = small.filter("chunk").select(*NODE, F.col("word").alias("a"), F.col("n").alias("n_a"))
        b = small.filter("NOT chunk").select(*NODE, F.col("word").alias("b"), F.col("n").alias("n_b"))
        once = (F.char_length("b") > F.col("len")) | (F.col("a") < F.col("b"))
        found = a.join(b, NODE).filter(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")
        pairs = found if pairs is None else pairs.unionByName(found)
        if last:
            return pairs.distinct()
        rows = checkpointed(split(rows.join(big, NODE, "left_semi")))


def forms(words: DataFrame, pairs: DataFrame, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form and form_n: a word's near word of largest n, if that is at least ``ratio`` times its own."""
    sides = [pairs.select(F.col(x).alias("word"), F.col(y).alias("other"), F.col(f"n_{y}").alias("other_n")) for x, y in ("ab", "ba")]
    best = sides[0].unionByName(sides[1]).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    good = -F.col("best.m") >= ratio * F.col("n")
    rows = words.join(best, "word", "left")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """word and root for words with a form: the end of its forms. Every round doubles the steps; a form has at least twice the
    occurrences of its word, so a chain has few steps."""
    step = checkpointed(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if step.join(on, "root", "left_semi").isEmpty():
            return step
        step = checkpointed(step.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def group_variants(words: DataFrame, ratio: int = 2, few: int = FEW) -> DataFrame:
    """word, form, root, n, n_near, form_n for words (word, n), each of which is there once."""
    words = checkpointed(words.select("word", "n"))
    found = checkpointed(forms(words, near_pairs(words, few), ratio))
    whole = found.join(roots(found), "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
