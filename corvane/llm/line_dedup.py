"""Line deduplication, in DataFrame functions only.

Texts are exploded into lines at newlines. A line's key is the line without white space at its ends and with A-Z lower-cased,
and is known by two 64-bit hashes of different seeds. Keys of at least ``least_chars`` code points that stand in at least
``least_docs`` documents lose all their lines but those in the document of the largest id that has them; what stays is joined again
in its order.

Only hashes and positions are shuffled to find the keys, already aggregated by each task. A key that has more than
one in ``COMMON`` of all lines is one of at most ``COMMON`` keys: these are broadcast, so that no task gets a hot line's rows; the
others are joined by a shuffle.

A document is an id: rows of one id count as one document and keep a shared key's lines together; rows without an id are one document
with the smallest id. Null text is one empty line, like empty text. Repeated rows give repeated rows, each treated alike; texts
and lines of any length are taken whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import checkpointed

COMMON = 4096
ENDS = " \t\n\x0b\x0c\r"
KEY, ROW = ["k1", "k2"], ["t1", "t2"]


def key_of(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased; plain ``lower`` does that for lines of ASCII."""
    line = F.btrim(line, F.lit(ENDS))
    other = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(other)


def hashes(x: Column, names: list[str]) -> list[Column]:
    return [F.xxhash64(F.lit(seed), x).alias(name) for seed, name in enumerate(names)]


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))


def long_lines(docs: DataFrame, least_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the text's hashes (t1, t2), at (line number from 0) and the key's hashes (k1, k2) of all lines whose key is long enough."""
    rows = rows_of(docs, id_col, text_col).select("doc_id", *hashes(F.col("text"), ROW), F.split("text", "\n").alias("lines"))
    lines = rows.select("doc_id", *ROW, F.posexplode("lines").alias("at", "line")).select("doc_id", *ROW, "at", key_of(F.col("line")).alias("key"))
    return lines.filter(F.char_length("key") >= least_chars).select("doc_id", *ROW, "at", *hashes(F.col("key"), KEY))


def repeated_keys(lines: DataFrame, least_docs: int = 3) -> DataFrame:
    """k1, k2, last (the largest id that has the key), n_docs and n_rows of the keys that stand in enough documents."""
    each = lines.groupBy(*KEY, "doc_id").agg(F.count("*").alias("n"))
    found = each.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_rows"), F.max("doc_id").alias("last"))
    return found.filter(F.col("n_docs") >= least_docs)


def dropped(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, t1, t2 and gone: the line numbers that a text loses. ``lines`` and ``keys`` are tables that are read more than once."""
    many = F.col("n_rows") > lines.count() / COMMON
    common, others = (keys.filter(x).select(*KEY, "last") for x in (many, ~many))
    lose = lines.join(F.broadcast(common), KEY).unionByName(lines.join(others, KEY)).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    return lose.groupBy("doc_id", *ROW).agg(F.collect_set("at").alias("gone"))


def dedup(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text (what stays), n_lines (before), n_dropped."""
    lines = checkpointed(long_lines(docs, least_chars, id_col, text_col))
    gone = dropped(lines, checkpointed(repeated_keys(lines, least_docs))).withColumnsRenamed({"doc_id": "id", "t1": "u1", "t2": "u2"})
    rows = rows_of(docs, id_col, text_col).select("doc_id", "text", *hashes(F.col("text"), ROW))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")), "left")
    rows = rows.select("doc_id", "text", "gone", F.split("text", "\n").alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    joined = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(joined)
    return rows.select("doc_id", text.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
