"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum,
over all of its segmentations into pieces, of the product of the pieces' probabilities (forward algorithm); a
text's score is the product over its words, and the languages' scores give a posterior.

Training: expected piece counts (forward-backward) of the words of labelled texts, starting from a rank-based
distribution that is the same for all languages. It takes at most ``train_per_lang`` texts of each language, those with
the smallest hash of their id; ``train_per_lang`` is the documented bound. Prediction reads every whole text.

Words are runs of letters, lower-cased, of any length; pieces are all of the vocabulary's pieces of lower-case letters.
A text that is null or has no letter is ``und`` with score 0, and so are all texts if nothing could be learned.
Ties go to the language that sorts first. Repeated rows give repeated rows, an empty table gives no rows, and columns other
than those named are ignored or, if ``extra``, carried along.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import checkpointed
from corvane.session import text_batches

MARK = "▁"
#: Letters of a word whose probabilities can't underflow; those of longer ones are kept with exponents.
SAFE = 24
#: An exponent's unit.
_UNIT = 1e100
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_KEEP = 80_000
_FLOOR = 1e-8
#: Ids to learn from that may be broadcast; more of them (of some hundred languages) are joined by shuffle.
FEW = 1_000_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    words = _LETTERS.findall((text or "").lower())
    if not all(map(str.isalpha, words)):
        words = [s for w in words for s in "".join(c if c.isalpha() else " " for c in w).split()]
    return words


class Vocabulary:
    """The pieces of letters, and where they lie in words."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        texts = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.pieces = [p for p in texts if p == p.lower() and p.removeprefix(MARK).isalpha()]
        self.longest = max(map(len, self.pieces))
        self.unknown = len(self.pieces)  # a letter that is no piece; the row after it stands for no piece at all
        rank = np.arange(len(self.pieces)) + 50.0
        self.start = np.r_[1 / rank / (1 / rank).sum(), _FLOOR, 0.0]
        known = {p: i for i, p in enumerate(self.pieces)}
        prefixes = sorted({p[:k] for p in known for k in range(1, len(p) + 1)})
        keys = np.array([self.key(p) for p in prefixes], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.piece = keys[order], np.array([known.get(p, -1) for p in prefixes])[order]
        assert len(np.unique(keys)) == len(keys)

    @staticmethod
    def key(s: str) -> int:
        h = 0
        for c in s:
            h = (h * int(_BASE) + ord(c)) & (2**64 - 1)
        return h

    def lattice(self, words: list[str]) -> np.ndarray:
        """For words of one length n (mark included): [piece length - 1, word, start] -> piece row."""
        n = len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        out = np.full((min(self.longest, n), len(chars)), self.unknown + 1, dtype=np.int32)
        room = n - np.arange(len(chars)) % n
        at, h = np.arange(len(chars)), np.zeros(len(chars), dtype=np.uint64)
        for size in range(1, len(out) + 1):
            if not len(at):
                break
            h = h * _BASE + chars[at + size - 1]
            pos = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[pos] == h
            piece = self.piece[pos]
            full = hit & (piece >= 0)
            out[size - 1, at[full]] = piece[full]
            if size == 1:
                out[0, out[0] > self.unknown] = self.unknown
            stay = hit & (room[at] > size)
            at, h = at[stay], h[stay]
        return out.reshape(len(out), len(words), n)

    def forward(self, lattice: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """[position, word, language]: probability of a word's first letters over all segmentations, and for words of over SAFE
        letters the exponents: the probability is a * _UNIT ** -k."""
        sizes, words, n = lattice.shape
        a = np.zeros((n + 1, words, p.shape[1]))
        a[0] = 1
        k = np.zeros(a.shape, dtype=np.int64) if n > SAFE else None
        there = lattice <= self.unknown
        some = there.any(axis=1).tolist()
        for j in range(1, n + 1):
            if k is not None:
                k[j] = k[j - 1]
            for size in range(1, min(sizes, j) + 1):
                if not some[size - 1][j - size]:
                    continue
                at = np.flatnonzero(there[size - 1, :, j - size])
                x = a[j - size, at] * p[lattice[size - 1, at, j - size]]
                a[j, at] += x if k is None else x * _UNIT ** (k[j, at] - k[j - size, at]).astype(float)
            if k is not None:
                low = a[j] < 1 / _UNIT
                a[j][low] *= _UNIT
                k[j][low] += 1
        return a, k

    def grouped(self, words):
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        for n, same in by.items():
            step = max(1, 100_000 // n)
            for i in range(0, len(same), step):
                yield same[i : i + step]

    def logs(self, words, p: np.ndarray) -> tuple[list[str], np.ndarray]:
        order, rows = [], []
        for same in self.grouped(words):
            order += same
            a, k = self.forward(self.lattice([MARK + w for w in same]), p)
            rows.append(np.log(a[-1]) - (0 if k is None else k[-1] * np.log(_UNIT)))
        return order, np.concatenate(rows) if rows else np.zeros((0, p.shape[1]))

    def expected(self, counts: Counter) -> np.ndarray:
        """Expected number of each piece in the counted words, all segmentations weighted by their probability."""
        p, total = self.start[:, None], np.zeros(self.unknown + 2)
        for same in self.grouped(counts):
            lattice = self.lattice([MARK + w for w in same])
            sizes, words, n = lattice.shape
            a, k = (x if x is None else x[:, :, 0] for x in self.forward(lattice, p))
            b, kb = np.zeros_like(a), None if k is None else np.zeros_like(k)
            b[n] = np.array([counts[w] for w in same]) / a[n]
            there = lattice <= self.unknown
            some = there.any(axis=1).tolist()
            for i in range(n - 1, -1, -1):
                if k is not None:
                    kb[i] = kb[i + 1]
                for size in range(1, min(sizes, n - i) + 1):
                    if not some[size - 1][i]:
                        continue
                    at = np.flatnonzero(there[size - 1, :, i])
                    piece = lattice[size - 1, at, i]
                    through = self.start[piece] * b[i + size, at]
                    if k is None:
                        b[i, at] += through
                        np.add.at(total, piece, a[i, at] * through)
                    else:
                        b[i, at] += through * _UNIT ** (kb[i, at] - kb[i + size, at]).astype(float)
                        np.add.at(total, piece, a[i, at] * through * _UNIT ** (k[n, at] - k[i, at] - kb[i + size, at]).astype(float))
                if k is not None:
                    low = b[i] < 1 / _UNIT
                    b[i][low] *= _UNIT
                    kb[i][low] += 1
        return total


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def crc_remainder(id_col: str, parts: int = 5) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def learn(docs: DataFrame, model: str, trained: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_per_lang: int = 4000) -> dict[str, np.ndarray]:
    """Piece counts of each language. The result has one number for each language and vocabulary piece at most."""
    text_batches(docs.sparkSession)
    labelled = docs.filter(trained & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    order = [F.xxhash64("id"), F.col("id")]
    salted = labelled.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))  # a language may have most of the rows
    few = salted.withColumn("nth", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("nth") <= train_per_lang)
    chosen = few.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("nth") <= train_per_lang).select("id", "lang").distinct()
    chosen = checkpointed(chosen)
    if chosen.count() <= FEW:  # an id and a language for each: then only the texts that are learned from leave the scan
        chosen = F.broadcast(chosen)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(chosen, ["id", "lang"], "left_semi")

    def run(batches):
        v, counts = vocabulary(model), {}
        sums: dict[str, np.ndarray] = {}

        def fold():
            for lang, c in counts.items():
                sums[lang] = sums.get(lang, 0) + v.expected(c)
            counts.clear()

        for batch in batches:
            for text, lang in zip(batch.column(1), batch.column(2), strict=True):
                own = counts.setdefault(lang.as_py(), Counter())
                own.update(words_of(text.as_py()))
                if len(own) > _KEEP:
                    fold()
        fold()
        for lang, x in sums.items():
            some = np.flatnonzero(x[:-1] > 0)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(x[some], pa.float64())], ["lang", "piece", "n"])

    found = texts.select("id", "text", "lang").mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    out: dict[str, np.ndarray] = {}
    size = vocabulary(model).unknown + 2
    for row in found.toLocalIterator():
        out.setdefault(row["lang"], np.zeros(size))[row["piece"]] = row["n"]
    return out


def probabilities(counts: dict[str, np.ndarray], start: np.ndarray, smoothing: float = 0.02) -> tuple[list[str], np.ndarray]:
    """Languages in order, and [piece, language] smoothed by the shared distribution."""
    langs = sorted(counts)
    p = np.zeros((len(start), len(langs)))
    for k, lang in enumerate(langs):
        c = counts[lang].copy()
        unknown = c[-2]
        p[:, k] = (1 - smoothing) * c / max(c.sum(), 1e-300) + smoothing * start
        p[-2, k] = max(_FLOOR, p[-2, k] / (1000 if unknown else 1))  # shared among the many letters that are no piece
        p[-1, k] = 0
    return langs, p


def predict(docs: DataFrame, model: str, langs: list[str], p: np.ndarray, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """id, the extra columns, lang_pred, score (posterior), n_words. One narrow pass over whole texts, no shuffle."""
    text_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[id_col], *(docs.schema[c] for c in extra)]).add("lang_pred", "string").add("score", "double").add("n_words", "long")

    def run(batches):
        v = vocabulary(model)
        row_of: dict[str, int] = {}
        logs = np.zeros((0, len(langs)))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [words_of(t) for t in part.column(1).to_pylist()]
                if len(row_of) > _KEEP:
                    row_of, logs = {}, logs[:0]
                new = set().union(*texts) - row_of.keys()
                if new and langs:
                    order, rows = v.logs(new, p)
                    row_of.update(zip(order, range(len(logs), len(logs) + len(order)), strict=True))
                    logs = np.concatenate([logs, rows])
                out = []
                for words in texts:
                    if not words or not langs:
                        out.append(("und", 0.0, len(words)))
                        continue
                    total = logs[np.fromiter(map(row_of.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
                    k = int(np.argmax(total))
                    out.append((langs[k], float(1 / np.exp(np.minimum(total - total[k], 0)).sum()), len(words)))
                cols = [pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.float64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(part.column(2 + i) for i in range(len(extra))), *cols], schema.names)

    return docs.select(id_col, F.col(text_col).alias("__text"), *extra).mapInArrow(run, schema)


def identify(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", extra: tuple[str, ...] = (), train_per_lang: int = 4000) -> DataFrame:
    """Learn from labelled rows whose crc32(id) mod 5 isn't 0, then predict every row."""
    counts = learn(docs, model, crc_remainder(id_col) != 0, id_col, text_col, lang_col, train_per_lang)
    langs, p = probabilities(counts, vocabulary(model).start)
    return predict(docs, model, langs, p, id_col, text_col, extra)
