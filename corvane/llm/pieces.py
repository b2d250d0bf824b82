"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes ``\\u2581``-marked words. No vocabulary piece has the mark after another character, so no merge
crosses a word's start and words are encoded once each. All distinct words of a batch lie in one flat numpy
array of symbols; each round finds every word's best (lowest) pair rank by a segmented minimum, merges the
leftmost pairs of that rank in all words at once, drops finished words and compacts the rest, until no word
has a pair left.

Several pairs of one word are merged in a round only if no better-ranked piece starts or ends with the merged
piece (else the merge could open a better pair); otherwise just the leftmost one is. The ids therefore equal
the sequential algorithm's. As such a word takes rounds in proportion to its length, and each passes over all of it, a word over
``LONG`` characters (a script without spaces, encoded data) is merged with a heap of its pairs, in n log n.

Null text counts as empty: no ids, decoded to the empty string. Texts and words of any length are taken whole. Repeated rows give
repeated rows, an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corvane.session import text_batches

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NO_PAIR = np.int64(1) << 60
#: Distinct words kept between batches by one task; longer words than _KEEP_CHARS are never kept.
_KEEP_WORDS, _KEEP_CHARS = 50_000, 40


#: Characters of a word that rounds merge at most.
LONG = 1000


class PieceTable:
    """A BPE vocabulary as arrays: pair keys -> (rank, merged symbol)."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.byte_id = {int(self.text[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.control = special - set(self.byte_of)
        self.unk = sp.unk_id()
        piece_id = {self.text[i]: i for i in range(size) if i not in special}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in piece_id):
            raise ValueError("a piece crosses a word's start; words can't be encoded one by one")
        # symbols: vocabulary ids, then one symbol for each code point that is no piece
        self.base = size
        self.width = np.int64(size + 0x110000)
        ranks = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in piece_id.values()}, reverse=True))}
        rank = {p: ranks[sp.get_score(i)] for p, i in piece_id.items()}
        self.symbol = np.arange(0x110000, dtype=np.int64) + size
        for p, i in piece_id.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i

        def symbol(s: str) -> int | None:
            return int(self.symbol[ord(s)]) if len(s) == 1 else piece_id.get(s)

        keys, values, open_to_better = [], [], set()
        for p, i in piece_id.items():
            for cut in range(1, len(p)):
                left, right = p[:cut], p[cut:]
                a, b = symbol(left), symbol(right)
                if a is not None and b is not None:
                    keys.append(a * int(self.width) + b)
                    values.append((rank[p], i))
                for part in (left, right):
                    if part in rank and rank[p] <= rank[part]:
                        open_to_better.add(piece_id[part])
        shared = {}
        for p, i in piece_id.items():
            shared.setdefault(rank[p], []).append(i)
        for same in shared.values():
            if len(same) > 1:
                open_to_better.update(same)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.ranks = np.array([r for r, _ in values], dtype=np.int64)[order]
        self.merged = np.array([m for _, m in values], dtype=np.int64)[order]
        self.one_by_one = np.zeros(size, dtype=bool)
        self.one_by_one[list(open_to_better)] = True

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """The final symbols of each (non-empty) word."""
        if any(len(w) > LONG for w in words):
            some = iter(self.merge([w for w in words if len(w) <= LONG]))
            return [self.merge_long(w) if len(w) > LONG else next(some) for w in words]
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sym, word = self.symbol[points], np.repeat(np.arange(len(words)), lengths)
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        rank, into = np.full(len(sym), _NO_PAIR), np.zeros(len(sym), dtype=np.int64)

        def look(i: np.ndarray) -> None:
            """Set rank and merged symbol of the pairs that begin at positions i."""
            rank[i] = _NO_PAIR
            i = i[i < len(sym) - 1]
            i = i[word[i] == word[i + 1]]
            key = sym[i] * self.width + sym[i + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            rank[i[hit]], into[i[hit]] = self.ranks[at[hit]], self.merged[at[hit]]

        look(np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(sym)])
            best = np.minimum.reduceat(rank, first)
            done = best == _NO_PAIR
            if done.any():
                for w, i, n in zip(word[first[done]].tolist(), first[done].tolist(), size[done].tolist(), strict=True):
                    out[w] = sym[i : i + n]
                keep = np.repeat(~done, size)
                sym, word, rank, into = sym[keep], word[keep], rank[keep], into[keep]
                best, size = best[~done], size[~done]
                if not len(sym):
                    break
            cand = np.flatnonzero(rank == np.repeat(best, size))
            # leftmost of touching pairs: every other one of a run
            run = np.flatnonzero(np.r_[True, np.diff(cand) != 1])
            nth = np.arange(len(cand)) - np.repeat(run, np.diff(np.r_[run, len(cand)]))
            first_of_word = np.r_[True, word[cand[1:]] != word[cand[:-1]]]
            take = cand[np.where(self.one_by_one[into[cand]], first_of_word, nth % 2 == 0)]
            sym[take] = into[take]
            left = np.ones(len(sym), dtype=bool)
            left[take + 1] = False
            fresh = np.zeros(len(sym), dtype=bool)
            fresh[take] = True
            sym, word, rank, into = sym[left], word[left], rank[left], into[left]
            new = np.flatnonzero(fresh[left])
            look(np.concatenate([new, new[new > 0] - 1]))
        return out

    @cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))

    def merge_long(self, word: str) -> np.ndarray:
        """The final symbols of one word: the best pair first, of equal ranks the leftmost."""
        sym = self.symbol[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        n, width, pairs = len(sym), int(self.width), self.pairs
        key = sym[:-1] * self.width + sym[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        first = np.where(self.keys[at] == key, self.ranks[at], -1)
        hit = np.flatnonzero(first >= 0)
        heap = ((first[hit] << 40) | hit).tolist()  # rank and place in one number
        heapify(heap)
        # rank of the pair that begins at a place, -1 for none; a number in the heap that differs is out of date
        rank, sym, after, before = [*first.tolist(), -1], sym.tolist(), [*range(1, n + 1)], [*range(-1, n - 1)]

        def look(i: int) -> None:
            j = after[i]
            found = pairs.get(sym[i] * width + sym[j]) if j < n else None
            rank[i] = found[0] if found else -1
            if found:
                heappush(heap, (found[0] << 40) | i)

        while heap:
            top = heappop(heap)
            i = top & ((1 << 40) - 1)
            if rank[i] != top >> 40:
                continue
            j = after[i]
            sym[i], after[i] = pairs[sym[i] * width + sym[j]][1], after[j]
            rank[j] = -1
            if after[i] < n:
                before[after[i]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        out, i = [], 0
        while i < n:
            out.append(sym[i])
            i = after[i]
        return np.array(out, dtype=np.int64)

    def ids(self, symbols: np.ndarray) -> list[int]:
        """Vocabulary ids; a code point outside the vocabulary becomes its UTF-8 bytes' pieces."""
        out: list[int] = []
        for s in symbols.tolist():
            if s < self.base:
                out.append(s)
            elif self.byte_id:
                out += [self.byte_id[b] for b in chr(s - self.base).encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unk)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids, with the mark of a text's start still in place as a space."""
        parts, raw = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            parts.append("" if i in self.control else self.text[i])
        if raw:
            parts.append(raw.decode("utf-8", "replace"))
        return "".join(parts).replace(MARK, " ")


class Codec:
    """Encodes texts word by word, with a bounded memory of distinct words."""

    def __init__(self, path: str):
        self.table = PieceTable(path)
        self.number = [str(i) for i in range(self.table.base)]
        self.known: dict[str, tuple[str, int, str]] = {}

    def words(self, text: str) -> list[str]:
        """Marked words without their first mark; their concatenation (each with a mark before) is the text."""
        if not text:
            return []
        parts = text.split(" ")
        if "" in parts or MARK in text:
            marked = _WORD.findall(MARK + text.replace(" ", MARK))
            parts = [w[1:] if w[0] == MARK else None for w in marked]  # only the first could lack a mark; it has one
        return parts

    def learn(self, words: set[str]) -> None:
        if new := [w for w in words if w not in self.known]:
            base, number, text = self.table.base, self.number, self.table.text
            for w, symbols in zip(new, self.table.merge([MARK + w for w in new]), strict=True):
                ids = symbols.tolist()
                if max(ids) < base:  # pieces only, no bytes
                    self.known[w] = (",".join([number[i] for i in ids]), len(ids), "".join([text[i] for i in ids]).replace(MARK, " "))
                else:
                    ids = self.table.ids(symbols)
                    self.known[w] = (",".join([number[i] for i in ids]), len(ids), self.table.decode(ids))

    def forget(self) -> None:
        if len(self.known) > _KEEP_WORDS:
            self.known.clear()
        else:
            for w in [w for w in self.known if len(w) > _KEEP_CHARS]:
                del self.known[w]

    def encode(self, texts: list[str | None], chunk: int = 800_000) -> list[tuple[str, int, str]]:
        """(ids joined by commas, number of ids, decoded text) of each text; texts of some chunk characters at a time."""
        out, at = [], 0
        while at < len(texts):
            some, chars = [], 0
            while at < len(texts) and (not some or chars < chunk):
                some.append(self.words(texts[at] or ""))
                chars += len(texts[at] or "")
                at += 1
            self.learn(set().union(*some))
            for ws in some:
                got = [self.known[w] for w in ws]
                out.append((",".join([g[0] for g in got]), sum([g[1] for g in got]), "".join([g[2] for g in got])[1:]))
            self.forget()
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for all tasks of a Python worker."""
    return Codec(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Encode and decode whole texts: id, n_tokens, ids (comma-joined), decoded, and the digests of both.

    ``texts=False`` leaves out the two long columns. One narrow pass, no shuffle."""
    import hashlib

    text_batches(docs.sparkSession)
    fields = [docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if texts:
        fields += [T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())]

    def run(batches):
        c = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = c.encode(part.column(1).to_pylist())
                cols = [
                    part.column(0),
                    pa.array([n for _, n, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _, _ in got], pa.string()),
                    pa.array([hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() for _, _, text in got], pa.string()),
                ]
                if texts:
                    cols += [pa.array([x[0] for x in got], pa.string()), pa.array([x[2] for x in got], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])
        c.known.clear()  # the worker goes on to other tasks

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))
