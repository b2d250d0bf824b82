"""N-gram Jaccard self-join by universe partition and the pigeonhole principle; exact.

Documents' sets are their distinct shingles of five words. Two sets with 100 * intersection >= 75 * union differ in at
most H = (|x| + |y|) / 7 shingles. Within a band of sizes, all shingles are dealt by hash to more than H segments, so
H differences leave a segment in which both sets are equal: equal segments make two sets candidates. A set needs H + 1
segments that count:

* Empty segments are not indexed. A set with fewer than H + 1 others also indexes its segments' one-deletion
  neighbourhoods (a segment is then worth two), and its single shingles if even that falls short.
* Cost-based allocation: a segment that over HOT classes share is left out by every set that has enough others; a pair is
  lost only if both sets lack them, so only those sets meet in such a segment.
* Sets below SMALL shingles take each shingle for a segment of its own.

Candidates pass exact lower bounds (sizes, then parity bitmaps), and the rest are verified on the sets made anew from the
texts. Copies of a set are one class from the first shuffle on. As the result is components, classes are first compared with
one of their segment, and those of a small segment that are still apart with each other. The classes of a hot segment form a family with
the one that has most hot segments; a family that is still apart is dealt to parts, and each two parts are compared by
the postings of their shingles, which gives links (no more than connect the classes), never pairs.

Shingles are known by 64-bit hashes, sets and classes by 128 bits; candidates are found by the first 64 of these.

Null, empty or blank texts have no shingles and link with nothing. Rows with a null id link as others do; component_id is null if no
row of their component has an id. Repeated rows give repeated rows, and an id may stand before different texts. An empty
table gives no rows. Texts of any length are taken whole. Extra columns are ignored, whatever their names, but for those that
``grouped`` is told to keep.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import checkpointed
from corvane.session import text_batches

SHINGLE, NUM, DEN = 5, 75, 100
SMALL, HOT = 64, 8
#: Ids of texts to verify that may be broadcast; more of them are joined by shuffle.
FEW = 1_000_000
#: Shingles of a family's part; two parts are compared in one group.
ROOM = 400_000
_U = np.uint64
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    known = _words()
    if len(known) > 100_000:
        known.clear()
    w = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(w) >= SHINGLE:
        n = len(w) - SHINGLE + 1
        s = w[:n] * _MULT[0]
        for k in range(1, SHINGLE):
            s = s + mix(w[k : k + n] + _U(k)) * _MULT[k]
        return np.unique(mix(s))
    if not len(w):
        return w
    return mix(np.array([(int((w * _MULT[: len(w)]).sum(dtype=np.uint64)) + len(w)) & (2**64 - 1)], dtype=np.uint64))


def class_of(s: np.ndarray) -> bytes:
    """A set's class: 128 bits of hash."""
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def short_of(cls: bytes) -> int:
    """The first half of a class's hash."""
    return int.from_bytes(cls[:8], "big", signed=True)


def short_column(cls: str) -> Column:
    """short_of as a column: the sign and the other 63 bits in two halves."""
    half = lambda at: F.conv(F.hex(F.substring(cls, at, 4)), 16, 10).cast("long")
    return F.when(half(1) >= 1 << 31, half(1) - (1 << 32)).otherwise(half(1)) * (1 << 32) + half(5)


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the number of shingles that fall on each bit; at least one bit for each shingle."""
    bits = 64
    while bits < len(s) and bits < 1 << 20:
        bits *= 2
    return np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both) > 0


@lru_cache(maxsize=1)
def bands() -> np.ndarray:
    """Lower ends of the bands of sizes; the scheme of band k is number k + 1, that of small sets 0."""
    ends = [SMALL]
    while ends[-1] < 1 << 40:
        ends.append(ends[-1] * 3 // 2)
    return np.array(ends, dtype=np.int64)


def keys_of(s: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(scheme, slack, keys) of a set in each scheme it takes part in; slack: segments beyond those it needs."""
    n, out, ends = len(s), [], bands()
    most = n * DEN // NUM
    if -(-n * NUM // DEN) < SMALL:
        need = (n + min(most, SMALL * DEN // NUM)) * (DEN - NUM) // (DEN + NUM) + 1
        out.append((0, n - need, mix(s + _U(1))))
    if n < SMALL:
        return out
    own = int(np.searchsorted(ends, n, side="right")) - 1
    for k in (own, own + 1):
        if k > own and most < ends[k]:
            continue
        top = int(ends[k + 1])
        need = (n + min(most, top - 1)) * (DEN - NUM) // (DEN + NUM) + 1
        m = math.ceil(0.4 * top)
        segment = ((s >> _U(13)) % _U(m)).astype(np.int64)
        size = np.bincount(segment, minlength=m)
        total = np.bincount(segment, weights=(s & _U(0xFFFFFFFF)).astype(np.float64), minlength=m).astype(np.uint64)
        total += np.bincount(segment, weights=(s >> _U(32)).astype(np.float64), minlength=m).astype(np.uint64) << _U(32)
        used = np.flatnonzero(size)
        salt, near, alone = (_U(((k + 1) * int(_MULT[2]) + x) & (2**64 - 1)) for x in (0, int(_MULT[3]), int(_MULT[4])))
        keys = [mix(total[used] + used.astype(np.uint64) * _MULT[1] + salt)]
        if len(used) < need:
            keys.append(mix(total[used] + used.astype(np.uint64) * _MULT[1] + near))
            pairs = size[segment] >= 2
            keys.append(mix(total[segment[pairs]] - s[pairs] + segment[pairs].astype(np.uint64) * _MULT[1] + near))
            if len(used) + int((size >= 2).sum()) < need:
                keys.append(mix(s + alone))
        out.append((k + 1, len(used) - need, np.concatenate(keys)))
    return out


def profile(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, n_shingles, cls (null without shingles), bits."""
    text_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(docs.schema[c] for c in keep)])
    schema = schema.add("n_shingles", "long").add("cls", "binary").add("bits", "binary")
    others = [0, *range(2, 2 + len(keep))]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, cls, bits = [], [], []
                for text in part.column(1):
                    s = shingle_set(text.as_py())
                    n.append(len(s))
                    cls.append(class_of(s) if len(s) else None)
                    bits.append(bitmap(s) if len(s) else None)
                cols = [pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in others), *cols], schema.names)

    return docs.select(id_col, text_col, *keep).mapInArrow(run, schema)


def signatures(docs: DataFrame, text_col: str, buckets: int, most: int, keys_at_once: int = 1_000_000, spread: int = 256) -> DataFrame:
    """bucket, part and, packed, their share of some hundred thousand keys: for each class and scheme (cls, scheme, slack) how many keys
    follow, and 32 bits of each key (its bucket is the rest). Each class once a task.

    Part 0 of a bucket has all keys but those that over ``spread`` classes share among those: of these it has
    most + 1 members, so that it knows them for hot, and the others go to parts of their own. So a bucket never holds
    all members of a very hot key."""
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("bucket", "part")] + [T.StructField(c, T.BinaryType()) for c in ("cls", "scheme", "slack", "n", "keys")])
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]

    def packed(entries: list[tuple[int, int, int, np.ndarray]], part: int):
        cls, scheme, slack, keys = zip(*entries, strict=True)
        cls, scheme, slack = np.array(cls, dtype=np.int64), np.array(scheme, dtype=np.int16), np.array(slack, dtype=np.int32)
        row = np.repeat(np.arange(len(keys), dtype=np.int32), [len(x) for x in keys])
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])]
        key, row = key[fresh], row[fresh]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        apart = np.repeat(size > spread, size) & (np.arange(len(key)) - np.repeat(start, size) > most)
        bucket = (key >> _U(32)) % _U(buckets)
        order = np.lexsort((row, bucket, apart))
        row, key, bucket, apart = row[order], (key[order] & _U(0xFFFFFFFF)).astype(np.uint32), bucket[order], apart[order]
        place = bucket.astype(np.int64) * 2 + apart
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
        of, n = row[first], np.diff(np.r_[first, len(key)]).astype(np.int32)
        top = np.flatnonzero(np.r_[True, place[first[1:]] != place[first[:-1]]])  # of the entries, the first of each place
        out: list[list] = [[] for _ in range(7)]
        for lo, hi in zip(top, np.r_[top[1:], len(first)], strict=True):
            at = of[lo:hi]
            last = first[hi] if hi < len(first) else len(key)
            where = int(bucket[first[lo]]), part if apart[first[lo]] else 0
            for column, x in zip(out, (*where, cls[at].tobytes(), scheme[at].tobytes(), slack[at].tobytes(), n[lo:hi].tobytes(), key[first[lo] : last].tobytes()), strict=True):
                column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], schema.names)

    def run(batches):
        from pyspark import TaskContext

        seen: set[bytes] = set()
        entries, size, chunk = [], 0, 0
        for batch in batches:
            for text in batch.column(0):
                s = shingle_set(text.as_py())
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                seen.add(c)
                for k, spare, some in keys_of(s):
                    entries.append((short_of(c), k, spare, some))
                    size += len(some)
                if size >= keys_at_once:
                    yield packed(entries, 1 + hash((TaskContext.get().partitionId(), chunk)) % (1 << 30))
                    entries, size, chunk = [], 0, chunk + 1
                    if len(seen) > 200_000:
                        seen.clear()
        if entries:
            yield packed(entries, 1 + hash((TaskContext.get().partitionId(), chunk)) % (1 << 30))

    return docs.select(text_col).mapInArrow(run, schema)


def flat(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers that a column of bytes holds, one row's after another's."""
    whole = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    ends = np.frombuffer(whole.buffers()[1], dtype=np.int32)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else [0, 0]
    return np.frombuffer(memoryview(whole.buffers()[2])[ends[0] : ends[-1]], dtype=kind) if ends[-1] > ends[0] else np.zeros(0, kind)


def meeting(signed: DataFrame, most: int, chunk: int = 4096) -> DataFrame:
    """What meets in equal keys: kind 0 (members of a key that at most ``most`` classes share), kind 1 (gid: a hot key; up to ``chunk`` of its
    members), kind 2 (cls, scheme, hot: how many of a class's keys are hot, slack)."""
    schema = T.StructType().add("kind", "integer").add("gid", "long").add("members", T.ArrayType(T.LongType())).add("cls", "long").add("scheme", "integer").add("hot", "integer").add("slack", "integer")

    def run(table: pa.Table) -> pa.Table:
        bucket, always = table.column("bucket")[0].as_py(), table.column("part")[0].as_py() > 0
        cls, scheme, slack, n, key = (flat(table.column(c), t) for c, t in (("cls", np.int64), ("scheme", np.int16), ("slack", np.int32), ("n", np.int32), ("keys", np.uint32)))
        names, dense = np.unique(cls, return_inverse=True)
        row = np.repeat(np.arange(len(cls), dtype=np.int32), n)
        both = key.astype(np.uint64)
        both <<= _U(32)
        both |= dense.astype(np.uint32)[row]
        order = np.argsort(both)
        both, row = both[order], row[order]
        del order
        fresh = np.r_[True, both[1:] != both[:-1]]
        both, row = both[fresh], row[fresh]
        member = both.astype(np.uint32)
        key = (both >> _U(32)).astype(np.uint32)
        del both, fresh
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        is_hot = np.full(len(size), True) if always else size > most
        # few: groups of the same members are one
        few = np.flatnonzero(~is_hot & (size >= 2))
        ident = np.add.reduceat(mix(names.view(np.uint64))[member], start) if len(start) else np.zeros(0, np.uint64)
        few = few[np.unique(ident[few] + size[few].astype(np.uint64), return_index=True)[1]]
        # hot: rows of at most ``chunk`` members
        hot = np.flatnonzero(is_hot)
        parts = -(-size[hot] // chunk)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        lows = np.r_[start[few], np.repeat(start[hot], parts) + nth * chunk]
        sizes = np.r_[size[few], np.minimum(chunk, np.repeat(size[hot], parts) - nth * chunk)].astype(np.int64)
        ends = np.r_[0, np.cumsum(sizes)]
        at = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes) + np.repeat(lows, sizes)
        members = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names[member[at.astype(np.int64)]], pa.int64()))
        gid = (np.int64(bucket) << np.int64(32)) | np.repeat(key[start[hot]], parts).astype(np.int64)
        many = np.bincount(row[np.repeat(is_hot, size)], minlength=len(cls))
        some = np.flatnonzero(many)
        g, h = len(sizes), len(some)
        none = lambda n, t: pa.nulls(n, t)
        cols = {
            "kind": pa.array(np.r_[np.zeros(len(few)), np.ones(len(gid)), np.full(h, 2)].astype(np.int32)),
            "gid": pa.chunked_array([none(len(few), pa.int64()), pa.array(gid, pa.int64()), none(h, pa.int64())]),
            "members": pa.chunked_array([members, none(h, pa.list_(pa.int64()))]),
            "cls": pa.chunked_array([none(g, pa.int64()), pa.array(cls[some], pa.int64())]),
            "scheme": pa.chunked_array([none(g, pa.int32()), pa.array(scheme[some].astype(np.int32))]),
            "hot": pa.chunked_array([none(g, pa.int32()), pa.array(many[some].astype(np.int32))]),
            "slack": pa.chunked_array([none(g, pa.int32()), pa.array(slack[some])]),
        }
        return pa.table(cols)

    return signed.groupBy("bucket", "part").applyInArrow(run, schema)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node it is connected to), by alternating large and small stars.

    A star hangs the neighbours of each node on the smallest among them: one shuffle, with a window over a node's
    edges, which spills where a node has many."""
    edges = checkpointed(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v"))
    low = F.min("v").over(W.partitionBy("u"))
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or (before is not None and (now["n"], now["h"]) == before):
            break
        before = (now["n"], now["h"])
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        large = both.withColumn("m", F.least(low, "u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", low).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = checkpointed(small.filter("u <> v").distinct())
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root")))).alias("e")).select("e.node", "e.root").distinct()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all folded to the smallest."""
    size, out = min(map(len, maps)), []
    for m in maps:
        x = np.frombuffer(m, dtype=np.uint8)
        while len(x) > size:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out.append(x)
    return np.stack(out).view(np.uint64)


def likely(pairs: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Pairs (a, b) of classes, given by ``key``, that neither their sizes nor their bitmaps rule out."""
    side = lambda x: classes.select(F.col(key).alias(x), F.col("cls").alias(f"cls_{x}"), F.col("n_shingles").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") * DEN >= F.greatest("n_a", "n_b") * NUM)

    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                both = folded([x.as_py(), y.as_py()])
                apart = int(np.bitwise_count(both[0] ^ both[1]).sum(dtype=np.int64))
                keep.append(apart * (DEN + NUM) <= int(n[i] + m[i]) * (DEN - NUM))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in (0, 1)], ["a", "b"])

    return sized.select("cls_a", "cls_b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a binary, b binary")


def texts_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, text): a text of each wanted class; if its id has more than one text, the others too."""
    ids = checkpointed(classes.select("cls", "doc_id").join(wanted.select("cls").distinct(), "cls", "left_semi"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    total, nulls = ids.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    known = ids.filter("doc_id IS NOT NULL")
    if total <= FEW:  # an id and a class for each: then texts that no pair needs aren't shuffled
        known = F.broadcast(known)
    texts = rows.join(known, "doc_id").select("cls", "text")
    if not nulls:
        return texts

    def run(batches):
        for batch in batches:
            sets = (shingle_set(t.as_py()) for t in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) if len(s) else None for s in sets], pa.binary()), batch.column(0)], ["cls", "text"])

    idless = rows.filter("doc_id IS NULL").select("text").mapInArrow(run, "cls binary, text string")
    return texts.unionByName(idless.join(ids.filter("doc_id IS NULL"), "cls", "left_semi").groupBy("cls").agg(F.min("text").alias("text")))


def sets_of(table: pa.Table) -> dict[bytes, np.ndarray]:
    """The set of each class in a table of (cls, text)."""
    sets = {}
    for c, t in zip(table.column("cls"), table.column("text"), strict=True):
        if (c := c.as_py()) not in sets:
            s = shingle_set(t.as_py())
            if class_of(s) == c:  # an id may have more than one text
                sets[c] = s
    return sets


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, group: int = 64) -> DataFrame:
    """The pairs whose sets, made anew from one text of each class, do link. Texts meet in groups of about ``group``
    pairs that share the class a; a class in more pairs has more groups."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / group).alias("salts"))
    salted = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    wanted = salted.select("a", "salt", F.col("b").alias("cls")).unionByName(salted.select("a", "salt", F.col("a").alias("cls")).distinct())
    rows = wanted.join(texts_of(wanted, classes, docs, id_col, text_col), "cls").select("a", "salt", "cls", "text")

    def run(table: pa.Table) -> pa.Table:
        lead, sets = table.column("a")[0].as_py(), sets_of(table)
        found = [c for c, s in sets.items() if c != lead and lead in sets and linked(sets[lead], s)]
        return pa.table({"a": pa.array([lead] * len(found), pa.binary()), "b": pa.array(found, pa.binary())})

    return rows.groupBy("a", "salt").applyInArrow(run, "a binary, b binary")


def links_within(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that join sets of different roots, as few as connect what is linked; side: 0 and 1 are only compared with
    each other, 2 with all.

    The postings of a set's shingles give its exact intersections with all others at once. Sets of rare roots go
    first, so the members of a large component need not be compared with each other."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(shingle, kind="stable")
    posting, first = owner[order], np.searchsorted(shingle[order], np.arange(shingle.max() + 2))
    begin = np.r_[0, np.cumsum(n)]
    root, out = root.copy(), []
    todo = np.argsort(np.bincount(root)[root], kind="stable")
    done = np.zeros(len(sets), dtype=bool)
    for i in todo:
        done[i] = True
        can = ~done & (root != root[i]) & ((side != side[i]) | (side == 2))
        if not can.any():
            continue
        own = shingle[begin[i] : begin[i + 1]]
        size = first[own + 1] - first[own]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[own], size)
        both = np.bincount(posting[at], minlength=len(sets))
        for j in np.flatnonzero(can & (DEN * both >= NUM * (n + n[i] - both)) & (both > 0)):
            if root[j] != root[i]:
                out.append((int(i), int(j)))
                root[root == root[j]] = root[i]
    return out


def linked_apart(families: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, room: int) -> DataFrame:
    """Links (a, b) between the classes of each family that differ in root: p, cls, root, n_shingles.

    A family is dealt to parts of about ``room`` shingles, each two parts meet in a group of their own, and a group
    gives no more links than connect its classes."""
    parts = families.groupBy("p").agg(F.ceil(F.sum("n_shingles") / room).cast("int").alias("parts"))
    dealt = families.join(parts, "p").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = checkpointed(dealt.select("p", F.least("part", "k").alias("i"), F.greatest("part", "k").alias("j"), "part", "cls", "root"))
    rows = dealt.join(texts_of(dealt, classes, docs, id_col, text_col), "cls").select("p", "i", "j", "part", "cls", "root", "text")

    def run(table: pa.Table) -> pa.Table:
        sets = sets_of(table)
        names = list(sets)
        where = {c: (r, p) for c, r, p in zip(table.column("cls").to_pylist(), table.column("root").to_pylist(), table.column("part").to_pylist(), strict=True)}
        found: list[tuple[int, int]] = []
        if len(names) > 1:
            dense: dict[bytes, int] = {}
            root = np.array([dense.setdefault(where[c][0], len(dense)) for c in names])
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            side = np.full(len(names), 2) if i == j else np.array([int(where[c][1] == j) for c in names])
            found = links_within([sets[c] for c in names], root, side)
        return pa.table({"a": pa.array([names[x] for x, _ in found], pa.binary()), "b": pa.array([names[y] for _, y in found], pa.binary())})

    return rows.groupBy("p", "i", "j").applyInArrow(run, "a binary, b binary")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), keys_per_bucket: int = 2_000_000, most: int = HOT, room: int = ROOM, spread: int = 256) -> DataFrame:
    """One row per input row: doc_id, the columns to keep, n_shingles, component_id, cls and lead (the class that leads its component:
    the one with its smallest id; both null without shingles)."""
    rows = checkpointed(profile(docs, id_col, text_col, keep))
    classes = rows.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"))
    classes = checkpointed(classes.withColumn("short", short_column("cls")))
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    met = checkpointed(meeting(signatures(docs, text_col, max(1, math.ceil(0.9 * total / keys_per_bucket)), most, spread=spread), most))

    few = met.filter("kind = 0").select("members").distinct()
    lacking = met.filter("kind = 2").groupBy("cls", "scheme").agg(F.sum("hot").alias("hot"), F.min("slack").alias("slack")).filter("hot > slack")
    lacking = lacking.groupBy(F.col("cls").alias("short")).agg(F.max("hot").alias("hot"))
    hot = met.filter("kind = 1").select("gid", F.explode("members").alias("short")).join(lacking, "short")
    pivots = hot.groupBy("gid").agg(F.max(F.struct("hot", "short")).alias("p"), F.count("*").alias("n")).filter("n > 1").select("gid", F.col("p.short").alias("p"))
    families = checkpointed(hot.join(pivots, "gid").select("p", "short").distinct())

    # each class with the leader of its groups
    leaders = few.select(F.element_at("members", 1).alias("a"), F.explode(F.slice("members", F.lit(2), F.size("members"))).alias("b"))
    leaders = leaders.unionByName(families.filter("p <> short").select(F.col("p").alias("a"), F.col("short").alias("b")))
    first = checkpointed(likely(leaders.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), classes, "short"))
    links = checkpointed(verified(first, classes, docs, id_col, text_col))

    # classes of a small group that are still apart, with each other
    root = checkpointed(components(links).withColumnsRenamed({"node": "cls"}))
    named = classes.select("short", "cls", "n_shingles").join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    apart = few.filter(F.size("members") > 2).select(F.xxhash64("members").alias("gid"), F.explode("members").alias("short")).join(named, "short")
    apart = apart.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.collect_list(F.struct("cls", "root")).alias("m")).filter("low <> high")
    across = lambda x: F.transform(F.filter("m", lambda y: (x["cls"] < y["cls"]) & (x["root"] != y["root"])), lambda y: F.struct(x["cls"].alias("a"), y["cls"].alias("b")))
    pairs = apart.select(F.explode(F.flatten(F.transform("m", across))).alias("e")).select("e.a", "e.b").distinct()
    known = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = checkpointed(likely(pairs.join(known, ["a", "b"], "left_anti"), classes, "cls"))
    links = checkpointed(links.unionByName(verified(rest, classes, docs, id_col, text_col)))

    # classes of a family that are still apart, with each other
    root = checkpointed(components(links).withColumnsRenamed({"node": "cls"}))
    named = classes.select("short", "cls", "n_shingles").join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    within = checkpointed(families.join(named, "short"))
    split = within.groupBy("p").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("p")
    more = checkpointed(linked_apart(within.join(split, "p", "left_semi").select("p", "cls", "root", "n_shingles"), classes, docs, id_col, text_col, room))
    links = more.unionByName(root.select(F.col("cls").alias("a"), F.col("root").alias("b")))

    root = checkpointed(components(links).withColumnsRenamed({"node": "cls"}))
    of = classes.select("cls", "doc_id").join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls")).alias("low"))
    of = of.select("cls", "root").join(lowest, "root").select("cls", F.col("low.doc_id").alias("component_id"), F.col("low.cls").alias("lead"))
    empty = rows.filter("cls IS NULL").select("doc_id", *keep, "n_shingles", F.col("doc_id").alias("component_id"), "cls", F.col("cls").alias("lead"))
    return rows.filter("cls IS NOT NULL").join(of, "cls").select(empty.columns).unionByName(empty)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links, its own included)."""
    return grouped(docs, id_col, text_col, **options).select("doc_id", "n_shingles", "component_id")
