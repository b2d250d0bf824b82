"""Approximate nearest neighbours by low-dimensional stable projections indexed with kd-trees.

Unit vectors are projected on ``dims`` Gaussian (2-stable) directions. If a candidate lies at distance d, its projected
squared distance divided by d^2 follows a chi-square law with ``dims`` degrees of freedom. A search takes candidates
in the order of their projected distance from a kd-tree, verifies each on the original vectors and stops as
soon as the chi-square test says that a vector nearer than the k-th found would have come up by now with probability
``confidence`` (the documented recall target of each search).

Vectors are cut into cells by the top of a kd-tree, which is fitted on at most ``sample`` projected vectors; every vector is
indexed in its cell. Cells that are still over-full are cut further, each by the medians of a bounded sample of its own, level
by level in one grouped pass each, so cells stay small however many vectors there are. Each query first searches its own
cell; its k-th distance there bounds the projected radius, and only cells whose vectors' bounds the radius reaches are searched
then.
Equal vectors are indexed once with their k + 1 smallest ids (more can't be among k neighbours), and searched once.

Nearness is the cosine in double precision, computed from the original vectors; ties go to the smaller id. Vectors that are null,
empty, zero, of another length than most or hold a null or non-finite component take no part; rows with a null id neither. Of rows
that repeat an id and a vector one counts. An empty table gives no rows; columns other than the id and the vector are ignored, whatever
their names.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import checkpointed


#: Bits of the cells that an over-full cell is cut into at once, and how often cells may be cut.
SPLIT, LEVELS = 8, 6


def chi_square(x: float, dims: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < p else (low, mid)
    return high


class KdTree:
    """Median splits on the widest dimension; leaves of at most ``leaf`` points with their bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = 256):
        self.points, self.nodes = points, []
        self.order = np.arange(len(points))
        self._build(0, len(points), leaf)

    def _build(self, lo: int, hi: int, leaf: int) -> int:
        own = self.points[self.order[lo:hi]]
        low, high = own.min(axis=0), own.max(axis=0)
        me = len(self.nodes)
        self.nodes.append([low, high, lo, hi, -1, -1])
        d = int(np.argmax(high - low))
        if hi - lo > leaf and high[d] > low[d]:
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, d], mid)]
            self.nodes[me][4] = self._build(lo, lo + mid, leaf)
            self.nodes[me][5] = self._build(lo + mid, hi, leaf)
        return me

    def incremental(self, q: np.ndarray):
        """(squared projected distance that all later ones reach, positions of a leaf's points), nearest leaves first."""
        heap = [(0.0, 0)]
        while heap:
            bound, i = heapq.heappop(heap)
            low, high, lo, hi, left, right = self.nodes[i]
            if left < 0:
                yield bound, self.order[lo:hi]
                continue
            for child in (left, right):
                gap = np.maximum(0.0, np.maximum(self.nodes[child][0] - q, q - self.nodes[child][1]))
                heapq.heappush(heap, (float(gap @ gap), child))


def search(tree: KdTree, unit: np.ndarray, q: np.ndarray, q_projected: np.ndarray, k: int, stop: float, within: float) -> list[int]:
    """Positions of candidates for the k nearest by distance of unit vectors; ``within``: the k-th squared distance known so far."""
    best: list[float] = []  # negated squared distances
    found: list[tuple[float, int]] = []
    limit = within
    for bound, at in tree.incremental(q_projected):
        if bound >= stop * limit:
            break
        gap = tree.points[at] - q_projected
        at = at[np.einsum("ij,ij->i", gap, gap) < stop * limit] if np.isfinite(limit) else at
        if not len(at):
            continue
        distance = 2.0 - 2.0 * (unit[at] @ q)
        for d, i in zip(np.maximum(distance, 0.0).tolist(), at.tolist(), strict=True):
            if d <= limit * (1 + 1e-9) + 1e-12:
                found.append((d, i))
                heapq.heappush(best, -d)
                if len(best) > k:
                    heapq.heappop(best)
                if len(best) == k:
                    limit = min(limit, -best[0])
    edge = limit * (1 + 1e-9) + 1e-12
    return [i for d, i in found if d <= edge]


class Cells:
    """The top of a kd-tree over a sample of projected vectors: split dimensions and values of 2^depth cells."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, dims = depth, sample.shape[1]
        self.dim = np.zeros(2**depth, dtype=np.int64)
        self.cut = np.zeros(2**depth)
        self.low = np.full((2 ** (depth + 1), dims), -np.inf)
        self.high = np.full((2 ** (depth + 1), dims), np.inf)
        parts = {1: sample}
        for node in range(1, 2**depth):
            own = parts.pop(node)
            d = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(own) else 0
            cut = float(np.median(own[:, d])) if len(own) else 0.0
            self.dim[node], self.cut[node] = d, cut
            for child, some in ((2 * node, own[own[:, d] <= cut]), (2 * node + 1, own[own[:, d] > cut])):
                parts[child] = some
                self.low[child], self.high[child] = self.low[node], self.high[node]
            self.high[2 * node, d] = cut
            self.low[2 * node + 1, d] = cut

    def of(self, projected: np.ndarray) -> np.ndarray:
        node = np.ones(len(projected), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (projected[np.arange(len(node)), self.dim[node]] > self.cut[node])
        return node

    def reached(self, q: np.ndarray, radius2: float) -> np.ndarray:
        leaves = np.arange(2**self.depth, 2 ** (self.depth + 1))
        gap = np.maximum(0.0, np.maximum(self.low[leaves] - q, q - self.high[leaves]))
        return leaves[np.einsum("ij,ij->i", gap, gap) <= radius2]


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), x.shape[1]).cast(pa.list_(pa.float64()))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Double-precision cosines of rows with one vector; each row's sums are made alike, so equal rows score the same."""
    return np.array([float(np.dot(r, q)) for r in x]) / (np.array([math.sqrt(float(np.dot(r, r))) for r in x]) * math.sqrt(float(np.dot(q, q))))


def nearest(vectors: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 8, confidence: float = 0.99, sample: int = 20_000, block: int = 4096, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose id is divisible by ``query_every``, against all other rows."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), v.cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & fine)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return vectors.sparkSession.createDataFrame([], schema)
    n = lengths[0]["n"]
    rows = rows.filter(F.size("v") == n).distinct()
    # each distinct vector once, with its smallest ids; partial limits apply before the shuffle
    few = rows.withColumn("nth", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("nth") <= k + 1)
    points = checkpointed(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("p", F.element_at("ids", 1)))
    count = points.count()
    planes = np.random.Generator(np.random.Philox(seed)).standard_normal((n, dims))
    stop = chi_square_quantile(confidence, dims)

    drawn = points.orderBy(F.xxhash64("p"), "p").limit(sample).select("v").toArrow()
    projected = _unit(_matrix(drawn.column("v"))) @ planes
    depth = max(0, min(int(math.log2(max(1, len(projected) / 16))), math.ceil(math.log2(max(1, count / block)))))
    cells = Cells(projected, depth)

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                projected = _unit(_matrix(batch.column(1))) @ planes
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cells.of(projected)), _lists(projected)], ["p", "v", "ids", "top", "proj"])

    def splits_of(table: pa.Table) -> pa.Table:
        """The cuts of one over-full cell, into as many cells as its rows need and its sample allows."""
        n, own = table.column("n")[0].as_py(), _matrix(table.column("proj"))
        depth = max(1, min(SPLIT, math.ceil(math.log2(n / block)), int(math.log2(max(2, len(own) / 16)))))
        part = Cells(own, depth)
        return pa.table({"cell": table.column("cell").slice(0, 1), "depth": pa.array([depth], pa.int32()), "dim": pa.array([part.dim.tolist()], pa.list_(pa.int32())), "cut": pa.array([part.cut.tolist()], pa.list_(pa.float64()))})

    def deepened(df: DataFrame, splits: DataFrame) -> DataFrame:
        """cell becomes the cell on the next level."""
        step = lambda node, _: 2 * node + (F.get("proj", F.get("dim", node)) > F.get("cut", node)).cast("int")
        sub = F.aggregate(F.sequence(F.lit(1), "depth"), F.lit(1), step) - F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth"))
        deep = df.join(splits, "cell", "left").withColumn("cell", F.shiftleft("cell", SPLIT) + F.coalesce(sub, F.lit(0)))
        return deep.select(*df.columns)

    index = checkpointed(points.select("p", "v", "ids").mapInArrow(placed, "p long, v array<double>, ids array<long>, top long, proj array<double>").withColumn("cell", F.col("top")))
    levels: list[DataFrame] = []
    for _ in range(LEVELS):
        full = checkpointed(index.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * block))
        if full.isEmpty():
            break
        drawn = index.select("cell", "p", "proj").join(full, "cell").withColumn("nth", F.row_number().over(W.partitionBy("cell").orderBy(F.xxhash64("p"), "p"))).filter(F.col("nth") <= 16 << SPLIT)
        levels.append(checkpointed(drawn.select("cell", "n", "proj").groupBy("cell").applyInArrow(splits_of, "cell long, depth int, dim array<int>, cut array<double>")))
        index = checkpointed(deepened(index, levels[-1]))
    # what can't be cut (equal projections) is dealt to blocks
    sizes = index.groupBy("cell").agg(F.greatest(F.lit(1), F.floor(F.count("*") / (2 * block))).cast("int").alias("blocks"))
    index = checkpointed(index.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("p"), F.col("blocks")).cast("int")))
    bounds = [F.array(*(f(F.get("proj", F.lit(i))) for i in range(dims))).alias(name) for name, f in (("low", F.min), ("high", F.max))]
    sizes = checkpointed(index.groupBy("cell", "block").agg(F.min("top").alias("top"), F.max("blocks").alias("blocks"), *bounds))

    asked = rows.filter(F.col("id") % query_every == 0).groupBy("v").agg(F.min("id").alias("q")).select("q", F.col("v").alias("qv"))

    def homes(batches):
        for batch in batches:
            if batch.num_rows:
                projected = _unit(_matrix(batch.column(1))) @ planes
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells.of(projected)), _lists(projected)], ["q", "qv", "cell", "proj"])

    def reaching(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _unit(_matrix(batch.column(1))) @ planes
            far = batch.column(2).to_numpy(zero_copy_only=False)
            radius = np.where(np.isnan(far), np.inf, stop * far * (1 + 1e-9) + 1e-12)
            hit = [cells.reached(q[i], radius[i]) for i in range(len(q))]
            at = pa.array(np.repeat(np.arange(len(q)), [len(h) for h in hit]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(radius).take(at), _lists(q).take(at), pa.array(np.concatenate(hit))], ["q", "radius", "qp", "top"])

    def search_block(queries: pa.Table, data: pa.Table) -> pa.Table:
        out: dict[str, list] = {"q": [], "id": [], "score": [], "d": []}
        if queries.num_rows and data.num_rows:
            x, qs = _matrix(data.column("v")), _matrix(queries.column("qv"))
            unit, ids = _unit(x), data.column("ids").to_pylist()
            tree, far = KdTree(unit @ planes), queries.column("far").to_numpy()
            for q, name, known in zip(qs, queries.column("q").to_pylist(), far, strict=True):
                u = _unit(q[None])[0]
                got = search(tree, unit, u, u @ planes, k + 1, stop, np.inf if np.isnan(known) else known)
                scores, near = cosines(x[got], q), np.maximum(0.0, 2.0 - 2.0 * (unit[got] @ u))
                best = sorted(((-s, i, d) for s, own, d in zip(scores.tolist(), (ids[g] for g in got), near.tolist(), strict=True) for i in own))[: k + 1]
                for s, i, d in best:
                    for key, value in zip(out, (name, i, -s, d), strict=True):
                        out[key].append(value)
        return pa.table(out, schema=pa.schema([("q", pa.int64()), ("id", pa.int64()), ("score", pa.float64()), ("d", pa.float64())]))

    def searched(queries: DataFrame) -> DataFrame:
        kind = "q long, id long, score double, d double"
        dealt = queries.select("q", "qv", "far", F.col("cell").alias("qcell"), F.col("block").alias("qblock"))
        return dealt.groupBy("qcell", "qblock").cogroup(index.select("v", "ids", "cell", "block").groupBy("cell", "block")).applyInArrow(search_block, kind)

    first = asked.mapInArrow(homes, "q long, qv array<double>, cell long, proj array<double>").withColumn("far", F.lit(float("nan")))
    for splits in levels:
        first = deepened(first, splits)
    first = checkpointed(first.join(sizes.select("cell", "block", "blocks"), "cell").filter(F.col("block") == F.pmod(F.xxhash64("q"), F.col("blocks"))).select("q", "qv", "far", "cell", "block"))
    home = checkpointed(searched(first))
    # the (k + 1)-th distance at home: the query's own row is among the k + 1
    bound = home.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).groupBy("q").agg(F.count("*").alias("n"), F.max("d").alias("far"))
    bound = bound.select("q", F.when(F.col("n") > k, F.col("far")).alias("far"))
    second = asked.join(bound, "q", "left").select("q", "qv", F.coalesce("far", F.lit(float("nan"))).alias("far"))
    # of the cells below a reached one, those whose own vectors the radius reaches; vectors go along only with what is left
    gap = F.zip_with(F.zip_with("low", "qp", lambda x, q: F.greatest(x - q, F.lit(0.0))), F.zip_with("high", "qp", lambda x, q: F.greatest(q - x, F.lit(0.0))), lambda a, b: F.greatest(a, b))
    near = F.aggregate(gap, F.lit(0.0), lambda total, x: total + x * x) <= F.col("radius")
    reached = second.mapInArrow(reaching, "q long, radius double, qp array<double>, top long").join(sizes.select("top", "cell", "block", "low", "high"), "top").filter(near).select("q", "cell", "block")
    second = reached.join(first.select("q", "cell", "block"), ["q", "cell", "block"], "left_anti").join(second, "q")
    found = home.unionByName(searched(second)).select("q", "id", "score").distinct()
    top = found.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("nth") <= k + 1).drop("nth")
    # every query id of an equal vector, without itself
    owners = rows.filter(F.col("id") % query_every == 0).select(F.col("id").alias("query_id"), F.col("v").alias("qv")).join(asked, "qv").select("query_id", "q")
    final = owners.join(top, "q").filter("query_id <> id")
    ranked = final.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
