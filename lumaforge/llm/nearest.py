"""Approximate nearest neighbours by inner product: stable projections, a kd-tree, and a chi-square stopping test.

Largest inner product is nearest Euclidean neighbour after one more component brings every vector to the same
length. Gaussian projections to ``PROJECTED`` dimensions are stable: the squared projected distance over the
squared true one follows a chi-square law. So once the next projected distance is so large that a point closer
than the k-th best so far would lie there with a probability below ``1 - CONFIDENCE``, a search may stop.

The top of the kd-tree is fitted on a bounded sample, and every vector is dealt into its cells; a cell that got
more rows than ``CELL_ROWS``, because of copies for instance, is split by a hash of the row. In a cell's task the
tree goes on to leaves of ``LEAF_ROWS``. A query first searches its own cell. The bound found there says which
other cells it must visit; their candidates are merged. The tree knows the first ``PROJECTED`` of ``WIDE`` projections. Leaves
are opened by rising distance of their boxes; the points of the open ones are verified with the original vectors, in full
precision, by rising distance in all ``WIDE`` projections, until the test on the next of them holds.

Vectors that are null, empty, zero or hold null or non-finite components take no part, neither do rows without an
id; rows repeated with id and vector count once, and different vectors with the same id are each a row, as candidates and
as queries, whose rows then bear the same ``query_id``; a vector is never a neighbour of its own id. Vectors are compared with those of the
same dimension. Ties go to the smaller id, which must be a whole number; another type is refused. An empty table gives an
empty result. Only the two named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaforge.llm.tables import stored

K = 20
#: Projections that the tree is built on, and those that points are tested by.
PROJECTED, WIDE = 8, 40
#: Of the test on boxes, and of that on points.
CONFIDENCE, POINT_CONFIDENCE = 0.97, 0.88
CELL_ROWS = 16_384
LEAF_ROWS = 32
#: Leaves opened first; each further step opens this many times as many, and verifies this many times as many points.
FIRST_LEAVES, GROWTH = 8, 4
#: Queries searched in one task, at most about.
QUERY_ROWS = 32_768
#: Vectors that the top of the tree is fitted on, at most.
SAMPLE_ROWS = 20_000
SEED = 10


def chi_square_quantile(p: float, freedom: int) -> float:
    """For an even number of degrees of freedom."""

    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(freedom // 2))

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def projection(dim: int) -> np.ndarray:
    """Gaussian directions for vectors of ``dim`` components and the one that is added."""
    return np.random.default_rng([SEED, dim]).normal(size=(dim + 1, WIDE))


def project(vectors: np.ndarray, longest: float, query: bool = False) -> np.ndarray:
    """Scaled by the longest vector's length; queries, whose own length does not matter, to length one."""
    norm2 = (vectors * vectors).sum(1)
    if query:
        scaled, rest = vectors / np.sqrt(norm2)[:, None], np.zeros(len(vectors))
    else:
        scaled = vectors / longest
        rest = np.sqrt(np.maximum(0, 1 - norm2 / longest**2))
    return np.column_stack([scaled, rest]) @ projection(vectors.shape[1])


def split_tree(points: np.ndarray, leaf: int) -> tuple[list, list[np.ndarray]]:
    """Nodes ``(axis, cut, left, right)`` or a leaf number, and the rows of each leaf."""
    nodes: list = []
    leaves: list[np.ndarray] = []

    def grow(rows: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(None)
        spread = np.ptp(points[rows], 0) if len(rows) else np.zeros(1)
        axis = int(spread.argmax())
        if len(rows) <= leaf or spread[axis] == 0:
            nodes[at] = len(leaves)
            leaves.append(rows)
            return at
        values = points[rows, axis]
        cut = float(np.median(values))
        if cut == values.max():  # many copies of the largest value
            cut = float(values[values < cut].max())
        nodes[at] = (axis, cut, grow(rows[values <= cut]), grow(rows[values > cut]))
        return at

    grow(np.arange(len(points)))
    return nodes, leaves


def locate(nodes: list, points: np.ndarray) -> np.ndarray:
    """The leaf number of every point."""
    out = np.empty(len(points), np.int64)
    stack = [(0, np.arange(len(points)))]
    while stack:
        at, rows = stack.pop()
        node = nodes[at]
        if isinstance(node, int):
            out[rows] = node
        else:
            axis, cut, left, right = node
            low = points[rows, axis] <= cut
            stack += [(left, rows[low]), (right, rows[~low])]
    return out


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d : d + 1]
        gap = np.maximum(0, np.maximum(low[:, d] - x, x - high[:, d]))
        out += gap * gap
    return out


class Cell:
    """One cell's vectors with the lower part of the tree, in the order of its leaves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        # Lengths are measured against the longest vector here, which leaves the smallest distances to tell apart.
        self.longest = float(np.sqrt((vectors * vectors).sum(1).max())) * (1 + 1e-12)
        points = project(vectors, self.longest)
        _, leaves = split_tree(points[:, :PROJECTED], LEAF_ROWS)
        order = np.concatenate(leaves)
        self.ids, self.vectors, self.points = ids[order], vectors[order], points[order]
        self.sizes = np.array([len(x) for x in leaves])
        self.low = np.array([points[x, :PROJECTED].min(0) for x in leaves])
        self.high = np.array([points[x, :PROJECTED].max(0) for x in leaves])
        self.box_limit, self.point_limit = chi_square_quantile(CONFIDENCE, PROJECTED), chi_square_quantile(POINT_CONFIDENCE, WIDE)
        self.verified = 0

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, bounds: np.ndarray):
        """For each query the ids and scores of its best ``k`` here; ``bounds``: scores below these are no use."""
        places = project(queries, self.longest, query=True)
        gaps = box_distances(places[:, :PROJECTED], self.low, self.high)
        scales = np.sqrt((queries * queries).sum(1)) * self.longest
        for i, q in enumerate(queries):
            found = _Best(k, bounds[i], scales[i])
            near, opened = np.argsort(gaps[i], kind="stable"), 0
            step = FIRST_LEAVES
            while opened < len(near):
                stop = min(int(np.searchsorted(gaps[i][near], found.reach(self.box_limit), side="right")), opened + step)
                if stop <= opened:
                    break
                mask = np.zeros(len(near), bool)
                mask[near[opened:stop]] = True
                opened, step = stop, step * GROWTH
                rows = np.flatnonzero(np.repeat(mask, self.sizes) & (self.ids != ids[i]))
                apart = self.points[rows] - places[i]
                self.verify(q, rows, np.einsum("ij,ij->i", apart, apart), found)
            exact = (self.vectors[found.rows] * q).sum(1)
            top = np.lexsort((self.ids[found.rows], -exact))[:k]
            yield self.ids[found.rows[top]], exact[top]

    def verify(self, q: np.ndarray, rows: np.ndarray, distances: np.ndarray, found: _Best) -> None:
        """Score rows by rising projected distance, until the next is so far that it is hardly among the best."""
        take = 4 * found.k
        while True:
            fit = distances <= found.reach(self.point_limit)
            rows, distances = rows[fit], distances[fit]
            if not len(rows):
                return
            if len(rows) > 2 * take:
                order = np.argpartition(distances, take)
                now, later = order[:take], order[take:]
            else:
                now, later = np.arange(len(rows)), np.empty(0, np.int64)
            found.add(rows[now], self.vectors[rows[now]] @ q)
            self.verified += len(now)
            rows, distances, take = rows[later], distances[later], take * GROWTH


class _Best:
    """Rows that may be among the best ``k`` of a query."""

    def __init__(self, k: int, bound: float, scale: float):
        self.k, self.best, self.scale = k, bound, scale
        self.rows, self.scores = np.empty(0, np.int64), np.empty(0)
        # Rounding of a product depends on its block; near the edge more are kept for the exact measure.
        self.slack = 1e-9 * scale

    def reach(self, limit: float) -> float:
        """The squared projected distance that a better point exceeds with small probability."""
        return max(0.0, 2 - 2 * self.best / self.scale) * limit if self.best > -np.inf else np.inf

    def add(self, rows: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.best - self.slack
        self.rows, self.scores = np.concatenate([self.rows, rows[good]]), np.concatenate([self.scores, scores[good]])
        if len(self.rows) >= self.k:
            self.best = max(self.best, np.partition(self.scores, -self.k)[-self.k])
            keep = self.scores >= self.best - self.slack
            self.rows, self.scores = self.rows[keep], self.scores[keep]


def usable(rows: DataFrame, is_query: Column, key: str, vector: str) -> DataFrame:
    """``id, v, q, dim`` of the vectors that take part, in double precision; ``q`` marks queries."""
    if rows.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{key} must be a whole number")
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    query = F.coalesce(is_query, F.lit(False)).alias("q")
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), query)
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))
    return rows.withColumn("dim", F.size("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column if isinstance(column, pa.Array) else column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _split_dims(batch: pa.RecordBatch):
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


def search(embeddings: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row with ``is_query``, which may use ``key``."""
    spark = embeddings.sparkSession
    rows = usable(embeddings, is_query, key, vector)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    found = rows.groupBy("dim").agg(F.count("id"), F.max(length), F.count_if("q")).collect()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = {r[0]: (r[1], r[2] * (1 + 1e-12)) for r in found}
    query_blocks = -(-max(r[3] for r in found) // QUERY_ROWS) or 1

    total = sum(n for n, _ in sizes.values())
    share = min(1.0, SAMPLE_ROWS / total)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(SAMPLE_ROWS).toArrow().combine_chunks()
    trees: dict[int, tuple[list, int]] = {}
    first_cell = 0
    for dim, (n, longest) in sorted(sizes.items()):
        at = np.flatnonzero(sample.column("dim").to_numpy() == dim)
        points = project(_matrix(sample.column("v").take(pa.array(at)).combine_chunks()), longest) if len(at) else np.empty((0, WIDE))
        nodes, leaves = split_tree(points[:, :PROJECTED], max(1, int(CELL_ROWS / 2 * len(at) / n)))
        trees[dim] = nodes, first_cell
        first_cell += len(leaves)
    shared = spark.sparkContext.broadcast((trees, sizes))

    def assign(batches):
        trees, sizes = shared.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for dim, at in _split_dims(batch):
                part = batch.take(pa.array(at))
                points = project(_matrix(part.column("v")), sizes[dim][1])[:, :PROJECTED]
                nodes, first = trees[dim]
                cell = first + locate(nodes, points)
                columns = [part.column("id"), part.column("v"), pa.array(cell), part.column("q")]
                columns.append(pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), PROJECTED).cast(pa.list_(pa.float64())))
                columns.append(pa.array(row + np.arange(len(at))))
                row += len(at)
                yield pa.RecordBatch.from_arrays(columns, ["id", "v", "cell", "q", "p", "row"])

    # Repeated rows become one, and what is left is numbered, so that vectors with the same id stay apart.
    once = rows.groupBy("id", "v").agg(F.max("q").alias("q")).select("id", "v", "q", F.size("v").alias("dim"))
    placed = stored(once.mapInArrow(assign, "id long, v array<double>, cell long, q boolean, p array<double>, row long"), "cells")

    # One row per cell: at most total / CELL_ROWS times a small factor, or as many as the sample allows.
    extent = [f(F.col("p")[d]).alias(f"{name}{d}") for name, f in (("lo", F.min), ("hi", F.max)) for d in range(PROJECTED)]
    cells = placed.groupBy("cell").agg(F.count("id").alias("n"), F.first(F.size("v")).alias("dim"), *extent).toPandas()
    cells = cells.sort_values("cell").reset_index(drop=True)
    splits = np.ceil(cells["n"].to_numpy() / CELL_ROWS).astype(np.int64)
    low = cells[[f"lo{d}" for d in range(PROJECTED)]].to_numpy()
    high = cells[[f"hi{d}" for d in range(PROJECTED)]].to_numpy()
    layout = spark.sparkContext.broadcast((cells["cell"].to_numpy(), cells["dim"].to_numpy(), splits, low, high, sizes))
    limit = chi_square_quantile(CONFIDENCE, PROJECTED)

    table = spark.createDataFrame([(int(c), int(n)) for c, n in zip(cells["cell"], splits)], "cell long, splits int")
    located = placed.join(F.broadcast(table), "cell")
    # A group is one part of a cell with one block of queries, so both sides are bounded.
    vectors = located.select(
        "cell", F.pmod(F.xxhash64("row"), "splits").cast("int").alias("split"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("block"), "id", "v",
    )
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(query_blocks)).cast("int").alias("block")
    queries = located.where("q").select("row", "id", "v", "cell", "splits", block)

    def inside(left: pa.Table, right: pa.Table) -> pa.Table:
        """Best candidates of one cell part for the queries sent to it."""
        out = []
        if left.num_rows and right.num_rows:
            cell = Cell(left.column("id").to_numpy(), _matrix(left.column("v").combine_chunks()))
            q = _matrix(right.column("w").combine_chunks())
            ids, numbers = right.column("query").to_numpy(), right.column("number").to_numpy()
            for i, (found, scores) in enumerate(cell.search(ids, q, k, right.column("bound").to_numpy())):
                out.append((np.full(len(found), numbers[i]), np.full(len(found), ids[i]), found, scores))
        none = np.empty(0, np.int64)
        number, ids, found, scores = (np.concatenate(x) for x in zip(*out)) if out else (none, none, none, np.empty(0))
        return pa.table({"row": pa.array(number), "query_id": pa.array(ids), "vec_id": pa.array(found), "score": pa.array(scores)})

    schema = "row long, query_id long, vec_id long, score double"

    group = ["cell", "split", "block"]

    def searched(asked: DataFrame) -> DataFrame:
        asked = asked.toDF("to_cell", "to_split", "to_block", "number", "query", "w", "bound")
        return vectors.groupBy(*group).cogroup(asked.groupBy("to_cell", "to_split", "to_block")).applyInArrow(inside, schema)

    own = queries.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).withColumn("bound", F.lit(float("-inf")))
    first = stored(best(searched(own.select(*group, "row", "id", "v", "bound")), k), "own")
    reached = first.groupBy("row").agg(F.when(F.count("vec_id") >= k, F.min("score")).alias("bound"))

    def visit(batches):
        numbers, dims, splits, low, high, sizes = layout.value
        for batch in batches:
            for dim, at in _split_dims(batch):
                part = batch.take(pa.array(at))
                v = _matrix(part.column("v"))
                scale = np.sqrt((v * v).sum(1)) * sizes[dim][1]
                bound = part.column("bound").to_numpy(zero_copy_only=False)
                reach = np.maximum(0, 2 - 2 * bound / scale) * limit
                gaps = box_distances(project(v, sizes[dim][1], query=True)[:, :PROJECTED], low, high)
                go = ((gaps <= reach[:, None]) | ~np.isfinite(bound)[:, None]) & (dims == dim) & (numbers != part.column("cell").to_numpy()[:, None])
                who, where = np.nonzero(go)
                times = splits[where]
                who, where = np.repeat(who, times), np.repeat(where, times)
                split = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                for start in range(0, len(who), 20_000):
                    w = slice(start, start + 20_000)
                    pick = part.take(pa.array(who[w]))
                    columns = [pa.array(numbers[where[w]]), pa.array(split[w].astype(np.int32)), pick.column("block"), pick.column("row"), pick.column("id"), pick.column("v"), pick.column("bound")]
                    yield pa.RecordBatch.from_arrays(columns, ["cell", "split", "block", "row", "id", "v", "bound"])

    bounded = queries.join(reached, "row", "left").select(
        "row", "id", "v", "cell", "block", F.size("v").alias("dim"), F.coalesce("bound", F.lit(float("-inf"))).alias("bound")
    )
    others = searched(bounded.mapInArrow(visit, "cell long, split int, block int, row long, id long, v array<double>, bound double"))
    return best(first.select("row", "query_id", "vec_id", "score").unionByName(others), k).drop("row")


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best candidates of each query; Spark cuts to ``k`` before the shuffle, too."""
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("row", "query_id", "rank", "vec_id", "score")
