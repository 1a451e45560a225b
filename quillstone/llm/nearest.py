"""Approximate nearest neighbours by cosine: stable projections, kd-trees, a chi-square stopping test.

Unit vectors are projected to a few dimensions with Gaussian (2-stable) weights: a squared distance
d2 becomes d2 times a chi-square variable. The projected space is cut into kd cells fitted to a
bounded sample; every vector is indexed in its cell. A query first searches its own cell's kd-tree:
leaves come in order of their projected distance, their points are verified on the original
vectors, and the search stops once the next leaf is so far that a nearer neighbour would be
projected there with probability under 1 - ``sure`` at most. The bound it has then decides which
other cells can still hold one; those are searched the same way. ``sure`` is thus the least expected
recall: a neighbour at the very distance of the k-th is found with that probability, nearer ones
with a higher one. How much the test spares depends on the data; where all distances are alike,
as in isotropic random vectors, a large share of the projected space is within reach of each query.

A cell is cut into parts of bounded size by a hash of the id, and a query of the cell goes to all of
them, so no task holds more than 4 * ``cell_rows`` vectors, however many there are.

Equal vectors are ordered by id alone, so of each group of copies the k + 1 smallest ids stand for
all, and equal queries are searched once. Copies of one vector therefore load no task.

Cases: vectors that are null, zero or hold null or non-finite components, vectors of another
dimension than the most frequent one, and rows without id take no part. Rows that repeat the
query's id count as the query's own. Ties go to the smaller id. Fewer candidates than k: all.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chi2
from .storage import saved

LEAF = 64


def _rows(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class KdTree:
    """Points in leaves of at most LEAF, with the leaves' bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            at = todo.pop()
            spread = np.ptp(points[at], axis=0) if len(at) else np.zeros(1)
            if len(at) <= leaf or spread.max() == 0:
                self.leaves.append(at)
                continue
            order = at[np.argsort(points[at, int(spread.argmax())], kind="stable")]
            todo += [order[: len(order) // 2], order[len(order) // 2 :]]
        self.low = np.array([points[a].min(axis=0) for a in self.leaves])
        self.high = np.array([points[a].max(axis=0) for a in self.leaves])

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of a point to all boxes."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return (gap * gap).sum(axis=1)


class Cells:
    """kd cuts of the projected space; cell boxes are open at the outside."""

    def __init__(self, sample: np.ndarray, count: int, dims: int):
        self.nodes: list[tuple[int, float, int, int]] = []
        self.low, self.high = [], []
        self._grow(sample, count, np.full(dims, -np.inf), np.full(dims, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, x: np.ndarray, count: int, low: np.ndarray, high: np.ndarray) -> int:
        """Index of a node, or -1 - index of a cell."""
        spread = np.ptp(x, axis=0) if len(x) else np.zeros(1)
        if count <= 1 or len(x) < 2 or spread.max() == 0:
            self.low.append(low)
            self.high.append(high)
            return -len(self.low)
        d = int(spread.argmax())
        cut = float(np.quantile(x[:, d], (count // 2) / count))
        me = len(self.nodes)
        self.nodes.append((d, cut, 0, 0))
        left_high, right_low = high.copy(), low.copy()
        left_high[d] = right_low[d] = cut
        right = x[:, d] > cut
        a = self._grow(x[~right], count // 2, low, left_high)
        b = self._grow(x[right], count - count // 2, right_low, high)
        self.nodes[me] = (d, cut, a, b)
        return me

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0 if self.nodes else -1, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -1 - node
                continue
            d, cut, a, b = self.nodes[node]
            right = x[at, d] > cut
            todo += [(a, at[~right]), (b, at[right])]
        return out

    def distances(self, q: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return (gap * gap).sum(axis=1)


def search_cell(tree: KdTree, vectors: np.ndarray, ids: np.ndarray, q: np.ndarray, projected: np.ndarray, k: int, bound: float, stretch: float) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, cosines) of a cell for a unit query, as far as they can beat the bound (a cosine)."""
    near = tree.distances(projected)
    order = np.argsort(near, kind="stable")
    best_ids, best = np.zeros(0, np.int64), np.zeros(0)
    limit = bound
    step, at = 4, 0
    while at < len(order):
        radius = stretch * max(0.0, 2 - 2 * limit) + 1e-9
        leaves = order[at : at + step]
        leaves = leaves[near[leaves] <= radius]
        if not len(leaves):
            break
        rows = np.concatenate([tree.leaves[i] for i in leaves])
        gap = tree.points[rows] - projected
        rows = rows[np.einsum("ij,ij->i", gap, gap) <= radius]
        cos = (vectors[rows] * q).sum(axis=1)
        best_ids, best = np.concatenate([best_ids, ids[rows]]), np.concatenate([best, cos])
        top = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[top], best[top]
        if len(best) == k:
            limit = max(bound, float(best[-1]))
        at += step
        step = min(2 * step, 64)
    return best_ids, best


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 5, dims: int = 16, sure: float = 0.92, cell_rows: int = 4096, sample: int = 32_768, seed: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest of all rows but its own.

    is_query: a condition on vec_id. sample: rows that the cells are fitted to; one cell per
    cell_rows vectors, but no more than sample / 8: larger cells are cut into parts.
    """
    c = F.col
    wide = vectors.select(c("vec_id").cast("long"), c("embedding").cast("array<double>"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = wide.where(c("vec_id").isNotNull() & c("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    common = sound.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    shape = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], shape)
    dim = common["dim"]
    sound = sound.where(F.size("embedding") == dim)
    project = np.random.default_rng(seed).normal(size=(dim, dims))
    stretch = chi2.quantile(sure, dims)
    many = k + 1
    first = Window.partitionBy("embedding").orderBy("vec_id")
    base = sound.withColumn("copy", F.row_number().over(first)).where(c("copy") <= many).select("vec_id", "embedding")
    base = saved(base, "nearest-vectors")
    cells = max(1, min(-(-base.count() // cell_rows), sample // 8))
    drawn = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    grid = Cells(unit(_rows(drawn["embedding"], dim)) @ project, cells, dims)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = grid.of(unit(_rows(batch.column("embedding"), dim)) @ project)
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("vec_id"), batch.column("embedding")], names=["cell", "vec_id", "embedding"])

    def look(queries: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and held.num_rows:
            v, q = unit(_rows(held["embedding"], dim)), unit(_rows(queries["embedding"], dim))
            tree, ids = KdTree(v @ project), held["vec_id"].to_numpy()
            for uid, row, p, bound in zip(queries["uid"].to_pylist(), q, q @ project, queries["bound"].to_pylist(), strict=True):
                found, cos = search_cell(tree, v, ids, row, p, many, bound, stretch)
                out.append((np.full(len(found), uid, np.int64), found, cos))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("uid", "vec_id", "score"), cols, strict=True)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                p = unit(_rows(batch.column("embedding"), dim)) @ project
                bound = batch.column("bound").to_numpy()
                to = [np.flatnonzero(grid.distances(x) <= stretch * (2 - 2 * b) + 1e-9) for x, b in zip(p, bound, strict=True)]
                to = [t[t != home] for t, home in zip(to, batch.column("cell").to_pylist(), strict=True)]
                row = np.repeat(np.arange(len(to)), [len(t) for t in to])
                moved = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to)), moved.column("uid"), moved.column("embedding"), moved.column("bound")], names=["cell", "uid", "embedding", "bound"])

    placed = base.mapInArrow(place, "cell long, vec_id long, embedding array<double>")
    placed = saved(placed, "nearest-cells")
    # a row per cell, of which there are sample / 8 at most
    parts = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count("*") / (4 * cell_rows)).alias("parts")))
    held = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), c("parts"))).drop("parts")
    everywhere = lambda q: q.join(parts, "cell").select("*", F.explode(F.sequence(F.lit(0), c("parts") - 1)).alias("part")).drop("parts")
    searched = lambda q: everywhere(q).groupBy("cell", "part").cogroup(held.groupBy("cell", "part")).applyInArrow(look, "uid long, vec_id long, score double")
    asked = sound.where(is_query)
    once = asked.groupBy("embedding").agg(F.min("vec_id").alias("vec_id")).mapInArrow(place, "cell long, vec_id long, embedding array<double>")
    once = saved(once.withColumnRenamed("vec_id", "uid"), "nearest-queries")
    one = saved(searched(once.select("cell", "uid", "embedding", F.lit(-1.0).alias("bound"))), "nearest-home")
    best = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    # of a home cell in parts, the best over all of them bound the rest
    home = one.withColumn("r", F.row_number().over(best)).where(c("r") <= many)
    bounds = home.groupBy("uid").agg(F.when(F.count("*") == many, F.min("score")).otherwise(-1.0).alias("bound"))
    onward = once.join(bounds, "uid", "left").select("cell", "uid", "embedding", F.coalesce("bound", F.lit(-1.0)).alias("bound"))
    two = searched(onward.mapInArrow(spread, "cell long, uid long, embedding array<double>, bound double"))
    top = one.unionByName(two).withColumn("r", F.row_number().over(best)).where(c("r") <= many).drop("r")
    # the queries that share a vector share its candidates; each leaves out itself
    mine = asked.join(once.select("uid", "embedding"), "embedding").select(c("vec_id").alias("query_id"), "uid").distinct()
    pairs = mine.join(top, "uid").where(c("vec_id") != c("query_id"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(c("rank") <= k).select("query_id", "rank", "vec_id", "score")
