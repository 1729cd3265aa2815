"""Exact top-k search by inner product: a KD-tree per shard, best-first with bounding boxes.

Vectors are dealt into cells by the median splits of a bounded sample, so that a cell holds vectors near
one another, and cells into shards of bounded size. Every cell's tight box is known to all. A query first
goes to the cell that can hold its largest product; the k-th product found there goes along to the other
cells, of which it asks only those whose box can reach it. A shard's task builds its tree once (median
splits of the widest side, tight boxes) and takes its queries through it as they stream by: a box bounds
a query's product by its better corner, and nodes come off a query's heap in the order of their bounds
until none reaches the k-th best product so far. Only vectors, once, and pairs of a query and a cell that
it asks are shuffled.

Defined results: vectors that are null or hold null or non-finite components take no part; those of
another length than the query's are no candidates, and those without components take no part; equal products go by the smaller id; rows with
equal id and vector count once, and a query's own id is never its candidate; an empty table gives no
rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors of a shard on average, and of a leaf at most.
SHARD, LEAF = 8192, 128
#: Vectors from whose splits cells are made, the first by a hash of the id, and cells at most.
SAMPLE, CELLS = 16_384, 512


class Tree:
    """A KD-tree over integer vectors."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.lexsort((ids,))
        self.ids, self.points = ids[order], points[order]
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        self._grow(np.arange(len(ids)))
        self.lows, self.highs = np.stack(self.low), np.stack(self.high)

    def _grow(self, at: np.ndarray) -> int:
        node = len(self.low)
        low, high = self.points[at].min(0), self.points[at].max(0)
        self.low.append(low)
        self.high.append(high)
        self.children.append(None)
        self.rows.append(None)
        wide = int((high - low).argmax()) if len(low) else 0
        if len(at) <= LEAF or high[wide] == low[wide]:
            self.rows[node] = np.sort(at)  # rows are in the order of ids
            return node
        side = self.points[at, wide]
        half = len(at) // 2
        split = np.argpartition(side, half)
        self.children[node] = (self._grow(at[split[:half]]), self._grow(at[split[half:]]))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest product that each query can have in each node's box."""
        return np.maximum(queries, 0) @ self.highs.T + np.minimum(queries, 0) @ self.lows.T

    def search(self, own: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (product, id) of each query that reach its floor; places left over have id -1."""
        n = len(queries)
        least = np.iinfo(np.int64).min if self.points.dtype == np.int64 else -np.inf
        best, who = np.full((n, k), least, self.points.dtype), np.full((n, k), -1, np.int64)
        kth = floors.astype(self.points.dtype)
        bounds = self.bounds(queries)
        heaps = [[(-bounds[q, 0], 0)] for q in range(n)]
        active = range(n)
        while active:
            leaves: dict[int, list[int]] = {}
            for q in active:
                heap = heaps[q]
                while heap:
                    bound, node = heapq.heappop(heap)
                    if -bound < kth[q]:
                        heap.clear()
                    elif self.children[node]:
                        for child in self.children[node]:
                            if bounds[q, child] >= kth[q]:
                                heapq.heappush(heap, (-bounds[q, child], child))
                    else:
                        leaves.setdefault(node, []).append(q)
                        break
            for node, asking in leaves.items():
                at, q = self.rows[node], np.array(asking)
                if len(at) > LEAF:  # equal vectors: only the smallest ids can count
                    at = at[: k + 1]
                found = queries[q] @ self.points[at].T
                ids = np.broadcast_to(self.ids[at], found.shape)
                mine = ids == own[q, None]
                every = np.hstack([best[q], np.where(mine | (found < floors[q, None]), least, found)])
                names = np.hstack([who[q], np.where(mine | (found < floors[q, None]), -1, ids)])
                # Places left over come last; else by product, then by id.
                order = np.lexsort((names, -every, names < 0), axis=1)[:, :k]
                best[q], who[q] = np.take_along_axis(every, order, 1), np.take_along_axis(names, order, 1)
                full = who[q, -1] >= 0
                kth[q[full]] = np.maximum(kth[q[full]], best[q[full], -1])
            active = [q for asking in leaves.values() for q in asking if heaps[q]]
        return best, who


class Shard:
    """The vectors of a shard, and their tree once a query comes."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        # Ids may be any 64-bit number; the tree works with their ranks.
        self.names, self.rank = np.unique(ids, return_inverse=True)
        self.points, self.most = points, float(np.abs(points).max(initial=0))
        self.trees: dict[type, Tree] = {}

    def search(self, ids: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, vector and product of what is best."""
        # Products that a double holds exactly are much faster.
        kind = np.float64 if self.most * float(np.abs(q).max(initial=0)) * q.shape[1] < 2**53 else np.int64
        if kind not in self.trees:
            self.trees[kind] = Tree(self.rank, self.points.astype(kind))
        if kind is np.int64:
            floors = np.array([np.iinfo(np.int64).min if not np.isfinite(f) else int(f) for f in floors], np.int64)
        own = np.searchsorted(self.names, ids)
        own[self.names[np.minimum(own, len(self.names) - 1)] != ids] = -2
        best, who = self.trees[kind].search(own, q.astype(kind), floors, k)
        row, col = np.nonzero(who >= 0)
        return ids[row], self.names[who[row, col]], best[row, col].astype(np.int64)


def split(points: np.ndarray, cells: int, first: int = 0) -> tuple | int:
    """Median splits of the widest side, (side, value, below, from it on), down to numbered cells."""
    wide = int((points.max(0) - points.min(0)).argmax()) if len(points) and points.shape[1] else 0
    if cells < 2 or len(points) < 2 or not points.shape[1] or points[:, wide].min() == points[:, wide].max():
        return first
    value = np.median(points[:, wide])
    low = points[:, wide] < value
    if not low.any():
        value = points[points[:, wide] > value, wide].min()
        low = points[:, wide] < value
    half = cells // 2
    return wide, float(value), split(points[low], half, first), split(points[~low], cells - half, first + half)


def cell_of(points: np.ndarray, tree: tuple | int) -> np.ndarray:
    out = np.empty(len(points), np.int32)
    todo = [(tree, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if isinstance(node, int):
            out[at] = node
            continue
        wide, value, below, above = node
        low = points[at, wide] < value
        todo += [(below, at[low]), (above, at[~low])]
    return out


def rows_of(vectors) -> np.ndarray:
    """A matrix from an Arrow list column of rows of one length."""
    flat = vectors.flatten().to_numpy()
    return flat.reshape(len(vectors), -1) if len(vectors) and len(flat) else np.empty((len(vectors), 0), np.int64)


def runs_of(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that are equal in all columns."""
    n = len(columns[0])
    if n:
        new = np.zeros(n - 1, bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        ends = [0, *(np.flatnonzero(new) + 1).tolist(), n]
        yield from zip(ends[:-1], ends[1:], strict=True)


def quantized(table: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """Rows (id, v, dim): floor(scale * component) of the vectors that take part."""
    x = F.col(vector)
    sound = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.col(vec_id).isNotNull()
    return table.filter(F.coalesce(sound, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v")
    ).filter(F.size("v") > 0).withColumn("dim", F.size("v"))


def celled(every: DataFrame, trees: dict[int, tuple | int]) -> DataFrame:
    """Adds the cell of each row (id, v, dim)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            dims, out = batch.column(2).to_numpy(), np.zeros(batch.num_rows, np.int32)
            for lo, hi in runs_of(dims):
                out[lo:hi] = cell_of(rows_of(batch.column(1).slice(lo, hi - lo)), trees.get(int(dims[lo]), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "cell"])

    return every.mapInArrow(run, "id long, v array<bigint>, dim int, cell int")


def boxes(vectors: DataFrame) -> DataFrame:
    """(dim, cell, low, high, n): tight boxes and how many vectors they hold."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]] = {}
        for batch in batches:
            dims, cells = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                points, own = rows_of(batch.column(2).take(pa.array(at))), cells[at]
                for cell in np.unique(own):
                    x = points[own == cell]
                    low, high, n = found.get((dim, cell), (x[0], x[0], 0))
                    found[dim, cell] = np.minimum(low, x.min(0)), np.maximum(high, x.max(0)), n + len(x)
        lists = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32()), *[pa.array([v[i] for v in found.values()], lists) for i in (0, 1)], pa.array([v[2] for v in found.values()], pa.int64())],
            names=["dim", "cell", "low", "high", "n"],
        )

    parts = vectors.select("dim", "cell", "v").mapInArrow(run, "dim int, cell int, low array<bigint>, high array<bigint>, n long")
    sides = parts.select("dim", "cell", "n", F.posexplode(F.arrays_zip("low", "high")).alias("i", "b")).groupBy("dim", "cell", "i").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high"), F.sum("n").alias("n"))
    put = sides.groupBy("dim", "cell").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("s"), F.max("n").alias("n"))
    return put.select("dim", "cell", F.col("s.low").alias("low"), F.col("s.high").alias("high"), "n")


def asking(queries: DataFrame, known: dict, first: bool) -> DataFrame:
    """Rows (dim, shard, id, v, floor): the shards that a query (id, v, dim, floor, home) asks: those of the
    cell with the largest bound at first, then those of all other cells whose bound reaches the floor."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            dims = batch.column(2).to_numpy()
            for lo, hi in runs_of(dims):
                if int(dims[lo]) not in known:
                    continue
                low, high, shards = known[int(dims[lo])]
                part = batch.slice(lo, hi - lo)
                q, floors = rows_of(part.column(1)).astype(np.float64), part.column(3).to_numpy()
                bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                home = bound.argmax(1)
                ask = np.zeros(bound.shape, bool)
                ask[np.arange(len(q)), home] = True
                if not first:
                    # Sums of doubles can be a little short.
                    ask = ~ask & (bound + 1e-9 * np.abs(bound) >= floors[:, None])
                row, cell = np.nonzero(ask)
                count = np.array([len(shards[c]) for c in cell], np.int64)
                take = np.repeat(row, count)
                names = np.concatenate([shards[c] for c in cell]) if len(cell) else np.empty(0, np.int64)
                for at in range(0, len(take), 4096):
                    some = part.take(pa.array(take[at : at + 4096]))
                    yield pa.RecordBatch.from_arrays([some.column(2), pa.array(names[at : at + 4096], pa.int64()), some.column(0), some.column(1), some.column(3)], names=["dim", "shard", "id", "v", "floor"])

    return queries.select("id", "v", "dim", "floor").mapInArrow(run, "dim int, shard long, id long, v array<bigint>, floor double")


def searched(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each shard for the queries that ask it."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, held, shard = None, [], None
        for batch in batches:
            dims, shards, kinds, ids, floors = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "shard", "kind", "id", "floor"))
            for lo, hi in runs_of(dims, shards, kinds):
                if now != (dims[lo], shards[lo]):
                    now, held, shard = (dims[lo], shards[lo]), [], None
                points = rows_of(batch.column("v").slice(lo, hi - lo))
                if kinds[lo] == 0:
                    held.append((ids[lo:hi], points))
                    continue
                if shard is None and held:
                    shard, held = Shard(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                if shard is not None:
                    found = shard.search(ids[lo:hi], points, floors[lo:hi], k)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    own = vectors.select("dim", "shard", F.lit(0).alias("kind"), "id", "v", F.lit(0.0).alias("floor"))
    rows = own.union(queries.select("dim", "shard", F.lit(1), "id", "v", "floor")).repartition("dim", "shard")
    return rows.sortWithinPartitions("dim", "shard", "kind").mapInArrow(run, "query_id long, vec_id long, score long")


def search(table: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best of each query. is_query: a test of column id."""
    every = stored(quantized(table, vec_id, vector, scale).dropDuplicates(["id", "v"]), "vectors")
    sizes = {r["dim"]: r["n"] for r in every.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    drawn = every.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("dim", "v").collect() if any(n > SHARD for n in sizes.values()) else []
    trees = {dim: split(np.array([r["v"] for r in drawn if r["dim"] == dim]).reshape(-1, dim), min(CELLS, -(-n // SHARD))) if n > SHARD else 0 for dim, n in sizes.items()}
    vectors = stored(celled(every, trees), "cells")
    known: dict[int, tuple] = {}
    boxed = boxes(vectors).orderBy("dim", "cell").collect()  # CELLS rows a length at most
    parts = {(r["dim"], r["cell"]): -(-r["n"] // SHARD) for r in boxed}
    for dim in sizes:
        own = [r for r in boxed if r["dim"] == dim]
        if own:
            shards = [np.array([r["cell"] * 2**32 + j for j in range(parts[dim, r["cell"]])], np.int64) for r in own]
            known[dim] = np.array([r["low"] for r in own], np.float64), np.array([r["high"] for r in own], np.float64), shards
    cut = F.create_map(*[F.lit(x) for c, n in {(d * 2**32 + c): n for (d, c), n in parts.items()}.items() for x in (c, n)]) if parts else F.create_map(F.lit(0), F.lit(1))
    spread = F.pmod(F.xxhash64("id"), cut[F.col("dim") * F.lit(2**32) + F.col("cell")])
    vectors = vectors.select("dim", (F.col("cell") * F.lit(2**32) + spread).alias("shard"), "id", "v")
    queries = every.filter(is_query)
    found = stored(searched(vectors, asking(queries.withColumn("floor", F.lit(float("-inf"))), known, True), k), "home-cells")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = stored(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"), "home-best")
    if any(len(shards) > 1 for *_, shards in known.values()):
        floors = found.groupBy("query_id").agg(F.min("score").cast("double").alias("floor"), F.count(F.lit(1)).alias("found")).filter(F.col("found") >= k)
        later = queries.join(floors, F.col("id") == F.col("query_id"), "left").select("id", "v", "dim", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        found = found.union(searched(vectors, asking(later, known, False), k))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
