"""Nearest neighbours by inner product: vantage-point trees in shards, with relaxed triangle-inequality pruning.

With one more coordinate, sqrt(M - |x|^2) for rows (M: the largest squared norm) and 0 for queries, the largest inner
product becomes the smallest Euclidean distance, so the triangle inequality holds and a subtree whose distances to its
vantage point lie in [lo, hi] cannot hold anything nearer to a query than ``max(lo - d, d - hi)``. A subtree is skipped
where ``factor`` times that bound exceeds the query's k-th best distance: 1 is exact, more skips more.

The vectors are dealt out by a top tree, fitted on a bounded sample, that every row walks down; its leaves are cells,
cells larger than a shard are split by hash. A query first searches its own cell and then every cell that the
same rule, with the distance found there, cannot skip. Shard and queries meet in a cogroup of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.session import stage_table

NEIGHBOURS = 20
QUERY_STEP = 20
# at 1.5 recall was 0.99 or more on clustered vectors of equal and of unequal norms; at 2.5 it fell to 0.83 on unequal ones
FACTOR = 1.5
# vectors that the top tree is fitted on; rows of a shard; queries that meet a shard at once; rows of a tree's leaf
SAMPLE = 4096
SHARD = 8192
CHUNK = 2048
LEAF = 256
# fewest sampled vectors in a cell
SAMPLED = 8
# distances are compared with this much slack, relative to the largest norms, for rounding
SLACK = 1e-9


@dataclass
class Node:
    """An inner node; a child is a node, an array of row numbers (shard), or a cell's number (top tree)."""

    point: np.ndarray
    radius: float
    spans: tuple[tuple[float, float], tuple[float, float]]
    children: tuple


def _distances(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(x - point).sum(axis=1))


def _split(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vantage point, order of the rows by distance to it, distances in that order)."""
    # the row furthest from the first one: a corner sees more different distances than a centre
    first = _distances(x[at], x[at[0]])
    point = x[at[int(first.argmax())]]
    away = _distances(x[at], point)
    order = np.argsort(away, kind="stable")
    return point, at[order], away[order]


def grow(x: np.ndarray, at: np.ndarray, leaf: int):
    """Tree over the rows ``at``; leaves hold at most ``leaf`` rows, equal rows are split as any others."""
    if len(at) <= leaf:
        return at
    point, order, away = _split(x, at)
    half = len(order) // 2
    spans = ((float(away[0]), float(away[half - 1])), (float(away[half]), float(away[-1])))
    return Node(point, float(away[half]), spans, (grow(x, order[:half], leaf), grow(x, order[half:], leaf)))


class TopTree:
    """Cells of the whole space: a row within a node's radius goes to the first child, any other to the second."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.cells = 0
        self.root = self._grow(sample, np.arange(len(sample)), cells)

    def _grow(self, x: np.ndarray, at: np.ndarray, cells: int):
        if cells < 2 or len(at) < 2 * SAMPLED:
            self.cells += 1
            return self.cells - 1
        point, order, away = _split(x, at)
        half = len(order) // 2
        radius = float(away[half])
        spans = ((0.0, radius), (radius, np.inf))
        return Node(point, radius, spans, (self._grow(x, order[:half], cells // 2), self._grow(x, order[half:], cells - cells // 2)))

    def home(self, x: np.ndarray) -> np.ndarray:
        """Cell of each row."""
        out = np.zeros(len(x), dtype=np.int32)

        def walk(node, at):
            if not isinstance(node, Node):
                out[at] = node
            elif len(at):
                near = _distances(x[at], node.point) < node.radius
                walk(node.children[0], at[near])
                walk(node.children[1], at[~near])

        walk(self.root, np.arange(len(x)))
        return out

    def reach(self, q: np.ndarray, limit: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) numbers of all cells that may hold something within ``limit`` of the query."""
        found: list[tuple[np.ndarray, int]] = []

        def walk(node, at):
            if not isinstance(node, Node):
                found.append((at, node))
            elif len(at):
                d = _distances(q[at], node.point)
                for (lo, hi), child in zip(node.spans, node.children, strict=True):
                    walk(child, at[factor * np.maximum(lo - d, d - hi) <= limit[at]])

        walk(self.root, np.arange(len(q)))
        return np.concatenate([a for a, _ in found]), np.concatenate([np.full(len(a), c, dtype=np.int32) for a, c in found])


class Search:
    """The best ``k`` rows of one shard for a chunk of queries."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, bound: float, factor: float):
        """``floor``: the least inner product that still matters for each query."""
        self.rows, self.ids, self.queries, self.factor, self.bound = rows, ids, queries, factor, bound
        self.lifted, self.from_query = lift(rows, bound), lift(queries, None)
        self.own = np.square(queries).sum(axis=1)
        self.slack = SLACK * (bound + self.own)
        self.best = np.full((len(queries), k), -np.inf)
        self.best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.least = floor
        self.visited = 0
        self._walk(grow(self.lifted, np.arange(len(rows)), LEAF), np.arange(len(queries)))

    def _limit(self, at: np.ndarray) -> np.ndarray:
        """The distance beyond which nothing matters."""
        worst = np.maximum(self.best[at, -1], self.least[at])
        return np.sqrt(np.maximum(self.own[at] + self.bound - 2 * worst, 0) + self.slack[at])

    def _walk(self, node, at: np.ndarray) -> None:
        if not len(at):
            return
        if not isinstance(node, Node):
            return self._compare(node, at)
        d = _distances(self.from_query[at], node.point)
        gaps = [np.maximum(np.maximum(lo - d, d - hi), 0) for lo, hi in node.spans]
        inner_first = d < node.radius
        # the nearer child first: it lowers the limit that the other must meet
        for child, first in ((0, inner_first), (1, ~inner_first), (1, inner_first), (0, ~inner_first)):
            some = at[first]
            self._walk(node.children[child], some[self.factor * gaps[child][first] <= self._limit(some)])

    def _compare(self, leaf: np.ndarray, at: np.ndarray) -> None:
        self.visited += len(leaf) * len(at)
        rough = self.queries[at] @ self.rows[leaf].T
        worst = np.maximum(self.best[at, -1], self.least[at])
        better = rough >= (worst - self.slack[at])[:, None]
        some = np.flatnonzero(better.any(axis=1))
        if not len(some):
            return
        who = at[some]
        one, other = np.nonzero(better[some])
        exact = np.full((len(some), len(leaf)), -np.inf)
        exact[one, other] = products(self.queries[who[one]], self.rows[leaf[other]])
        exact[exact < self.least[who][:, None]] = -np.inf
        score = np.concatenate([self.best[who], exact], axis=1)
        name = np.concatenate([self.best_id[who], np.broadcast_to(self.ids[leaf], exact.shape)], axis=1)
        order = np.lexsort((name, -score), axis=1)[:, : self.best.shape[1]]
        self.best[who] = np.take_along_axis(score, order, axis=1)
        self.best_id[who] = np.take_along_axis(name, order, axis=1)


def lift(x: np.ndarray, bound: float | None) -> np.ndarray:
    """Rows with the coordinate that gives all of them the squared norm ``bound``; queries (None) get 0."""
    more = np.zeros(len(x)) if bound is None else np.sqrt(np.maximum(bound - np.square(x).sum(axis=1), 0))
    return np.concatenate([x, more[:, None]], axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed from the first place to the last, so that equal vectors get equal scores."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


# ---- Spark --------------------------------------------------------------------------


def usable(df: DataFrame) -> DataFrame:
    """(id, v) of the rows that take part, v as doubles."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))


def _padded(v: Column, dims: int) -> Column:
    return F.when(F.size(v) < dims, F.concat(v, F.array_repeat(F.lit(0.0), dims - F.size(v)))).otherwise(v)


def neighbours(df: DataFrame, k: int = NEIGHBOURS, query_step: int = QUERY_STEP, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product with each row whose id ``query_step`` divides.

    ``df`` has vec_id and embedding; other columns are ignored. Ties go to the smaller id. Rows without an id, and
    vectors that are null, empty, zero or hold null or non-finite numbers take no part; a shorter vector counts as
    padded with zeros. Repeated rows count once; rows that repeat an id with other vectors are rows of their own, each
    a query and a candidate, and a query leaves out itself alone. With fewer candidates than ``k`` all are returned,
    with none no row. Of the rows of one vector only the ``k`` + 1 smallest ids can be among the nearest of anything,
    so no more of them are indexed. ``factor`` 1 is exact; above, parts of the tree are skipped that may
    hold neighbours. At most ``SAMPLE`` vectors reach the driver.
    """
    if factor < 1:
        raise ValueError(f"a factor below 1 only searches more than an exact search: {factor}")
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(df)
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    facts = rows.agg(F.max(F.size("v")).alias("dims"), F.max(norm).alias("bound")).first()
    if facts["dims"] is None:
        return spark.createDataFrame([], schema)
    dims, bound = facts["dims"], facts["bound"]
    rows = rows.select("id", _padded(F.col("v"), dims).alias("v"))
    among = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    points = rows.groupBy("v", "id").agg(F.lit(1)).select("v", "id", among.alias("n")).where(F.col("n") <= k + 1)
    points = stage_table(points.select("v", "id"), "points")
    top = _top_tree(points, dims, bound)
    shared = spark.sparkContext.broadcast(top)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = shared.value.home(lift(_matrix(batch.column(0), dims), bound))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell)], ["v", "id", "cell"])

    placed = stage_table(points.mapInArrow(homes, "v array<double>, id long, cell int"), "placed")
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    parts = F.array(*[F.lit(-(-sizes.get(c, 0) // SHARD)) for c in range(top.cells)])
    shards = placed.withColumn("part", F.pmod(F.xxhash64("v", "id"), F.get(parts, F.col("cell"))).cast("int"))

    asked = rows.where(F.col("id") % query_step == 0)
    # one search for all queries of one vector; its name is its least id and a hash
    asked = stage_table(asked.groupBy("v", "id").agg(F.lit(1)).select("v", "id"), "queries")
    once = asked.groupBy("v").agg(F.min("id").alias("id"))
    once = stage_table(once.mapInArrow(homes, "v array<double>, id long, cell int").withColumn("name", F.xxhash64("v")), "searches")
    never = F.lit(float("-inf"))
    near = _search(shards, once.withColumn("floor", never), sizes, parts, dims, bound, k, factor)
    near = stage_table(near, "near")
    worst = _best(near, k + 1).groupBy("id", "name").agg(F.min("score").alias("floor"), F.count("*").alias("n"))
    worst = worst.select("id", "name", F.when(F.col("n") > k, F.col("floor")).otherwise(never).alias("floor"))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, least = _matrix(batch.column(0), dims), batch.column(4).to_numpy(zero_copy_only=False)
            own = np.square(q).sum(axis=1)
            limit = np.sqrt(np.maximum(own + bound - 2 * least, 0) + SLACK * (bound + own))
            at, cell = shared.value.reach(lift(q, None), limit, factor)
            other = cell != batch.column(2).to_numpy()[at]
            far = batch.take(pa.array(at[other])).select(["v", "id", "name", "floor"])
            yield pa.RecordBatch.from_arrays([*far.columns, pa.array(cell[other])], ["v", "id", "name", "floor", "cell"])

    known = once.join(worst, ["id", "name"]).select("v", "id", "cell", "name", "floor")
    wide = known.mapInArrow(reached, "v array<double>, id long, name long, floor double, cell int")
    more = _search(shards, wide, sizes, parts, dims, bound, k, factor)
    best = _best(near.unionByName(more), k + 1).select("id", "name", "score", F.col("found").alias("vec_id"))
    names = asked.select("v", F.col("id").alias("query_id")).join(once.select("v", "id", "name"), "v")
    pairs = names.select("query_id", "id", "name").join(best, ["id", "name"]).where("query_id <> vec_id")
    turn = Window.partitionBy("query_id", "id", "name").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _top_tree(points: DataFrame, dims: int, bound: float) -> TopTree:
    """Cells of about ``SHARD`` rows, or as many as the sample supports."""
    sample = points.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow()
    cells = min(-(-points.count() // SHARD), SAMPLE // SAMPLED)
    return TopTree(lift(_matrix(sample.column("v"), dims), bound), cells)


def _search(shards: DataFrame, asked: DataFrame, sizes: dict, parts: Column, dims: int, bound: float, k: int, factor: float) -> DataFrame:
    """(id, name, found, score): up to ``k`` + 1 rows of each shard for each query that is sent to its cell.

    Both sides are cut: a group is one shard with at most about ``CHUNK`` queries.
    """
    asked = stage_table(asked, "asked")
    loads = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}
    chunks = F.array(*[F.lit(-(-loads.get(c, 0) // CHUNK)) for c in range(max([*sizes, *loads], default=0) + 1)])
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = shards.where(F.get(chunks, F.col("cell")) > 0).withColumn("chunk", every(F.get(chunks, F.col("cell"))))
    asked = asked.where(F.get(parts, F.col("cell")) > 0).withColumn("part", every(F.get(parts, F.col("cell"))))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("id", "name"), F.get(chunks, F.col("cell"))).cast("int"))

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["id", "name", "found", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        if not rows.num_rows or not asked.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        least = asked["floor"].to_numpy()
        found = Search(_matrix(rows["v"], dims), rows["id"].to_numpy(), _matrix(asked["v"], dims), least, k + 1, bound, factor)
        one, place = np.nonzero(found.best > -np.inf)
        columns = [asked["id"].to_numpy()[one], asked["name"].to_numpy()[one], found.best_id[one, place], found.best[one, place]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    keys = ["cell", "part", "chunk"]
    rows, asked = rows.select(*keys, "v", "id"), asked.select(*keys, "v", "id", "name", "floor")
    both = rows.groupBy(*keys).cogroup(asked.groupBy(*keys))
    return both.applyInArrow(search, "id long, name long, found long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    turn = Window.partitionBy("id", "name").orderBy(F.desc("score"), "found")
    return found.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= k).drop("turn")
