"""Nearest neighbours by inner product: stable projections indexed by a kd-tree.

A vector x gets one more component, sqrt(M - |x|^2) with M the largest squared
norm, and a query a zero; then |q - x|^2 = |q|^2 + M - 2 qx, and the nearest are
those of largest inner product.  All are projected to ``DIMS`` dimensions by
normal random numbers (2-stable): the squared projected distance over the squared
true one is chi-square distributed with ``DIMS`` degrees of freedom.  A search takes the leaves of a
kd-tree over the projections in the order of their projected distance and
verifies their vectors; it stops when the next leaf is so far away that a vector
as near as the worst of those held would lie nearer with probability ``SURE``.
So every true neighbour is found with at least that probability, whatever the data.

The tree's upper part comes from a sample of ``SAMPLE`` projections a block and
cuts all vectors into blocks; each block's own tree is built in the task that
searches it.  A query first searches the block it falls into; the distance it
finds there bounds which blocks, by their boxes, it must still visit.  Equal
vectors are one point with their least ids, equal queries are asked once, and
blocks or vectors with many queries are dealt to several tasks.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt, save, sized

NEAREST = 20
#: Dimensions of the projections (even: the distribution has a closed form).
DIMS = 8
SURE = 0.95
#: Vectors of a block: so many times the root of their number, so that blocks and
#: their visitors both grow slowly, and at most what a task holds.
BLOCK_ROOTS, MOST_BLOCK = 8, 1 << 16
LEAF, SAMPLE = 256, 64
#: Queries that a task searches a block with; rows of one query vector that a task answers.
QUERIES, ROWS = 2_048, 5_000
SEED = 11
_FAR = 1.7976931348623157e308


def chi_square(x: float, dims: int = DIMS) -> float:
    """Its distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1 - exp(-x / 2) * total


def quantile(p: float, dims: int = DIMS) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, dims) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < p else (low, mid)
    return high


def usable(vector: str) -> Column:
    """Neither null nor zero nor holding null or non-finite components."""
    v = F.col(vector)
    good = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) <= _FAR, F.lit(False)))
    return F.coalesce(good & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as doubles; shorter rows are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < sizes[:, None]] = values
    return out


@dataclass
class Space:
    """Dimension, largest squared norm and the random numbers of the projection."""

    dim: int
    most: float

    def __post_init__(self):
        self.normal = np.random.default_rng(SEED).standard_normal((self.dim + 1, DIMS))

    def project(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        got = x @ self.normal[:-1]
        if not query:
            got += np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))[:, None] * self.normal[-1]
        return got


def cuts(points: np.ndarray, rows: int) -> list[tuple[int, float, int, int]]:
    """A kd-tree as a list of (dimension, value, left, right), of medians along the
    widest dimension, until a leaf has at most ``rows``; leaves are ~0, ~1, ..."""
    tree, leaves = [], 0

    def grow(at: np.ndarray) -> int:
        nonlocal leaves
        spread = at.max(axis=0) - at.min(axis=0) if len(at) else np.zeros(1)
        d = int(spread.argmax())
        if len(at) <= rows or not spread[d] > 0:
            leaves += 1
            return ~(leaves - 1)
        cut = float(np.partition(at[:, d], len(at) // 2)[len(at) // 2])
        left = at[:, d] < cut
        if not left.any():                                  # the median is the least value
            left = at[:, d] <= cut
            cut = float(at[~left, d].min())
        node = len(tree)
        tree.append((d, cut, 0, 0))
        tree[node] = (d, cut, grow(at[left]), grow(at[~left]))
        return node

    grow(points)
    return tree


def leaf_of(tree: list[tuple[int, float, int, int]], points: np.ndarray) -> np.ndarray:
    """The leaf that each point falls into."""
    out = np.zeros(len(points), np.int64)
    stack = [(0, np.arange(len(points)))] if tree else []
    while stack:
        node, at = stack.pop()
        if node < 0:
            out[at] = ~node
            continue
        d, cut, left, right = tree[node]
        less = points[at, d] < cut
        stack += [(left, at[less]), (right, at[~less])]
    return out


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        gap = np.maximum(np.maximum(low[:, d] - x, x - high[:, d]), 0)
        out += gap * gap
    return out


def search(space: Space, vectors: np.ndarray, asked: np.ndarray, bound: np.ndarray, first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each asked vector the places of the ``most`` nearest vectors in any order
    (ties: by ``first``), -1 where there is none, and their squared distances.
    ``bound``: squared distances beyond which nothing is wanted."""
    reach, found = quantile(SURE), min(most, len(vectors))
    place = np.full((len(asked), found), -1)
    best = np.full((len(asked), found), np.inf)
    projected = space.project(vectors)
    leaf = leaf_of(cuts(projected, LEAF), projected)
    order = np.argsort(leaf, kind="stable")
    starts = np.flatnonzero(np.diff(leaf[order], prepend=-1))
    members = np.split(order, starts[1:])
    low, high = (np.array([f(projected[m], axis=0) for m in members]) for f in (np.min, np.max))
    away = box_distance(space.project(asked, query=True), low, high)
    turn = np.argsort(away, axis=1, kind="stable")
    far = (asked * asked).sum(axis=1) + space.most
    active = np.arange(len(asked))
    for r in range(len(members)):
        at = turn[active, r]
        worst = np.minimum(best[active].max(axis=1, initial=0), bound[active])
        within = away[active, at] <= reach * worst          # else the stopping test holds
        active, at = active[within], at[within]
        if not len(active):
            break
        by = np.argsort(at, kind="stable")
        for same in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
            q, m = active[same], members[at[same[0]]]
            new = np.maximum(far[q, None] - 2 * (asked[q] @ vectors[m].T), 0)
            both = np.concatenate([best[q], new], axis=1)
            who = np.concatenate([place[q], np.broadcast_to(m, new.shape)], axis=1)
            kept = both <= np.partition(both, found - 1, axis=1)[:, found - 1, None]
            if (kept.sum(axis=1) == found).all():
                columns = np.nonzero(kept)[1].reshape(-1, found)
            else:                                           # ties at the end: the least ``first``
                columns = np.lexsort((np.where(who < 0, _FAR, first[who]), both), axis=1)[:, :found]
            best[q], place[q] = (np.take_along_axis(x, columns, axis=1) for x in (both, who))
    return place, best


_FOUND = "query long, score double, ids array<bigint>, own boolean"
_found_schema = pa.schema([("query", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64())), ("own", pa.bool_())])


def _searched(space: Space, most: int):
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        if not points.num_rows or not queries.num_rows:
            return _found_schema.empty_table()
        x, q = matrix(points["vector"], space.dim), matrix(queries["vector"], space.dim)
        ids = points["ids"].to_pylist()
        bound = queries["bound"].to_numpy()
        place, best = search(space, x, q, bound, np.array([i[0] for i in ids], np.float64), most)
        row, rank = np.nonzero((place >= 0) & (best <= bound[:, None]))
        at = place[row, rank]
        return pa.table([queries["query"].take(pa.array(row)), np.einsum("ij,ij->i", x[at], q[row]),
                         pa.array([ids[i] for i in at], pa.list_(pa.int64())), (x[at] == q[row]).all(axis=1)], schema=_found_schema)
    return run


def _points(rows: DataFrame, most: int) -> DataFrame:
    """(point, vector, ids), written: every distinct vector with its ``most`` least ids."""
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    least = rows.withColumn("rank", rank).where(F.col("rank") <= most)
    return save(least.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
                .select(F.monotonically_increasing_id().alias("point"), "vector", "ids"), "points")


def _placed(rows: DataFrame, space: Space, tree: list, key: str, query: bool, *more: str) -> DataFrame:
    """Rows with the block of the upper tree that their projection falls into."""
    kinds = dict(rows.dtypes)
    own = (key, "vector", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = space.project(matrix(b.column(1), space.dim), query)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf_of(tree, p)), pa.array(list(p), pa.list_(pa.float64()))],
                                             names=[*own, "block", "at"])

    return rows.select(*own).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in own) + ", block long, at array<double>")


def _upper(points: DataFrame, space: Space, n: int, block: int) -> list:
    """Cuts of the projections of a sample, about ``SAMPLE`` a block."""
    blocks = -(-n // block)
    if blocks < 2:
        return []
    chance = min(1.0, SAMPLE * blocks / n)
    u = F.pmod(F.xxhash64("point", F.lit(SEED)), F.lit(1 << 40)) / float(1 << 40)
    drawn = _placed(points.where(u < chance), space, [], "point", False).select("at").collect()
    return cuts(np.array([r["at"] for r in drawn]).reshape(-1, DIMS), SAMPLE)


def nearest(rows: DataFrame, asked: Column, k: int = NEAREST, vector: str = "embedding", block: int | None = None, queries: int = QUERIES) -> DataFrame:
    """rows(vec_id, ``vector``) → (query_id, rank from 1, vec_id, score) for the rows that
    ``asked`` (a condition on vec_id) names: their ``k`` nearest other rows found, by
    inner product in double precision, ties to the smaller vec_id; all others if
    there are fewer.

    Vectors that are null, zero or hold null or non-finite components, and rows
    without a vec_id, take no part.  A shorter vector counts as filled up with zeros.
    Rows that repeat an id are rows of their own: a row is left out of its own
    answer only.  An empty table gives an empty one; further columns are ignored."""
    good = rows.where(F.col("vec_id").isNotNull() & usable(vector)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    points = _points(good, k + 1)
    size, norm = F.size("vector"), F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, dim, longest = points.agg(F.count("*"), F.max(size), F.max(norm)).first()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    space = Space(dim, longest)
    block = block or min(BLOCK_ROOTS * isqrt(n) + 1, MOST_BLOCK)
    tree = _upper(points, space, n, block)
    placed = save(_placed(points, space, tree, "point", False, "ids"), "placed")
    # a block that the sample made too large is several
    pieces = sized(save(placed.groupBy("block").agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("pieces")), "pieces"))
    piece = F.pmod(F.xxhash64("point"), F.col("pieces"))
    index = save(placed.join(pieces, "block").select((F.col("block") * (1 << 20) + piece).alias("block"), "vector", "ids", "at"), "index")

    questions = save(good.where(asked).groupBy("vector").agg(F.count("*").alias("n"))
                     .select(F.monotonically_increasing_id().alias("query"), "vector", "n"), "queries")
    home = save(_placed(questions, space, tree, "query", True).join(pieces, "block").select(
        (F.col("block") * (1 << 20) + F.pmod(F.xxhash64("query"), F.col("pieces"))).alias("block"),
        "query", "vector", "at", F.lit(np.inf).alias("bound")), "home")
    held = index.select("block", "vector", "ids")
    near = save(_found(held, home, space, k + 1, queries), "near")
    # the squared distance of the last one found at home, if there are enough
    worst = near.groupBy("query").agg(F.count("*").alias("found"), F.min("score").alias("least"))
    own = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    bound = F.when(F.col("found") > k, F.greatest(own + longest - 2 * F.col("least"), F.lit(0.0)) * (1 + 1e-9) + 1e-9 * longest).otherwise(np.inf)
    bounded = home.drop("bound").join(worst, "query", "left").select("query", "vector", "block", "at", bound.alias("bound"))
    visits = save(_visits(bounded, index), "visits")
    found = near.unionAll(_found(held, visits, space, k + 1, queries))
    first = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    best = (found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k + 1)
            .groupBy("query").agg(F.collect_list(F.struct("score", "ids", "own")).alias("points")))
    answers = save(questions.join(best, "query"), "answers")
    return _answered(good.where(asked), answers, k)


def _found(held: DataFrame, visits: DataFrame, space: Space, most: int, queries: int) -> DataFrame:
    copies, dealt_visits = dealt(held, visits.select("block", "query", "vector", "bound"), "block", "query", queries)
    return copies.groupBy("block", "part").cogroup(dealt_visits.groupBy("block", "part")).applyInArrow(_searched(space, most), _FOUND)


def _visits(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(block, query, vector, bound) for the blocks, but a query's own, whose box is in reach."""
    ends = [f(F.col("at")[d]) for f in (F.min, F.max) for d in range(DIMS)]
    boxes = sorted(tuple(r) for r in index.groupBy("block").agg(*ends).collect())
    names = np.array([b[0] for b in boxes], np.int64)
    sides = np.array([b[1:] for b in boxes]).reshape(-1, 2, DIMS)
    held = index.sparkSession.sparkContext.broadcast((names, sides[:, 0], sides[:, 1]))
    reach, kind = quantile(SURE), dict(queries.dtypes)["vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, low, high = held.value
        for b in batches:
            at, own = matrix(b.column(3), DIMS), b.column(2).to_numpy()
            bound = b.column(4).to_numpy()
            row, box = np.nonzero((box_distance(at, low, high) <= reach * bound[:, None]) & (names != own[:, None]))
            for some in np.array_split(np.arange(len(row)), len(row) // 4096 + 1):
                take = pa.array(row[some])
                yield pa.RecordBatch.from_arrays([pa.array(names[box[some]]), b.column(0).take(take), b.column(1).take(take), b.column(4).take(take)],
                                                 names=["block", "query", "vector", "bound"])

    return queries.select("query", "vector", "block", "at", "bound").mapInArrow(run, f"block long, query long, vector {kind}, bound double")


def _answered(asked: DataFrame, answers: DataFrame, k: int) -> DataFrame:
    """Each asked row's own list, from its vector's.  Vectors that many rows ask with
    are dealt to several tasks."""
    busy = sized(save(answers.where(F.col("n") > ROWS).select("vector", F.ceil(F.col("n") / ROWS).cast("int").alias("parts")), "busy"))
    rows = asked.join(busy, "vector", "left").select(
        "vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1))).alias("part"))
    copies = answers.select("vector", "points", F.explode(F.sequence(
        F.lit(0), F.when(F.col("n") > ROWS, F.ceil(F.col("n") / ROWS).cast("int")).otherwise(1) - 1)).alias("part"))
    one = lambda score, vec_id, own: F.struct((-score).alias("less"), vec_id.alias("vec_id"), own.alias("own"))
    every = F.array_sort(F.flatten(F.transform("points", lambda p: F.transform(p["ids"], lambda i: one(p["score"], i, p["own"])))))
    listed = rows.join(copies.withColumn("every", every), ["vector", "part"])
    # the row itself is one of those with its id and its vector
    me = F.array_position(F.transform("every", lambda x: x["own"] & (x["vec_id"] == F.col("vec_id"))), F.lit(True))
    others = F.slice(F.filter("every", lambda x, i: i + 1 != me), 1, k)
    return listed.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("i", "x")).select(
        "query_id", (F.col("i") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.less")).alias("score"))
