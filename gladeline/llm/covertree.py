"""Exact top-k inner-product search with a cover tree over the data and one over the queries.

Both trees are descended together. A pair of nodes is dropped as soon as no query below the one can find, below the
other, a score that reaches the worst k-th score its group of queries already has: for centres q, x and covering
radii r, s no inner product exceeds q.x + |q| s + |x| r + r s. Pairs with high bounds are visited first, so that the
k-th scores rise early. What is left at pairs of leaves is scored in whole numbers.

Vectors are dealt into blocks of bounded size and every block of queries meets every block of data once, as a search
against all rows has to; a block's tree is built in the task that uses it. Each meeting answers with k rows per query
at most, and these are ranked per query.

Defined cases: a vector that is null, holds a null or a non-finite number, or has no id takes no part; every
row is a candidate, also where rows share an id or are equal, and the k best of a query are taken over all rows of its
id; no row of the query's own id is its candidate; vectors of different lengths do not meet; equal
scores go to the smaller id; with fewer candidates than k all are returned; an empty table gives no rows; whole
numbers are kept up to 64 bits, and a score beyond them is held at the bound; further columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gladeline.llm.tables import stored

K = 5
SCALE = 256
#: Points of a leaf, of the data and of the queries, and centres of a level at most.
LEAF = 128
QUERY_LEAF = 32
BRANCHES = 8
#: Vectors of a data block and of a query block.
DATA_BLOCK = 4096
QUERY_BLOCK = 2048
_WIDE = 1 << 26  # whole numbers up to this have exact products in a double, over thousands of components
_BOUND = (1 << 63) - 1


class Node:
    """A ball: its centre, the radius that covers all its points, and either children or points."""

    __slots__ = ("centre", "norm", "radius", "children", "points", "worst", "centres", "norms", "radii")

    def __init__(self, centre, radius, children, points):
        self.centre, self.radius, self.children, self.points = centre, radius, children, points
        self.norm = float(np.sqrt(centre @ centre))
        self.worst = -np.inf
        if children:
            self.centres = np.stack([c.centre for c in children])
            self.norms = np.array([c.norm for c in children])
            self.radii = np.array([c.radius for c in children])


def cover_tree(vectors: np.ndarray, leaf: int = LEAF) -> Node | None:
    """A tree in which every point lies under the nearest of its level's centres.

    The centres of a level are taken farthest first, so they stand at least as far apart as the level's covering
    radius: until that is half the ball's radius, or ``BRANCHES`` are taken.
    """
    if not len(vectors):
        return None

    def build(points: np.ndarray, centre: int, distance: np.ndarray) -> Node:
        radius = float(distance.max())
        if len(points) <= leaf or radius == 0:
            return Node(vectors[centre], radius, [], points)
        centres, nearest, best = [centre], np.zeros(len(points), np.int64), distance.copy()
        while best.max() > radius / 2 and len(centres) < BRANCHES:
            far = int(points[best.argmax()])
            away = _distances(vectors[points], vectors[far])
            closer = away < best
            nearest[closer], best[closer] = len(centres), away[closer]
            centres.append(far)
        children = []
        for i, c in enumerate(centres):
            own = nearest == i
            if own.any():
                children.append(build(points[own], c, best[own]))
        return Node(vectors[centre], radius, children, points)

    points = np.arange(len(vectors))
    return build(points, 0, _distances(vectors, vectors[0]))


def _distances(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    away = vectors - centre
    return np.sqrt(np.einsum("ij,ij->i", away, away))


class _Best:
    """The k best candidates of each query so far: score, then smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, queries: np.ndarray) -> float:
        return float(self.score[queries, -1].min())

    def offer(self, queries: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of these queries (rows) with candidates ``ids`` (columns); -inf where none."""
        better = (score >= self.score[queries, -1:]) & (score > -np.inf)
        for row in np.flatnonzero(better.any(axis=1)):
            q, take = queries[row], better[row]
            s, i = np.append(self.score[q], score[row, take]), np.append(self.id[q], ids[take])
            order = np.lexsort((i, -s))[: self.k]
            self.score[q], self.id[q] = s[order], i[order]


def dual_search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int = K) -> _Best:
    """The k best data ids of each query other than its own, by inner product; vectors as whole numbers in doubles."""
    best = _Best(len(queries), k)
    top, root = cover_tree(queries, QUERY_LEAF), cover_tree(data)
    if top is None or root is None:
        return best

    def push(centres, norms, radii, one, pairs):
        high = centres @ one.centre + norms * one.radius + one.norm * radii + radii * one.radius
        high += 1e-9 * np.abs(high) + 1e-6  # rounding must not prune
        for most, (q, x) in zip(high.tolist(), pairs):
            if q.worst <= most:  # an equal score may still win by its id
                heapq.heappush(waiting, (-most, next(order), q, x))

    order, waiting = itertools.count(), []
    push(root.centre[None], np.array([root.norm]), np.array([root.radius]), top, [(top, root)])
    while waiting:
        most, _, q, x = heapq.heappop(waiting)
        if q.worst > -most:
            continue
        if not q.children and not x.children:
            scores = queries[q.points] @ data[x.points].T
            ids = data_ids[x.points]
            scores[query_ids[q.points][:, None] == ids[None, :]] = -np.inf
            best.offer(q.points, scores, ids)
            q.worst = best.worst(q.points)
        elif q.children and (not x.children or q.radius > x.radius):
            for c in q.children:
                c.worst = max(c.worst, q.worst)
            q.worst = max(q.worst, min(c.worst for c in q.children))
            push(q.centres, q.norms, q.radii, x, [(c, x) for c in q.children])
        else:
            push(x.centres, x.norms, x.radii, q, [(q, c) for c in x.children])
    return best


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, x``: each usable vector, its components scaled and rounded down."""
    as_double = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        as_double, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    scaled = F.transform(as_double, lambda v: F.floor(v * F.lit(float(scale))))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("x"))


def _matrix(table: pa.Table, length: int) -> np.ndarray:
    flat = table.column("x").combine_chunks().flatten()
    return np.asarray(flat, dtype=np.int64).reshape(table.num_rows, length)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` that ``is_query`` (a condition on ``vec_id``) takes."""
    numbered = whole_vectors(vectors, scale).withColumn("row", F.monotonically_increasing_id())
    rows = stored(numbered.withColumns({"n": F.size("x"), "asks": F.coalesce(is_query, F.lit(False))}))
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    data_blocks, query_blocks = max(1, -(-n // DATA_BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    # by row, as an id may be frequent
    mix = F.xxhash64("row")
    # every block of queries meets every block of data, so a query is sent once per data block and the reverse
    every_query = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("q")
    every_data = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(data_blocks - 1).cast("long"))).alias("d")
    data = rows.select("vec_id", "x", "n", F.pmod(mix, F.lit(data_blocks)).alias("d"), every_query, F.lit(False).alias("asks"))
    asking = rows.filter("asks").select("vec_id", "x", "n", every_data, F.pmod(mix, F.lit(query_blocks)).alias("q"), "asks")
    met = data.unionByName(asking)

    def search(group: pa.Table) -> pa.Table:
        length = group.column("n")[0].as_py()
        mask = group.column("asks")
        own, other = group.filter(mask), group.filter(pc.invert(mask))
        asked_ids, ids = np.asarray(own.column("vec_id")), np.asarray(other.column("vec_id"))
        score, found = _search_block(_matrix(own, length), asked_ids, _matrix(other, length), ids, k)
        row, col = np.nonzero(found != np.iinfo(np.int64).max)
        return pa.table({"query_id": asked_ids[row], "vec_id": found[row, col], "score": score[row, col]})

    hits = met.groupBy("n", "d", "q").applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search_block(queries, query_ids, data, data_ids, k):
    """Scores and ids as 64-bit numbers; vectors too wide for doubles are scored with Python's whole numbers."""
    widest = max(int(np.abs(queries).max(initial=0)), int(np.abs(data).max(initial=0)))
    if widest < _WIDE and widest**2 * max(1, queries.shape[1]) < 1 << 53:
        best = dual_search(queries.astype(float), query_ids, data.astype(float), data_ids, k)
        score = np.where(np.isfinite(best.score), best.score, 0).astype(np.int64)
        return score, np.where(np.isfinite(best.score), best.id, np.iinfo(np.int64).max)
    score = np.zeros((len(queries), k), np.int64)
    found = np.full((len(queries), k), np.iinfo(np.int64).max)
    for i, q in enumerate(queries.astype(object)):
        exact = sorted((-max(-_BOUND, min(_BOUND, int(q @ x))), int(v)) for x, v in zip(data.astype(object), data_ids) if v != query_ids[i])
        for j, (s, v) in enumerate(exact[:k]):
            score[i, j], found[i, j] = -s, v
    return score, found
