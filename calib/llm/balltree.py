"""Exact search for the largest inner products with ball trees.

Each shard has a ball tree: nodes with a centre and a radius, split at the median along
the direction between two distant points.  For a query q the inner products below a node
are at most q.centre + |q| radius, and no more than any bound of the nodes above it.
Leaves are visited from the highest bound down, until the next bound lies below the k-th
score known so far.  Queries that start from a score other shards have found pass each
leaf together, those whose bound lies below their score left out.

Components become floor(scale * x) as whole numbers.  Products are exact while they stay
below 2^53; larger ones are rounded as doubles are, and end at the limits of a long.

Defined cases: vectors that are NULL, empty, or hold NULL or non-finite components take
no part; equal scores go to the smaller id; a query with fewer candidates returns them
all; zero vectors take part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calib.llm.search import best_of, search, usable

LEAF = 128
MOST = float((1 << 63) - 1024)


def build(rows: np.ndarray, leaf: int = LEAF) -> list[tuple[np.ndarray, list[tuple[np.ndarray, float]]]]:
    """The leaves: places of their rows, and (centre, radius) of the nodes from the root down."""
    leaves = []
    todo = [(np.arange(len(rows)), [])]
    while todo:
        at, path = todo.pop()
        own = rows[at]
        centre = own.mean(0)
        far = ((own - centre) ** 2).sum(1)
        path = [*path, (centre, float(np.sqrt(far.max())))]
        if len(at) <= leaf or far.max() == 0:
            leaves += [(part, path) for part in np.array_split(np.sort(at), -(-len(at) // leaf))]
            continue
        a = own[np.argmax(far)]
        b = own[np.argmax(((own - a) ** 2).sum(1))]
        along = np.argsort(own @ (b - a), kind="stable")
        half = len(at) // 2
        todo += [(at[along[:half]], path), (at[along[half:]], path)]
    return leaves


def leaf_bounds(queries: np.ndarray, leaves: list) -> np.ndarray:
    """Upper bounds (query, leaf) of the inner products, with room for rounding."""
    length = np.sqrt((queries ** 2).sum(1))
    known: dict[int, np.ndarray] = {}
    out = np.empty((len(queries), len(leaves)))
    for k, (_, path) in enumerate(leaves):
        bound = np.full(len(queries), np.inf)
        for node in path:
            if id(node) not in known:
                own = queries @ node[0] + length * node[1]
                known[id(node)] = own + 1e-9 * (np.abs(own) + length * node[1]) + 1e-6
            bound = np.minimum(bound, known[id(node)])
        out[:, k] = bound
    return out


def best_products(leaves: list, q_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, ids: np.ndarray,
                  rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of query and row, and scores, of the k best rows (in id order) per query."""
    upper = leaf_bounds(queries, leaves)
    known = np.flatnonzero(bounds > -np.inf)
    others = np.flatnonzero(bounds == -np.inf)
    parts = []
    for at, way in ((known, _passed), (others, _ordered)):
        if len(at):
            q, place, score = way(leaves, upper[at], q_ids[at], queries[at], bounds[at], ids, rows, k)
            parts.append((at[q], place, score))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _passed(leaves: list, upper: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray,
            ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf by leaf, all queries whose bound there reaches the score they start from."""
    limit = bounds.copy()
    q, place, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for leaf, (at, _) in enumerate(leaves):
        open_ = np.flatnonzero(upper[:, leaf] >= limit)
        if not len(open_):
            continue
        found = queries[open_] @ rows[at].T
        i, j = np.nonzero((found >= limit[open_][:, None]) & (ids[at][None, :] != q_ids[open_][:, None]))
        q, place, score = (np.concatenate(x) for x in (
            (q, open_[i]), (place, at[j]), (score, found[i, j])))
        if len(q) > 2 * k * len(queries):
            kept, last, full = best_of(q, place, score, k, True)
            limit[full] = np.maximum(limit[full], score[last])
            q, place, score = q[kept], place[kept], score[kept]
    kept, _, _ = best_of(q, place, score, k, True)
    return q[kept], place[kept], score[kept]


def _ordered(leaves: list, upper: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray,
             ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's leaves in order of its bounds."""
    n = len(queries)
    order = np.argsort(-upper, 1, kind="stable")
    score = np.full((n, k), -np.inf)
    place = np.full((n, k), len(ids), np.int64)
    for j in range(len(leaves)):
        leaf_of = order[:, j]
        limit = np.maximum(bounds, score[:, -1])
        open_ = np.flatnonzero(upper[np.arange(n), leaf_of] >= limit)
        if not len(open_):
            break
        for leaf in np.unique(leaf_of[open_]):
            q = open_[leaf_of[open_] == leaf]
            at = leaves[leaf][0]
            found = queries[q] @ rows[at].T
            found = np.where(ids[at][None, :] == q_ids[q][:, None], -np.inf, found)
            better = (found >= limit[q][:, None]).any(1)
            q, found = q[better], found[better]
            if not len(q):
                continue
            both = np.concatenate([score[q], found], 1)
            where = np.concatenate([place[q], np.broadcast_to(at, found.shape)], 1)
            by = np.argsort(where, 1, kind="stable")
            both, where = np.take_along_axis(both, by, 1), np.take_along_axis(where, by, 1)
            by = np.argsort(-both, 1, kind="stable")[:, :k]
            score[q], place[q] = np.take_along_axis(both, by, 1), np.take_along_axis(where, by, 1)
    q, slot = np.nonzero(np.isfinite(score) & (score >= bounds[:, None]))
    return q, place[q, slot], score[q, slot]


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64,
                 key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score long): the k largest inner products per query row."""
    def whole(df: DataFrame) -> DataFrame:
        return df.where(usable(df, vec) & F.col(f"`{key}`").isNotNull()).select(
            F.col(f"`{key}`").cast("long").alias("vec_id"),
            F.transform(f"`{vec}`", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))

    found = search(whole(vectors), whole(queries), k, build, best_products, largest=True)
    held = F.greatest(F.least("score", F.lit(MOST)), F.lit(-MOST))
    return found.withColumn("score", held.cast("long"))
