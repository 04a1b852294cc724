"""Approximate nearest neighbours by collision counting.

Every row is projected on ``LINES`` random directions; each projection is one sorted
array.  Around the query's own projection a window is opened in every array, and a row
collides once for each window that holds it.  Virtual rehashing widens all windows with
the search radius; only the places that a wider window adds are counted.  A row whose
collisions reach ``HITS`` is verified: its distance is computed on the original vectors.
The search ends when the k-th distance found, or the one that another shard has found,
is not beyond the radius; otherwise it goes on until every row has been verified.  Where
another shard's distance is known, the first radius is the one that reaches it: a wider
window holds all that a narrower one holds, so no row is lost.

A row at the radius lies in a window with probability 0.683; with 48 arrays it has 26
collisions or more with probability 0.98, and a row at twice the radius with 0.02.

Defined cases: vectors that are NULL, empty, zero, or hold NULL or non-finite components
take no part; equal distances go to the smaller id; a query with fewer candidates
returns them all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calib.llm.search import search, usable

LINES, HITS = 48, 26
GROWTH = 1.12
SEED = 11


class Arrays:
    """The sorted projections of one shard, one behind another on a single axis."""

    def __init__(self, rows: np.ndarray):
        n, dim = rows.shape
        self.n = n
        self.squares = (rows ** 2).sum(1)
        self.spread = float(np.sqrt(((rows - rows.mean(0)) ** 2).sum(1).mean()))
        self.lines = np.random.default_rng(SEED).normal(size=(dim, LINES))
        values = (rows @ self.lines).T
        self.order = np.argsort(values, 1, kind="stable")
        values = np.take_along_axis(values, self.order, 1)
        self.low, self.high = values[:, 0], values[:, -1]
        # Each array is moved past the one before, so that one search serves them all.
        self.shift = np.cumsum(self.high - self.low + 1) - (self.high - self.low + 1) - self.low
        self.flat = (values + self.shift[:, None]).ravel()
        self.first = np.arange(LINES) * n

    def window(self, centre: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """Places [from, to) in ``order`` of the rows within ``half`` of the centre, per array."""
        left = np.clip(centre - half, self.low, self.high) + self.shift
        right = np.clip(centre + half, self.low, self.high) + self.shift
        start = np.searchsorted(self.flat, left, side="left")
        stop = np.searchsorted(self.flat, right, side="right")
        start = np.where(centre - half > self.high, self.first + self.n, start)
        stop = np.where(centre + half < self.low, self.first, stop)
        return np.maximum(start, self.first), np.minimum(stop, self.first + self.n)


def nearest(arrays: Arrays, q_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, ids: np.ndarray,
            rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of query and row, and distances, of the k nearest rows found per query."""
    order = arrays.order.ravel()
    centres = queries @ arrays.lines
    out_q, out_r, out_d = [], [], []
    for i, q in enumerate(queries):
        hits = np.zeros(arrays.n, np.int64)
        seen = ids == q_ids[i]
        found = np.zeros(0, np.int64)
        dist = np.zeros(0)
        radius = arrays.spread / 8 if arrays.spread > 1e-300 else 1.0
        while radius < bounds[i] < np.inf:
            radius *= GROWTH
        square, kth = q @ q, bounds[i]
        old = None
        while True:
            start, stop = arrays.window(centres[i], radius)
            if old is None:
                new = [order[a:b] for a, b in zip(start, stop)]
            else:
                new = [order[a:b] for a, b in zip(start, old[0])] + [
                    order[a:b] for a, b in zip(old[1], stop)]
            old = (start, np.maximum(stop, start))
            hits += np.bincount(np.concatenate(new), minlength=arrays.n)
            fresh = np.flatnonzero((hits >= HITS) & ~seen)
            if len(fresh):
                seen[fresh] = True
                # Rows surely beyond the k-th known, with room for rounding, are not measured exactly.
                with np.errstate(over="ignore", invalid="ignore"):
                    size = arrays.squares[fresh] + square
                    beyond = size - 2 * (rows[fresh] @ q) - 1e-9 * size > kth * kth
                fresh = fresh[~beyond]
                found = np.concatenate([found, fresh])
                dist = np.concatenate([dist, np.sqrt(((rows[fresh] - q) ** 2).sum(1))])
                if len(found) > 4 * k:
                    best = np.lexsort((found, dist))[:k]
                    found, dist = found[best], dist[best]
            kth = min(np.partition(dist, k - 1)[k - 1] if len(dist) >= k else np.inf, bounds[i])
            if kth <= radius or seen.all():
                break
            radius *= GROWTH
        best = np.lexsort((found, dist))[:k]
        best = best[dist[best] <= bounds[i]]
        out_q.append(np.full(len(best), i))
        out_r.append(found[best])
        out_d.append(dist[best])
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_d)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id",
                       vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found per query row."""
    def plain(df: DataFrame) -> DataFrame:
        return df.where(usable(df, vec) & F.col(f"`{key}`").isNotNull()).select(
            F.col(f"`{key}`").cast("long").alias("vec_id"),
            F.transform(f"`{vec}`", lambda x: x.cast("double")).alias("v")).where(
            F.exists("v", lambda x: x != 0))

    return search(plain(vectors), plain(queries), k, Arrays, nearest, largest=False)
