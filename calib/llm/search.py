"""Frame of the vector searches: shards of rows, tasks that hold a few, a shared k-th score.

Rows are dealt to shards by the hash of their id, so that equal or clustered vectors
spread evenly.  A task holds one or more shards, builds their indexes once, and then reads
its queries as a stream of blocks; rows and queries reach it in one sorted shuffle, none
through the driver.  In a first round each query searches the shard of its own id, and the
k-th value found is a bound that it starts from in all other shards in the second round;
what a task returns is then at most k rows per query, merged by query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calib.llm.blocks import bounded_batches
from calib.session import materialize

SHARD_ROWS = 8192
BLOCK_ROWS = 1024
#: Shards that one task holds at most; tasks of a round, which more shards than both allow exceed.
TASK_SHARDS = 8
TASKS = 32

#: row vectors -> index of a shard
Build = Callable[[np.ndarray], Any]
#: (index, query ids, query vectors, bounds, row ids, row vectors, k) -> (query places, row places, scores)
Find = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable(vectors: DataFrame, vec: str) -> Column:
    """Not NULL or empty, and all components finite."""
    v = F.col(f"`{vec}`")
    wide = F.transform(v, lambda x: x.cast("double"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(
        wide, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def best_of(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int, largest: bool
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the k best entries of each query, those that are a k-th, and its query."""
    by = np.lexsort((ids, -score if largest else score, q))
    starts = np.flatnonzero(np.r_[True, np.diff(q[by]) != 0]) if len(by) else by
    rank = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
    last = by[rank == k - 1]
    return by[rank < k], last, q[last]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(dim, shard, rows): parts of a batch with one length of vectors and one shard."""
    dim, shard = (np.asarray(batch.column(c)) for c in ("dim", "shard"))
    cuts = np.flatnonzero((np.diff(dim) != 0) | (np.diff(shard) != 0)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
        if b > a:
            yield int(dim[a]), int(shard[a]), batch.slice(int(a), int(b - a))


def _matrix(parts: list[pa.RecordBatch], dim: int) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate([np.asarray(p.column("vec_id")) for p in parts]),
            np.concatenate([np.asarray(p.column("v").flatten()).reshape(-1, dim) for p in parts]))


def search(rows: DataFrame, queries: DataFrame, k: int, build: Build, find: Find, largest: bool) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of each query.

    ``rows`` and ``queries`` hold (vec_id, v array<double>); a query never meets the rows
    with its own id.  Vectors of different lengths never meet.  ``largest`` tells whether
    a higher score is better; ties go to the smaller id.
    """
    bounded_batches(rows.sparkSession)
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    tasks = -(-shards // min(TASK_SHARDS, -(-shards // TASKS)))
    # Few shards: queries are dealt to groups, and every group has its own copy of the rows.
    groups = max(1, min(TASKS // tasks, -(-queries.count() // BLOCK_ROWS)))
    worst = float("-inf") if largest else float("inf")

    def answers(shard_indexes: list, asked: pa.RecordBatch, dim: int, at_home: bool) -> pa.RecordBatch:
        q_ids, vectors = _matrix([asked], dim)
        bounds, home = (np.array(asked.column(c)) for c in ("limit", "home"))
        q, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for shard, r_ids, r_vectors, index in shard_indexes:
            ask = np.flatnonzero((home == shard) == at_home)
            if not len(ask):
                continue
            more_q, more_r, more = find(index, q_ids[ask], vectors[ask], bounds[ask], r_ids, r_vectors, k)
            q, ids, score = (np.concatenate(x) for x in (
                (q, ask[more_q]), (ids, r_ids[more_r]), (score, more)))
            kept, last, full = best_of(q, ids, score, k, largest)
            bounds[full] = (np.maximum if largest else np.minimum)(bounds[full], score[last])
            q, ids, score = q[kept], ids[kept], score[kept]
        return pa.RecordBatch.from_arrays(
            [pa.array(q_ids[q]), pa.array(ids), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

    def met(asked: DataFrame, parts: int, at_home: bool) -> DataFrame:
        def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, now, of_now = [], None, []
            for batch in batches:
                for dim, shard, part in _runs(batch):
                    if (dim, shard) != now:
                        if of_now:
                            ids, vectors = _matrix(of_now, now[0])
                            held.append((now[1], ids, vectors, build(vectors)))
                        if now is not None and dim != now[0]:
                            held = []
                        now, of_now = (dim, shard), []
                    if shard < shards:
                        of_now.append(part)
                        continue
                    for start in range(0, part.num_rows, BLOCK_ROWS):
                        yield answers(held, part.slice(start, BLOCK_ROWS), dim, at_home)

        shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
        copies = F.sequence(F.lit(0), F.lit(parts - 1))
        held_rows = rows.select("vec_id", "v", shard.alias("shard"), F.lit(None).cast("int").alias("home"),
                                F.lit(None).cast("double").alias("limit"), F.explode(copies).alias("group")).withColumn(
            "task", F.pmod("shard", F.lit(tasks)) * parts + F.col("group")).drop("group")
        group = F.pmod(F.hash("vec_id"), F.lit(parts))
        places = F.array(F.pmod(shard, F.lit(tasks))) if at_home else F.sequence(F.lit(0), F.lit(tasks - 1))
        # Queries come behind the rows of all shards.
        sent = asked.select("vec_id", "v", F.lit(shards).alias("shard"), shard.alias("home"), "limit",
                            F.explode(places).alias("t")).withColumn(
            "task", F.col("t") * parts + group).drop("t")
        return held_rows.unionByName(sent).withColumn("dim", F.size("v")).repartitionById(
            tasks * parts, F.col("task").cast("int")).sortWithinPartitions("dim", "shard", "vec_id").mapInArrow(
            emit, "query_id long, vec_id long, score double")

    found = met(queries.withColumn("limit", F.lit(worst)), 1, True)
    if shards > 1:
        first = materialize(found, "first")
        kth = first.groupBy("query_id").agg(
            (F.min if largest else F.max)("score").alias("kth"), F.count(F.lit(1)).alias("n")).where(
            F.col("n") >= k)
        limited = queries.join(kth.hint("merge"), F.col("vec_id") == F.col("query_id"), "left").select(
            "vec_id", "v", F.coalesce("kth", F.lit(worst)).alias("limit"))
        found = first.unionByName(met(limited, groups, False))
    order = Window.partitionBy("query_id").orderBy(
        F.desc("score") if largest else F.asc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
