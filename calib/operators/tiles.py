"""Exact surrogate weights for training sets of any size, by a Cholesky factor of stored tiles.

The kernel matrix is cut into tiles of ``tile`` training rows.  Column after column, a tile of
the factor is its kernel tile less the products of earlier tiles, solved against the diagonal
one; kernel tiles are made where they are used and never stored.  The outputs ride along as
one more row of tiles, which gives the forward substitution for nothing.  A task holds three
tiles at a time, whatever the number of training rows; all models of all QoIs advance together.

A diagonal tile that is not positive definite is shifted by 1e-8 less its smallest eigenvalue,
as the dense solve shifts the whole matrix.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calib.operators.ordering import attach, number_rows
from calib.operators.surrogate import kernel_matrix
from calib.session import bounded_batches, materialize, scratch_dir

TILE = 1024
MODEL = ["qoi", "member"]
OUTPUTS = 1 << 30  # the row of tiles that holds the outputs
TILES = "qoi string, member int, i int, cols int, data binary"


def training_blocks(train_x: DataFrame, train_y: DataFrame, mean: DataFrame | None = None,
                    tile: int = TILE) -> DataFrame:
    """(qoi, block, ids, xs, ys): ``tile`` training rows each, inputs and centred outputs flattened."""
    values = train_y
    if mean is not None:
        own = F.when(F.size("mean") == 1, F.get("mean", F.lit(0))).otherwise(F.get("mean", F.col("pos")))
        values = attach(train_y, mean.select("qoi", "mean"), ["qoi"]).withColumn("value", F.col("value") - own)
    rows = values.groupBy("qoi", "train_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("c")).join(train_x, "train_id").select(
        "qoi", "train_id", "params", F.col("c.value").alias("y"))
    placed = number_rows(rows, ["qoi"], ["train_id"], "place").withColumn(
        "block", F.floor((F.col("place") - 1) / tile).cast("int"))
    return placed.groupBy("qoi", "block").agg(
        F.array_sort(F.collect_list(F.struct("train_id", "params", "y"))).alias("r")).select(
        "qoi", "block", F.col("r.train_id").alias("ids"), F.flatten("r.params").alias("xs"),
        F.flatten("r.y").alias("ys"))


def _matrix(column: pa.Array, row: int, cols: int) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), float).reshape(-1, cols)


def _flat(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False).astype(float)


def _tile_batch(key: tuple, i: int, tile: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([i], pa.int32()),
         pa.array([tile.shape[1]], pa.int32()), pa.array([np.ascontiguousarray(tile).tobytes()], pa.binary())],
        ["qoi", "member", "i", "cols", "data"])


def _open_tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column k less what earlier columns explain: rows of one (model, i) follow each other.

    The first row of each holds its training blocks, the others pairs of factor tiles.
    """
    key, acc = None, None
    for batch in batches:
        names = [batch.column(c).to_pylist() for c in ("qoi", "member", "i", "j", "k", "width", "noise", "cols")]
        for r, (qoi, member, i, j, k, width, noise, cols) in enumerate(zip(*names)):
            if j >= 0:
                acc -= _matrix(batch.column("left"), r, cols) @ _matrix(batch.column("right"), r, cols).T
                continue
            if key is not None:
                yield _tile_batch(key[:2], key[2], acc)
            key = (qoi, member, i)
            lengths = _flat(batch.column("lengths"), r)
            mine = _flat(batch.column("mine"), r).reshape(-1, len(lengths))
            if i == OUTPUTS:
                acc = _flat(batch.column("other"), r).reshape(len(mine), -1).T.copy()
            else:
                acc = kernel_matrix(_flat(batch.column("other"), r).reshape(-1, len(lengths)), mine, lengths, width)
                if i == k:
                    acc = 0.5 * (acc + acc.T) + noise * np.eye(len(mine))
    if key is not None:
        yield _tile_batch(key[:2], key[2], acc)


def root_of(tile: np.ndarray) -> np.ndarray:
    """The lower Cholesky factor of a diagonal tile."""
    try:
        return np.linalg.cholesky(tile)
    except np.linalg.LinAlgError:
        low = np.linalg.eigvalsh(tile)[0]
        return np.linalg.cholesky(tile + (1e-8 - low) * np.eye(len(tile)))


def _factor_tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of a factor column from the open tiles and their model's diagonal one."""
    model, root = None, None
    for batch in batches:
        names = [batch.column(c).to_pylist() for c in ("qoi", "member", "i", "k", "cols")]
        for r, (qoi, member, i, k, cols) in enumerate(zip(*names)):
            if model != (qoi, member):
                model, root = (qoi, member), root_of(_matrix(batch.column("diagonal"), r, cols))
            tile = root if i == k else np.linalg.solve(root, _matrix(batch.column("data"), r, cols).T).T
            yield _tile_batch(model, i, tile)


def _explained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factor tile (i, k) transposed times the weights of block i."""
    for batch in batches:
        names = [batch.column(c).to_pylist() for c in ("qoi", "member", "i", "cols", "width")]
        for r, (qoi, member, i, cols, width) in enumerate(zip(*names)):
            yield _tile_batch((qoi, member), i, _matrix(batch.column("data"), r, cols).T
                              @ _matrix(batch.column("alpha"), r, width))


def _back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of block k: the outputs come first, then what later blocks explain, the diagonal last."""
    acc = None
    for batch in batches:
        names = [batch.column(c).to_pylist() for c in ("qoi", "member", "i", "k", "cols")]
        for r, (qoi, member, i, k, cols) in enumerate(zip(*names)):
            tile = _matrix(batch.column("data"), r, cols)
            if i == OUTPUTS:
                acc = tile.T.copy()
            elif i == k:
                yield _tile_batch((qoi, member), k, np.linalg.solve(tile.T, acc))
            else:
                acc -= tile


def solve_tiles(blocks: DataFrame, hyper: DataFrame) -> DataFrame:
    """(qoi, member, block, cols, data): the weights of each training block, as bytes of doubles.

    ``blocks`` as ``training_blocks`` gives them; ``hyper``: qoi, member, lengths, width, noise.
    """
    spark = blocks.sparkSession
    bounded_batches(spark)
    folder = f"{scratch_dir(spark)}/tiles-{uuid.uuid4().hex}"
    models = hyper.select("qoi", F.col("member").cast("int").alias("member"), "lengths", "width", "noise")
    last = blocks.agg(F.max("block")).first()[0]
    steps = range(0 if last is None else last + 1)

    def stored(name: str) -> DataFrame:
        return spark.read.schema(f"{TILES}, j int").parquet(f"{folder}/{name}")

    for k in steps:
        mine = blocks.where(F.col("block") == k).join(models, "qoi")
        mine = mine.select(*MODEL, "lengths", "width", "noise", F.col("xs").alias("mine"), "ys")
        none = F.lit(None).cast("binary")
        kernel = mine.drop("ys").join(blocks.where(F.col("block") >= k).select(
            "qoi", F.col("block").alias("i"), F.col("xs").alias("other")), "qoi")
        outputs = mine.withColumnRenamed("ys", "other").withColumn("i", F.lit(OUTPUTS))
        first = kernel.unionByName(outputs).select(
            *MODEL, "i", F.lit(-1).alias("j"), F.lit(k).alias("k"), "lengths", "width", "noise", "mine", "other",
            F.lit(0).alias("cols"), none.alias("left"), none.alias("right"))
        rows = first
        if k:
            done = stored("factor")
            pairs = done.where(F.col("i") >= k).join(done.where(F.col("i") == k).select(
                *MODEL, "j", F.col("data").alias("right")), [*MODEL, "j"])
            empty = F.lit(None).cast("array<double>")
            rows = first.unionByName(pairs.select(
                *MODEL, "i", "j", F.lit(k).alias("k"), empty.alias("lengths"), F.lit(0.0).alias("width"),
                F.lit(0.0).alias("noise"), empty.alias("mine"), empty.alias("other"), "cols",
                F.col("data").alias("left"), "right"))
        open_ = materialize(rows.repartition(*MODEL, "i").sortWithinPartitions(*MODEL, "i", "j").mapInArrow(
            _open_tiles, TILES), "open")
        diagonal = open_.where(F.col("i") == k).select(*MODEL, F.col("data").alias("diagonal"))
        open_.join(diagonal, MODEL).withColumn("k", F.lit(k)).repartition(*MODEL, "i").sortWithinPartitions(
            *MODEL).select(*MODEL, "i", "k", "cols", "data", "diagonal").mapInArrow(_factor_tiles, TILES).write.parquet(
            f"{folder}/factor/j={k}")
    for k in reversed(steps):
        column = stored("factor").where(F.col("j") == k)
        own = column.where(F.col("i").isin(OUTPUTS, k)).select(*MODEL, "i", "cols", "data")
        if k < last:
            alpha = stored("weights").select(*MODEL, "i", F.col("cols").alias("width"), F.col("data").alias("alpha"))
            more = column.where(F.col("i") > k).join(alpha, [*MODEL, "i"]).select(
                *MODEL, "i", "cols", "width", "data", "alpha").mapInArrow(_explained, TILES)
            own = own.unionByName(more)
        order = F.when(F.col("i") == OUTPUTS, 0).when(F.col("i") == k, 2).otherwise(1)
        own.withColumns({"k": F.lit(k), "turn": order}).repartition(*MODEL).sortWithinPartitions(
            *MODEL, "turn").mapInArrow(_back, TILES).write.parquet(f"{folder}/weights/j={k}")
    if not steps:
        return spark.createDataFrame([], "qoi string, member int, block int, cols int, data binary")
    return stored("weights").select(*MODEL, F.col("i").alias("block"), "cols", "data")


def tile_weights(train_x: DataFrame, train_y: DataFrame, hyper: DataFrame, mean: DataFrame | None = None,
                 tile: int = TILE) -> DataFrame:
    """(qoi, member, train_id, pos, alpha) of training sets of any size."""
    blocks = materialize(training_blocks(train_x, train_y, mean, tile), "blocks")
    rows = solve_tiles(blocks, hyper).join(blocks.select("qoi", "block", "ids"), ["qoi", "block"])

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, (qoi, member, cols) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("qoi", "member", "cols")])):
                alpha = _matrix(batch.column("data"), r, cols)
                n = alpha.size
                ids = np.repeat(batch.column("ids")[r].values.to_numpy(), cols)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([qoi] * n, pa.string()), pa.array(np.full(n, member, np.int32)), pa.array(ids),
                     pa.array(np.tile(np.arange(cols, dtype=np.int32), len(alpha))), pa.array(alpha.ravel())],
                    ["qoi", "member", "train_id", "pos", "alpha"])

    return rows.select("qoi", "member", "cols", "data", "ids").mapInArrow(
        spread, "qoi string, member int, train_id long, pos int, alpha double")
