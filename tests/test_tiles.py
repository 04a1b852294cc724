"""Weights from stored tiles against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from calib.operators import surrogate, tiles

HYPER = "qoi string, member int, lengths array<double>, width double, noise double"


def training(spark, n, m, seed=0, qois=("a",), repeated=False):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 2, size=(n, 2))
    if repeated:
        x[n // 2:] = x[:n - n // 2]
    y = np.sin(x @ rng.normal(size=(2, m))) + 0.01 * rng.normal(size=(n, m))
    train_x = spark.createDataFrame(pd.DataFrame({"train_id": np.arange(n) * 3, "params": list(map(list, x))}))
    values = pd.DataFrame({
        "train_id": np.repeat(np.arange(n) * 3, m), "pos": np.tile(np.arange(m, dtype=np.int32), n), "value": y.ravel()})
    frames = [spark.createDataFrame(values).withColumn("qoi", F.lit(q)).withColumn(
        "value", F.col("value") * (k + 1)) for k, q in enumerate(qois)]
    train_y = frames[0]
    for f in frames[1:]:
        train_y = train_y.unionByName(f)
    return x, y, train_x, train_y


def table(df, n, m):
    rows = df.toPandas().sort_values(["train_id", "pos"])
    assert len(rows) == n * m
    return rows["alpha"].to_numpy().reshape(n, m)


@pytest.mark.parametrize("tile", [7, 10, 100])
def test_equal_to_the_dense_solve(spark, tile):
    _, _, train_x, train_y = training(spark, 30, 3, qois=("a", "b"))
    # One QoI lacks some training rows.
    train_y = train_y.where("qoi = 'a' OR train_id < 60")
    hyper = spark.createDataFrame([("a", 0, [1.0, 0.5], 1.5, 0.1), ("a", 1, [0.7, 2.0], 1.0, 0.01),
                                   ("b", 0, [1.0, 1.0], 2.0, 0.05)], HYPER)
    mean = spark.createDataFrame([("a", [0.25]), ("b", [0.1, 0.2, 0.3])], "qoi string, mean array<double>")
    got = tiles.tile_weights(train_x, train_y, hyper, mean, tile).toPandas()
    want = surrogate.weight_table(surrogate.solve_weights(
        surrogate.training_sets(train_x, train_y), hyper, mean)).toPandas()
    key = ["qoi", "member", "train_id", "pos"]
    got, want = (f.sort_values(key).reset_index(drop=True) for f in (got, want))
    assert len(got) == 30 * 3 * 2 + 20 * 3
    assert (got[key].astype(str) == want[key].astype(str)).all().all()
    np.testing.assert_allclose(got["alpha"], want["alpha"], rtol=1e-7, atol=1e-9)


def test_six_thousand_rows(spark):
    n, m = 6000, 4
    x, y, train_x, train_y = training(spark, n, m, seed=1)
    hyper = spark.createDataFrame([("a", 0, [0.8, 0.6], 1.2, 0.05)], HYPER)
    got = table(tiles.tile_weights(train_x, train_y, hyper), n, m)
    k = surrogate.kernel_matrix(x, x, np.array([0.8, 0.6]), 1.2) + 0.05 * np.eye(n)
    np.testing.assert_allclose(got, np.linalg.solve(k, y), rtol=1e-6, atol=1e-8)


def test_singular_kernel_is_shifted(spark):
    n, m = 24, 2
    x, y, train_x, train_y = training(spark, n, m, seed=2, repeated=True)
    hyper = spark.createDataFrame([("a", 0, [1.0, 1.0], 1.0, 0.0)], HYPER)
    got = table(tiles.tile_weights(train_x, train_y, hyper, tile=8), n, m)
    assert np.isfinite(got).all()


def test_no_rows(spark):
    _, _, train_x, train_y = training(spark, 4, 2)
    hyper = spark.createDataFrame([("a", 0, [1.0, 1.0], 1.0, 0.1)], HYPER)
    assert tiles.tile_weights(train_x, train_y.where("value > 1e9"), hyper).count() == 0
