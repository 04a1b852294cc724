"""Skewed boxes against all images of a wide block of cells."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from calib.operators import lattice, pairs

BOX = ("bx", "by", "bz", "alpha", "beta", "gamma")


def cell(a, b, c, alpha, beta, gamma):
    ca, cb, cg = (math.cos(math.radians(x)) for x in (alpha, beta, gamma))
    sg = math.sin(math.radians(gamma))
    y = (ca - cb * cg) / sg
    return np.array([[a, 0, 0], [b * cg, b * sg, 0], [c * cb, c * y, c * math.sqrt(1 - cb * cb - y * y)]])


BOXES = [(5, 6, 7, 90, 90, 90), (5, 5, 5, 60, 60, 60), (4, 6, 9, 65, 105, 60), (5, 5, 5, 109.47, 109.47, 109.47),
         (3, 8, 4, 75, 100, 120), (10, 3, 3, 90, 90, 35), (6, 6, 20, 80, 30, 90)]


def brute(p, q, box, reach=6):
    v = cell(*box)
    shifts = np.array(list(product(range(-reach, reach + 1), repeat=3))) @ v
    return np.sqrt((((p - q) + shifts) ** 2).sum(1).min())


@pytest.mark.parametrize("box", BOXES)
def test_reduced_cell(box):
    v = cell(*box)
    w = lattice.reduced_cell(v)
    turn = w @ np.linalg.inv(v)
    np.testing.assert_allclose(turn, np.rint(turn), atol=1e-9)
    assert abs(abs(np.linalg.det(turn)) - 1) < 1e-9
    for i in range(3):
        j, k = (m for m in range(3) if m != i)
        assert all(np.linalg.norm(w[i] + s * w[j] + t * w[k]) >= np.linalg.norm(w[i]) - 1e-9
                   for s, t in product((-1, 0, 1), repeat=2))


def frames(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for f, box in enumerate(BOXES):
        points = rng.uniform(-1, 2, size=(n, 3)) @ cell(*box)
        rows += [(f, i, *map(float, p), *map(float, box)) for i, p in enumerate(points)]
    return rows, spark.createDataFrame(rows, "frame int, atom_id int, x double, y double, z double, " + ", ".join(
        f"{b} double" for b in BOX))


@pytest.mark.parametrize("cutoff,hot", [(1.1, 20_000), (2.4, 20_000), (2.4, 3), (50.0, 20_000)])
def test_pairs_in_skewed_boxes(spark, cutoff, hot):
    rows, df = frames(spark, 16)
    a = lattice.with_lattice(df, ["frame"])
    got = {(r["frame"], r["atom_a"], r["atom_b"]): r["distance"] for r in pairs.pair_join(
        a.where("atom_id < 8"), a, ["frame"], cutoff, 0.0, hot_cell_rows=hot).collect()}
    want = {}
    for p in rows:
        for q in rows:
            if p[0] == q[0] and p[1] < 8:
                d = brute(np.array(p[2:5]), np.array(q[2:5]), p[5:])
                if 0 < d <= cutoff and p[1] != q[1]:
                    want[p[0], p[1], q[1]] = d
    got = {k: d for k, d in got.items() if k[1] != k[2]}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], d, rel_tol=1e-9) for k, d in want.items())


def test_each_pair_once_in_small_boxes(spark):
    _, df = frames(spark, 6, seed=3)
    a = lattice.with_lattice(df, ["frame"])
    pairs_ = pairs.pair_join(a, a, ["frame"], 2.0)
    assert pairs_.count() == pairs_.dropDuplicates(["frame", "atom_a", "atom_b"]).count()


def test_orthorhombic_box_agrees(spark):
    rows, df = frames(spark, 12)
    square = df.where("frame = 0")
    key = lambda d: sorted((r["atom_a"], r["atom_b"], round(r["distance"], 9)) for r in d.collect())
    a = lattice.with_lattice(square, ["frame"])
    assert key(pairs.pair_join(square, square, ["frame"], 2.2)) == key(pairs.pair_join(a, a, ["frame"], 2.2))


def test_hot_cells_of_both_sides(spark):
    one = spark.range(60).select(F.lit(0).alias("frame"), F.col("id").alias("atom_id"), *[
        (F.lit(1.0) + F.rand(k) / 100).alias(x) for k, x in enumerate("xyz")], *[F.lit(9.0).alias(b) for b in BOX[:3]])
    got = pairs.pair_join(one.where("atom_id < 30"), one,
                          ["frame"], 1.0, hot_cell_rows=7)
    assert got.select("atom_a", "atom_b").distinct().count() == got.count() == 30 * 60


def test_bad_boxes(spark):
    _, df = frames(spark, 2)
    with pytest.raises(Exception, match="span a volume"):
        lattice.with_lattice(df.withColumn("bz", F.lit(0.0)), ["frame"]).collect()
    with pytest.raises(Exception, match="two boxes"):
        lattice.with_lattice(df.withColumn("bx", F.col("bx") + F.col("atom_id")), ["frame"]).collect()
