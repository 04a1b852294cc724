"""Pair joins, profiles and curve features against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from calib.functions import expr
from calib.operators import curves, pairs

SCHEMA = ("frame long, atom_id long, resname string, type string, element string, mass double, "
          "x double, y double, z double, bx double, by double, bz double")


def points(spark, xyz, box=10.0, frame=0):
    b = [box] * 3 if not isinstance(box, (list, tuple)) else [None if v is None else float(v) for v in box]
    return spark.createDataFrame(
        [(frame, i, "R", "T", "O", 16.0, *map(float, p), *b) for i, p in enumerate(xyz)], SCHEMA)


def brute(xyz, box, lo, hi):
    out = set()
    for i, p in enumerate(xyz):
        for j, q in enumerate(xyz):
            d = np.asarray(p) - np.asarray(q)
            if box is not None:
                d = d - np.round(d / box) * np.asarray(box)
            r = math.sqrt((d * d).sum())
            if (lo is None or r > lo) and r <= hi:
                out.add((i, j, round(r, 9)))
    return out


@pytest.mark.parametrize("box,cutoff,hot", [
    (10.0, 2.5, 20_000), (10.0, 4.0, 20_000), (10.0, 6.0, 3), (4.0, 2.0, 5), ((5.0, 9.0, 20.0), 3.0, 4)])
def test_pair_join_matches_brute_force(spark, box, cutoff, hot):
    rng = np.random.default_rng(2)
    lengths = np.array([box] * 3 if not isinstance(box, tuple) else box)
    xyz = rng.uniform(-1, 2, size=(60, 3)) * lengths
    xyz[:20] = xyz[0] + rng.normal(size=(20, 3)) * 0.2
    df = points(spark, xyz, list(lengths))
    got = pairs.pair_join(df, df, ["frame"], cutoff, 0.5, hot_cell_rows=hot).collect()
    assert len(got) == len({(r["atom_a"], r["atom_b"]) for r in got})
    assert {(r["atom_a"], r["atom_b"], round(r["distance"], 9)) for r in got} == brute(
        xyz, lengths, 0.5, cutoff)


def test_open_box(spark):
    rng = np.random.default_rng(3)
    xyz = rng.normal(size=(40, 3)) * 3
    df = points(spark, xyz, [None] * 3)
    got = pairs.pair_join(df, df, ["frame"], 2.0)
    assert {(r["atom_a"], r["atom_b"], round(r["distance"], 9)) for r in got.collect()} == brute(
        xyz, None, None, 2.0)


def test_wrap(spark):
    df = points(spark, [(0.5, 0, 0), (9.5, 0, 0)])
    got = pairs.clash_pairs(df, ["frame"], 1.5).first()
    assert math.isclose(got["distance"], 1.0)


def test_single_shell(spark):
    df = points(spark, [(0, 0, 0), (2.5, 0, 0)])
    g = curves.pair_profile(df.where("atom_id = 0"), df.where("atom_id = 1"), ["frame"],
                            r_range=(0, 10), n_bins=10, smooth=False).orderBy("bin").collect()
    want = 1 / (1 / 1000 * 4 * math.pi / 3 * (27 - 8))
    assert [round(r["value"], 9) for r in g] == [0, 0, round(want, 9)] + [0] * 7


@pytest.mark.parametrize("h,n", [((1, 0, 0), 1), ((0.5, 0.87, 0), 0)])
def test_triples(spark, h, n):
    d = points(spark, [(0, 0, 0), h, (2.8, 0, 0)])
    links = spark.createDataFrame([(1, 0)], "hydrogen long, donor long")
    got = pairs.bonded_triples(d.where("atom_id = 0"), d.where("atom_id = 1"),
                               d.where("atom_id = 2"), links, ["frame"])
    assert got.count() == n
    if n:
        assert math.isclose(got.first()["angle"], 180.0)


def test_rates_are_zero_filled(spark):
    rows = []
    for f in range(4):
        rows += [(f, 0, "MOL", "O0", "O", 16.0, 0.0, 0.0, 0.0, 40.0, 40.0, 40.0),
                 (f, 1, "MOL", "HW", "H", 1.0, 1.0, 0.0, 0.0, 40.0, 40.0, 40.0),
                 (f, 2, "SOL", "O2", "O", 16.0, 15.0, 0.0, 0.0, 40.0, 40.0, 40.0),
                 (f, 3, "SOL", "HW", "H", 1.0, 16.0, 0.0, 0.0, 40.0, 40.0, 40.0)]
    atoms = spark.createDataFrame(rows, SCHEMA)
    bonds = spark.createDataFrame([(1, 0), (3, 2)], "a long, b long")
    got = curves.event_rates(atoms, bonds, ["frame"], "resname='MOL'", "resname='SOL'").collect()
    assert {(r["label"], r["value"]) for r in got} == {
        ("MOL(O0) to SOL(O2)", 0.0), ("SOL(O2) to MOL(O0)", 0.0)}


@pytest.mark.parametrize("lo,hi,n", [(0.0, 0.1, 10), (0.0, 10.0, 200), (-1.0, 2.0, 7), (0.3, 0.9, 6)])
def test_histogram_matches_numpy(spark, lo, hi, n):
    edges = np.linspace(lo, hi, n + 1)
    v = np.concatenate([edges, np.nextafter(edges, 99), np.nextafter(edges, -99),
                        np.random.default_rng(0).uniform(lo - 1, hi + 1, 300)])
    df = spark.createDataFrame([("a", float(x)) for x in v], "k string, v double")
    got = curves.histogram(df, "v", ["k"], (lo, hi), n).orderBy("bin").collect()
    assert [r["count"] for r in got] == np.histogram(v, range=(lo, hi), bins=n)[0].tolist()


def test_empty_histogram_stays_zero(spark):
    df = points(spark, [(0, 0, 0), (3, 0, 0)])
    got = curves.distance_distribution(df.where("atom_id=0"), df.where("atom_id=1"), ["frame"], [],
                                       ["type"], (0.0, 2.0), 4)
    assert got.count() == 0 or got.agg(F.sum("value")).first()[0] == 0.0


def curve(spark, y):
    return spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(y)],
                                 "curve_id string, bin int, value double")


def test_effective_observations(spark):
    ask = lambda y, n: curves.effective_observations(
        curve(spark, y), ["curve_id"], 0.1, n).first()["n_eff"]
    assert ask([1.0] * 25, 25) == 1.0
    x = np.linspace(-3, 3, 101)
    assert ask(np.exp(-x ** 2), 101) > 1.0
    with pytest.raises(ValueError):
        curves.effective_observations(curve(spark, [1.0] * 10), ["curve_id"], 0.1, 10)
    with pytest.raises(ValueError):
        curves.effective_observations(curve(spark, [1.0] * 25), ["curve_id"], 0.0, 25)
    with pytest.raises(Exception, match="finite"):
        ask([float("nan")] * 12, 12)


def peaks_by_hand(y):
    out, i = [], 1
    while i < len(y) - 1:
        j = i
        while j + 1 < len(y) and y[j + 1] == y[i]:
            j += 1
        if y[i - 1] < y[i] and j + 1 < len(y) and y[j + 1] < y[i]:
            p = (i + j) // 2
            left = right = y[p]
            k = p
            while k >= 0 and y[k] <= y[p]:
                left, k = min(left, y[k]), k - 1
            k = p
            while k < len(y) and y[k] <= y[p]:
                right, k = min(right, y[k]), k + 1
            out.append((p, y[p], y[p] - max(left, right)))
        i = j + 1
    return out


def test_peaks_with_flat_tops(spark):
    rng = np.random.default_rng(5)
    for y in ([0, 1, 1, 1, 0, 2, 2, 0, 3, 3], [1, 2], [3, 1, 2, 1, 3], rng.integers(0, 5, 60).tolist()):
        got = curves.curve_peaks(curve(spark, y), ["curve_id"]).orderBy("bin").collect()
        assert [(r["bin"], r["height"], r["prominence"]) for r in got] == peaks_by_hand(y)


def test_savgol_reproduces_cubics_and_edges(spark):
    x = np.arange(31) / 5
    y = 1 + x - 0.5 * x ** 2 + 0.1 * x ** 3
    got = curves.smooth_savgol(curve(spark, y), ["curve_id"], 31).orderBy("bin").collect()
    assert np.allclose([r["value"] for r in got], y)
    noisy = y + np.random.default_rng(0).normal(size=31)
    got = [r["value"] for r in curves.smooth_savgol(curve(spark, noisy), ["curve_id"], 31).orderBy("bin").collect()]
    fit = lambda s, at: np.polyval(np.polyfit(np.arange(15), noisy[s:s + 15], 3), at)
    want = [fit(min(max(i - 7, 0), 16), i - min(max(i - 7, 0), 16)) for i in range(31)]
    assert np.allclose(got, want)


@pytest.mark.parametrize("n", [5, 12, 40])
def test_gaussian_smoothing_mirrors(spark, n):
    y = np.random.default_rng(n).normal(size=n)
    got = [r["value"] for r in curves.smooth_gaussian(curve(spark, y), ["curve_id"]).orderBy("bin").collect()]
    w = expr.gaussian_weights(3.0)
    padded = np.pad(y, 12, mode="symmetric")
    assert np.allclose(got, [w @ padded[i:i + 25] for i in range(n)])


def test_interpolation_matches_numpy(spark):
    x, y = np.array([0.0, 1.0, 2.5, 4.0]), np.array([1.0, -1.0, 3.0, 0.0])
    grid = np.linspace(-1, 5, 37)
    df = spark.createDataFrame([("c", float(a), float(b)) for a, b in zip(x, y)],
                               "curve_id string, x double, value double")
    got = curves.interpolate(df, ["curve_id"], grid.tolist()).orderBy("bin").collect()
    assert np.allclose([r["value"] for r in got], np.interp(grid, x, y))
    one = df.where("x = 1.0")
    assert {r["value"] for r in curves.interpolate(one, ["curve_id"], grid.tolist()).collect()} == {-1.0}


def test_frame_slices(spark):
    df = spark.range(10).withColumnRenamed("id", "frame")
    for args in ((None, None, 1), (1, None, 3), (0, -1, 2), (-4, -1, 1), (2, 0, 1), (-99, 3, 1)):
        got = sorted(r["frame"] for r in pairs.slice_frames(df, *args).collect())
        assert got == list(range(10))[args[0]:args[1]:args[2]]


def test_box_rules(spark):
    frames = spark.createDataFrame([(90.0, 90.0, 90.0)], "alpha double, beta double, gamma double")
    assert pairs.require_orthorhombic(frames).count() == 1
    with pytest.raises(Exception, match="orthorhombic"):
        pairs.require_orthorhombic(frames.withColumn("beta", F.lit(80.0))).collect()
    with pytest.raises(Exception, match="no usable box"):
        spark.range(1).select(expr.usable_box(F.array(F.lit(1.0), F.lit(0.0), F.lit(1.0)))).collect()
