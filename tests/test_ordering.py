"""Distributed positions, totals and quantiles against numpy; small groups force the paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from calib.operators import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; values have many ties."""
    rng = np.random.default_rng(0)
    data = [("hot", int(i), float(v)) for i, v in enumerate(rng.integers(0, 40, 3000))]
    data += [(f"k{i % 7}", int(i), float(v)) for i, v in enumerate(rng.normal(size=500).round(2))]
    data += [(None, i, float(i % 3)) for i in range(50)]
    return spark.createDataFrame(data, "k string, id long, v double").repartition(5).cache()


def ranks(rows):
    out = {}
    for k in {r["k"] for r in rows}:
        group = sorted((r for r in rows if r["k"] == k), key=lambda r: (r["v"], r["id"]))
        out.update({(k, r["id"]): i + 1 for i, r in enumerate(group)})
    return out


@pytest.mark.parametrize("window_rows", [10, 10_000])
def test_number_rows(skewed, window_rows):
    got = ordering.number_rows(skewed, ["k"], ["v", "id"], "n", window_rows).collect()
    want = ranks(skewed.collect())
    assert {(r["k"], r["id"]): r["n"] for r in got} == want


@pytest.mark.parametrize("window_rows", [10, 10_000])
def test_running_total(skewed, window_rows):
    got = ordering.running_total(
        skewed.withColumn("one", F.lit(2)), ["k"], ["v", "id"], "one", "t", window_rows).collect()
    want = ranks(skewed.collect())
    assert {(r["k"], r["id"]): r["t"] for r in got} == {k: 2 * v for k, v in want.items()}


@pytest.mark.parametrize("window_rows", [10, 10_000])
def test_number_rows_without_keys(skewed, window_rows):
    got = ordering.number_rows(skewed, [], ["v", "id", "k"], "n", window_rows)
    assert sorted(r["n"] for r in got.collect()) == list(range(1, 3551))


@pytest.mark.parametrize("window_rows", [10, 10_000])
def test_quantiles_match_numpy(skewed, window_rows):
    probs = [0.0, 0.005, 0.16, 0.5, 0.995, 1.0]
    got = ordering.quantiles(skewed, ["k"], "v", probs, window_rows=window_rows).collect()
    data = skewed.collect()
    assert len(got) == 9
    for r in got:
        v = [d["v"] for d in data if d["k"] == r["k"]]
        assert np.allclose([r[f"q{p:g}"] for p in probs], np.quantile(v, probs), atol=1e-12)


@pytest.mark.parametrize("window_rows", [10, 10_000])
def test_lower_median_and_no_keys(skewed, window_rows):
    low = ordering.quantiles(skewed, [], "v", [0.5], ["m"], interpolate=False,
                             window_rows=window_rows).first()["m"]
    v = sorted(d["v"] for d in skewed.collect())
    assert low == v[(len(v) - 1) // 2]


def test_narrowing_on_continuous_values(spark):
    rng = np.random.default_rng(1)
    v = rng.lognormal(size=60_000)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    probs = [0.001, 0.25, 0.5, 0.999]
    got = ordering.quantiles(df, [], "v", probs, window_rows=100).first()
    assert np.allclose(list(got), np.quantile(v, probs), rtol=1e-12)


def test_with_previous_crosses_blocks(spark):
    df = spark.createDataFrame([("a", i, i * 10) for i in range(25)], "k string, s long, v long")
    got = ordering.with_previous(df, ["k"], "s", ["v"], block=4).collect()
    assert len(got) == 25
    assert {r["s"]: r["prev_v"] for r in got} == {i: (i - 1) * 10 if i else None for i in range(25)}


@pytest.mark.parametrize("n,k", [(31, 23), (10, 4), (5, 9), (7, 1), (1, 3), (100, 100), (97, 13)])
def test_evenly_spaced_matches_linspace(spark, n, k):
    df = spark.range(n)
    got = sorted(r["id"] for r in ordering.evenly_spaced(df, [], ["id"], k).collect())
    assert got == sorted(set(np.linspace(0, n - 1, min(k, n), dtype=int).tolist()))


def test_splits(spark):
    df = spark.range(25)
    split = ordering.seeded_split(df, ["id"], 0.9, 3)
    assert split.where("split = 'train'").count() == 22
    assert ordering.seeded_split(spark.range(1), ["id"], 0.5, 3).first()["split"] == "train"
    assert ordering.seeded_split(spark.range(2), ["id"], 0.99, 3).where("split='test'").count() == 1
    again = ordering.seeded_split(df.repartition(7), ["id"], 0.9, 3)
    assert sorted(split.collect()) == sorted(again.collect())
    assert ordering.holdout_split(df, ["id"], 0.2, 1).where("split='test'").count() == 5
    with pytest.raises(ValueError):
        ordering.holdout_split(df, ["id"], 1.0, 1)
    with pytest.raises(Exception, match="at least 2 rows"):
        ordering.holdout_split(spark.range(1), ["id"], 0.5, 1).collect()


def test_every_nth(spark):
    got = [r["id"] for r in ordering.every_nth(spark.range(10), [], ["id"], 4).collect()]
    assert sorted(got) == [3, 7, 9]
