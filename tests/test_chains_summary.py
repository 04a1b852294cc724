"""Chain diagnostics and summaries against numpy."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from calib.functions import expr
from calib.operators import chains, summary
from calib.session import tables_made


def draws(spark, x):
    """x: steps x chains."""
    rows = [(c, s, "p", float(x[s, c])) for s in range(x.shape[0]) for c in range(x.shape[1])]
    return spark.createDataFrame(rows, "chain long, step long, param string, value double")


def zscores(x):
    flat = x.reshape(-1)
    order = np.argsort(flat, kind="stable")
    rank = np.empty(len(flat))
    rank[order] = np.arange(1, len(flat) + 1)
    inv = NormalDist().inv_cdf
    return np.array([inv((r - 0.375) / (len(flat) + 0.25)) for r in rank]).reshape(x.shape)


def rhat(x):
    h = x.shape[0] // 2
    halves = np.concatenate([x[:h], x[-h:]], axis=1)
    w = halves.var(axis=0, ddof=1).mean()
    return math.sqrt(((h - 1) / h * w + halves.mean(axis=0).var(ddof=1)) / w)


def rank_rhat(x):
    med = np.sort(x.reshape(-1))[(x.size - 1) // 2]
    return max(rhat(zscores(x)), rhat(zscores(np.abs(x - med))))


def tau(series):
    d = series - series.mean()
    n = len(d)
    c0 = (d @ d) / n
    total = 0.0
    for k in range(1, n):
        rho = (d[:-k] @ d[k:]) / (n - k) / c0 if c0 > 0 else 0.0
        if rho <= 0:
            break
        total += rho
    return max(1.0, 1 + 2 * total)


def test_normal_quantile_all_branches(spark):
    u = [1e-12, 1e-300, 1e-5, 0.01, 0.075, 0.0750001, 0.5, 0.7, 0.925, 0.99, 1 - 1e-12]
    df = spark.createDataFrame([(v,) for v in u], "u double")
    got = {r["u"]: r["z"] for r in expr.with_normal_quantile(df, "u", "z").collect()}
    assert np.allclose([got[v] for v in u], [NormalDist().inv_cdf(v) for v in u], rtol=1e-13)


@pytest.mark.parametrize("name", ["__z", "__q", "__t"])
def test_normal_quantile_under_any_name(spark, name):
    """the result keeps its name, and columns of these names are left alone."""
    df = spark.createDataFrame([(0.7, 1.5)], "u double, __r double")
    got = expr.with_normal_quantile(df, "u", name).first().asDict()
    assert list(got) == ["u", "__r", name] and got["__r"] == 1.5
    assert math.isclose(got[name], NormalDist().inv_cdf(0.7), rel_tol=1e-13)


def test_too_short(spark):
    with pytest.raises(Exception, match="four steps"):
        chains.split_rhat(draws(spark, np.zeros((3, 2)))).collect()


@pytest.mark.parametrize("window_rows", [20, 10_000])
def test_rank_rhat_with_ties_and_odd_steps(spark, window_rows):
    x = np.random.default_rng(0).integers(0, 6, size=(41, 4)).astype(float)
    got = chains.rank_split_rhat(draws(spark, x).repartition(5), window_rows=window_rows).first()
    assert math.isclose(got["rhat"], rank_rhat(x), rel_tol=1e-10)


def test_similar_chains(spark):
    x = np.linspace(-1, 1, 40)[:, None] + np.array([0, .01, .02, .03])
    assert math.isclose(chains.split_rhat(draws(spark, x)).first()["rhat"], rhat(x), rel_tol=1e-10)


@pytest.mark.parametrize("block", [7, 4096])
def test_autocorrelation_blocks(spark, block):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=(60, 3)), axis=0)
    got = chains.autocorrelation(draws(spark, x), max_lag=20, block=block).collect()
    for r in got:
        d = x[:, r["chain"]] - x[:, r["chain"]].mean()
        k = r["lag"]
        want = (d[:60 - k] @ d[k:]) / (60 - k) / (d @ d / 60)
        assert math.isclose(r["rho"], want, rel_tol=1e-9, abs_tol=1e-12)
    assert len(got) == 63


def test_tau_in_rounds(spark):
    x = np.cumsum(np.random.default_rng(3).normal(size=(300, 3)), axis=0)
    x[:, 2] = 5.0
    got = chains.autocorr_time(draws(spark, x), first_lag=2, block=50).collect()
    for r in got:
        assert math.isclose(r["tau"], tau(x[:, r["chain"]]), rel_tol=1e-9)
    assert len(got) == 3


def test_long_chain_uses_fft(spark):
    x = np.cumsum(np.random.default_rng(4).normal(size=(3000, 1)), axis=0)
    got = chains.autocorr_time(draws(spark, x), first_lag=700).first()["tau"]
    assert math.isclose(got, tau(x[:, 0]), rel_tol=1e-8)


def test_all_lags_of_a_long_chain(spark):
    n = 200_000
    steps = np.random.default_rng(6).normal(size=n)
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = 0.99 * x[i - 1] + steps[i]
    frame = spark.createDataFrame(pd.DataFrame({"param": "p", "chain": 0, "step": np.arange(n), "value": x}))
    got = chains.autocorrelation(frame.repartition(16)).select("lag", "rho").toPandas().sort_values("lag")
    d = np.fft.rfft(x - x.mean(), 1 << 19)
    want = np.fft.irfft(d * np.conj(d), 1 << 19)[:n] / (n - np.arange(n))
    assert (got["lag"].to_numpy() == np.arange(n)).all()
    # The last lags divide few products, so rounding counts for more there.
    np.testing.assert_allclose(got["rho"].to_numpy()[:n - 1000], (want / want[0])[:n - 1000], atol=1e-9)
    np.testing.assert_allclose(got["rho"].to_numpy(), want / want[0], atol=1e-6)


def test_lags_of_chains_of_any_length(spark):
    rng = np.random.default_rng(7)
    series = {0: rng.normal(size=37), 1: np.cumsum(rng.normal(size=101)), 2: np.ones(5), 3: rng.normal(size=1)}
    rows = [("p", c, i, float(v)) for c, x in series.items() for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "param string, chain int, step long, value double")
    got = {(r["chain"], r["lag"]): r["rho"] for r in chains.autocorrelation(frame, block=16).collect()}
    assert len(got) == sum(map(len, series.values()))
    for (c, k), rho in got.items():
        d = series[c] - series[c].mean()
        var = d @ d / len(d)
        want = (d[:len(d) - k] @ d[k:]) / (len(d) - k) / var if var > 0 else 0.0
        assert math.isclose(rho, want, rel_tol=1e-9, abs_tol=1e-12)
    taus = {r["chain"]: r["tau"] for r in chains.autocorr_time(frame, first_lag=3, block=16).collect()}
    assert len(taus) == 4 and all(math.isclose(taus[c], tau(x), rel_tol=1e-9) for c, x in series.items() if len(x) > 1)


def test_convergence_report(spark):
    x = np.random.default_rng(5).normal(size=(60, 4))
    r = chains.convergence_report(draws(spark, x)).first()
    z = zscores(x)
    t = np.mean([tau(z[:, c]) for c in range(4)])
    assert math.isclose(r["rhat"], rank_rhat(x), rel_tol=1e-10)
    assert math.isclose(r["ess"], x.size / t, rel_tol=1e-9)
    assert r["converged"] == (r["rhat"] < 1.01 and r["ess"] > 100)
    early = chains.convergence_report(draws(spark, x[:16]), rhat_max=9, ess_min=0).first()
    assert not early["converged"]


def test_moments(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (0.0, 2.0)], "a double, b double")
    got = {(r["param_i"], r["param_j"]): r["cov"] for r in chains.covariance(df, [], ["a", "b"]).collect()}
    assert np.allclose([got["a", "a"], got["a", "b"], got["b", "b"]], [1 / 3, -1 / 3, 4 / 3])
    one = chains.covariance(df.limit(1), [], ["a", "b"]).collect()
    assert {(r["param_i"], r["param_j"]): r["cov"] for r in one} == {
        ("a", "a"): 1.0, ("a", "b"): 0.0, ("b", "a"): 0.0, ("b", "b"): 1.0}


def test_thin_and_nuisance(spark):
    x = np.arange(24, dtype=float).reshape(4, 3, 2)
    rows = [(c, s, float(x[s, c, 0]), float(x[s, c, 1]) / 10) for s in range(4) for c in range(3)]
    df = spark.createDataFrame(rows, "chain long, step long, p double, log_sigma_q double")
    got = summary.prepare_samples(df, ["p", "log_sigma_q"], 1, 2, outliers=False)
    assert got.count() == 6 and got.where("sigma_q <= 0").count() == 0
    with pytest.raises(ValueError, match="no draws remain"):
        summary.prepare_samples(df, ["p"], 10, 1)


def test_saved_steps(spark):
    df = spark.range(8).withColumnRenamed("id", "step")
    assert chains.thin(df, 2, 2).count() == 3


def test_incomplete_and_renumbered_steps(spark):
    df = draws(spark, np.zeros((4, 2))).where("NOT (step = 2 AND chain = 1)")
    assert [r["step"] for r in chains.incomplete_steps(df).collect()] == [2]
    sparse = draws(spark, np.zeros((9, 2))).where("step % 3 = 0")
    assert sorted({r["step"] for r in chains.renumber_steps(sparse).collect()}) == [0, 1, 2]


def test_acceptance(spark):
    df = spark.createDataFrame([(0, s, float(v)) for s, v in enumerate([1, 1, 2, 2, 2, 3])],
                               "chain long, step long, p double")
    assert chains.acceptance_rate(df, [], ["p"]).first()["acceptance_rate"] == 0.4
    flagged = df.withColumn("accepted", F.col("step") % 2 == 0)
    assert chains.accepted_share(flagged, []).first()["acceptance_rate"] == 0.5


def test_summary_of_ones(spark):
    df = spark.createDataFrame([(1.0,)] * 5, "p double")
    assert summary.posterior_summary(df, ["p"]).first()[1:] == (1.0, 0.0)


def test_densities_match_direct_sums(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=200), rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = summary.kde(df, "x", 50).orderBy("point").collect()
    h = x.std(ddof=1) * 200 ** -0.2
    grid = np.linspace(x.min(), x.max(), 50)
    want = np.exp(-0.5 * ((x[:, None] - grid) / h) ** 2).sum(0) / (200 * h * math.sqrt(2 * math.pi))
    assert np.allclose([r["density"] for r in got], want)
    mode = summary.posterior_mode(df, "x", 50)
    assert math.isclose(mode[0], grid[want.argmax()])
    cov = np.cov(x, y) * 200 ** (-1 / 3)
    two = summary.kde_2d(df, "x", "y", 5).collect()
    inv = np.linalg.inv(cov)
    for r in two:
        d = np.stack([x - r["x"], y - r["y"]])
        want2 = np.exp(-0.5 * (d * (inv @ d)).sum(0)).sum() / (200 * 2 * math.pi * math.sqrt(np.linalg.det(cov)))
        assert math.isclose(r["density"], want2, rel_tol=1e-9)


def test_responsibilities_sum_to_one(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([tuple(map(float, v)) for v in rng.normal(size=(100, 3))],
                               "p double, a double, b double")
    got = summary.responsibilities(df, "p", ["a", "b"], 20)
    assert all(math.isclose(r["s"], 1.0) for r in got.groupBy("point").agg(
        F.sum("responsibility").alias("s")).collect())
    with pytest.raises(ValueError):
        summary.responsibilities(df, "p", ["a"], 20, temperature=0)


def test_robust_standardize_fallbacks(spark):
    df = spark.createDataFrame([("c", 1.0)] * 3 + [("s", 0.0)] * 9 + [("s", 8.0)], "k string, v double")
    got = summary.robust_standardize(df, ["k"], "v")
    assert {r["score"] for r in got.where("k='c'").collect()} == {0.0}
    assert math.isclose(got.where("v = 8").first()["score"], 8 / np.std([0] * 9 + [8]))


def test_rank_rhat_stores_ranks_only(spark):
    """F15, F16: the normal score is compiled, and ranked rows are not stored a second time."""
    rows = draws(spark, np.random.default_rng(5).normal(size=(50, 4)))
    plan = expr.with_normal_quantile(spark.range(9).select(((F.col("id") + 1) / 10).alias("u")), "u", "z")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "explode(array(__z" in text and "aggregate(" not in text
    before = len(tables_made())
    chains.rank_split_rhat(rows, window_rows=20).collect()
    # One table for the order of the draws, one for the order of the folded draws.
    assert len(tables_made()) - before == 2


def test_lag_sums_are_added_as_arrays(spark):
    """sums of pairs meet as arrays, so no task holds a table of single lags."""
    x = np.random.default_rng(7).normal(size=(61, 2))
    blocks = chains._blocks(draws(spark, x), ["param", "chain"], "value", 7)
    sums = chains._lag_sums(blocks, ["param", "chain"], 0, None, 7)
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[:plan.index("MapInPandas")]
    rows = sums.collect()
    assert len(rows) == len({(r["chain"], r["lag"]) for r in rows}) == 2 * 61
    d = x - x.mean(axis=0)
    for r in rows:
        assert math.isclose(r["s"], (d[:61 - r["lag"], r["chain"]] * d[r["lag"]:, r["chain"]]).sum(), abs_tol=1e-9)
