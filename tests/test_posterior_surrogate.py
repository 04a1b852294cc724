"""Likelihoods, resampling and surrogates on literal examples."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from calib.functions import expr
from calib.operators import align, posterior, surrogate

INF = float("inf")


def lik(spark, pred, obs, n_eff=4.0, sigma=0.5):
    p = spark.createDataFrame([(0, "q", i, float(v)) for i, v in enumerate(pred)],
                              "theta_id long, qoi string, pos int, value double")
    r = spark.createDataFrame([("q", i, float(v)) for i, v in enumerate(obs)],
                              "qoi string, pos int, value double")
    n = spark.createDataFrame([("q", n_eff)], "qoi string, n_eff double")
    s = spark.createDataFrame([("q", sigma)], "qoi string, sigma double")
    return posterior.log_likelihood(p, r, n, s).first()["log_likelihood"]


def test_closed_form_and_bin_duplication(spark):
    want = -0.5 * 4 * 2.5 / 0.25 - 4 * math.log(0.5)
    assert math.isclose(lik(spark, [0, 1], [1, 3]), want)
    assert math.isclose(lik(spark, [0, 0, 1, 1], [1, 1, 3, 3]), want)


def test_posterior_marks(spark):
    df = spark.createDataFrame([(0.0, 1.0, False), (0.0, float("nan"), False), (1.0, 1.0, True),
                                (-INF, INF, False)], "p double, l double, bad boolean")
    got = df.select(posterior.log_posterior(F.col("p"), F.col("l"), F.col("bad")).alias("x")).collect()
    assert [r["x"] for r in got] == [1.0, -INF, -1e10, -INF]
    s = posterior.sanitize(spark.createDataFrame([(float("nan"),), (INF,), (-1.0,)], "x double"), "x")
    assert [r["x"] for r in s.collect()] == [-INF, -INF, -1.0]


def test_prior_moments(spark):
    kind, a, b = F.lit("uniform"), F.lit(-1.0), F.lit(1.0)
    r = spark.range(1).select(expr.prior_mean(kind, a, b), expr.prior_scale(kind, a, b)).first()
    assert r[0] == 0.0 and math.isclose(r[1], 2 / math.sqrt(12))


def test_weights_and_resampling(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0.0, math.log(3), -INF, 0.0])],
                               "id long, log_posterior double")
    w = posterior.importance_weights(df)
    assert np.allclose([r["weight"] for r in w.orderBy("id").collect()], [0.2, 0.6, 0, 0.2])
    assert math.isclose(posterior.weight_ess(w).first()["ess"], 1 / (0.04 + 0.36 + 0.04))
    got = posterior.systematic_resample(w, ["id"], 10).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {0: 2, 1: 6, 3: 2}
    hot = posterior.systematic_resample(w, ["id"], 1000, 0.123)
    assert sorted(r["draw"] for r in hot.collect()) == list(range(1000))


def test_best_row_prefers_first(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 5.0), (2, 5.0), (3, INF), (4, float("nan"))], "i long, s double")
    assert posterior.best_row(df, "s", ["i"]).first()["i"] == 1
    # Overshooting ascent on -(x - 1)^2 from 0: the start is the best seen.
    walk = spark.createDataFrame([(i, -(x - 1.0) ** 2, x) for i, x in enumerate([0.0, 4.0, -5.0, 13.0])],
                                 "i long, s double, x double")
    assert posterior.best_row(walk, "s", ["i"]).first()["x"] == 0.0


def sets(spark, x, y):
    tx = spark.createDataFrame([(i, [float(v) for v in np.atleast_1d(p)]) for i, p in enumerate(x)],
                               "train_id long, params array<double>")
    ty = spark.createDataFrame([(i, "q", j, float(v)) for i, r in enumerate(y) for j, v in enumerate(np.atleast_1d(r))],
                               "train_id long, qoi string, pos int, value double")
    return tx, ty, surrogate.training_sets(tx, ty)


def hyper(spark, rows):
    return spark.createDataFrame(rows, "qoi string, member int, lengths array<double>, width double, noise double")


def test_kernel_table(spark):
    _, _, s = sets(spark, [(0, 0), (1, 0)], [[0], [0]])
    k = {(r["i"], r["j"]): r["k"] for r in surrogate.kernel_table(
        s, hyper(spark, [("q", 0, [1.0, 2.0], 2.0, 0.0)])).collect()}
    assert k[0, 0] == k[1, 1] == 4.0 and k[0, 1] == k[1, 0]
    assert math.isclose(k[0, 1], 4 * math.exp(-0.5))


def test_interpolation_and_committee(spark):
    tx, ty, s = sets(spark, [0, 1, 2], [[0, 1], [1, 2], [0, 1]])
    models = surrogate.collect_models(surrogate.solve_weights(
        s, hyper(spark, [("q", 0, [0.4], 1.0, 1e-5), ("q", 1, [0.4], 1.0, 1e-5)])))
    models["q"][1].alpha = models["q"][1].alpha + 0.0
    models["q"][1].mean = models["q"][1].mean + 1.0
    got = surrogate.predict(tx, "train_id", {"q": models["q"][:1]}).orderBy("train_id", "pos").collect()
    assert np.allclose([r["value"] for r in got], [0, 1, 1, 2, 0, 1], atol=1e-3)
    both = surrogate.predict(tx, "train_id", models).orderBy("train_id", "pos").collect()
    assert np.allclose([r["value"] for r in both], np.array([0, 1, 1, 2, 0, 1]) + 0.5, atol=1e-3)


def test_callable_mean(spark):
    tx, ty, s = sets(spark, [0, 1, 2], [[0], [1], [2]])
    fitted = surrogate.solve_weights(s.withColumn("ys", F.array_repeat(F.array(F.lit(0.0)), 3)),
                                     hyper(spark, [("q", 0, [0.4], 1.0, 1e-5)]))
    models = surrogate.collect_models(fitted, {"q": lambda x: x})
    got = surrogate.predict(tx, "train_id", models).orderBy("train_id").collect()
    assert np.allclose([r["value"] for r in got], [0, 1, 2])


def test_leave_one_out_matches_refits():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 2)), rng.normal(size=(7, 3))
    log_hyper = np.array([0.1, -0.2, 0.3, -1.0])
    h = np.exp(log_hyper)
    k = surrogate.kernel_matrix(x, x, h[:2], h[2]) + h[3] * np.eye(7)
    total = 0.0
    for i in range(7):
        keep = np.arange(7) != i
        w = np.linalg.solve(k[np.ix_(keep, keep)], k[keep, i])
        var, mu = k[i, i] - k[i, keep] @ w, w @ y[keep]
        total += (-0.5 * (y[i] - mu) ** 2 / var - 0.5 * math.log(var)).sum()
    want = total / 7 - 3 / 2 * math.log(2 * math.pi)
    assert math.isclose(surrogate.loo_score(x, y, log_hyper), want, rel_tol=1e-9)


def test_size_limit_and_search(spark):
    x = np.linspace(0, 3, 12)
    tx, ty, s = sets(spark, x, np.sin(x)[:, None])
    with pytest.raises(ValueError, match="dense solve limit"):
        surrogate.training_sets(tx, ty, max_train=5)
    scored = surrogate.search_hyperparameters(s, 1, n_candidates=24, rounds=2)
    best = scored.where("best").collect()
    assert len(best) >= 1
    assert math.isclose(best[0]["score"], scored.agg(F.max("score")).first()[0])
    team = surrogate.committee(scored, 3)
    assert team.count() == 3 and surrogate.committee(scored, 1).count() == 1
    models = surrogate.collect_models(surrogate.solve_weights(
        s, surrogate.hyper_table(surrogate.committee(scored, 1), 1)))
    got = surrogate.predict(tx, "train_id", models).orderBy("train_id").collect()
    assert np.allclose([r["value"] for r in got], np.sin(x), atol=0.2)


def test_posterior_mask(spark):
    from calib.operators.design import Specs

    x = np.linspace(-1, 1, 5)
    _, _, s = sets(spark, x, x[:, None])
    models = surrogate.collect_models(surrogate.solve_weights(s, hyper(spark, [("q", 0, [1.0], 1.0, 1e-4)])))
    theta = spark.createDataFrame([(0, 0.5), (1, -0.5), (2, float("nan"))], "id long, t double")
    got = posterior.score_posterior(
        theta, ["t"], models, {"q": [0.4]}, {"q": 2.0}, [("t", "normal", 0.0, 1.0)], {"q": 0.5},
        Specs({"t": (0.0, 1.0)})).orderBy("id").collect()
    assert math.isfinite(got[0]["log_posterior"])
    assert got[1]["log_posterior"] == -INF and got[2]["log_posterior"] == -1e10
    wide = {r["id"]: r["log_posterior"] for r in posterior.score_posterior(
        theta.repartition(7), ["t"], models, {"q": [0.4]}, {"q": 2.0}, [("t", "normal", 0.0, 1.0)],
        {"q": 0.5}).collect()}
    assert math.isclose(wide[0], got[0]["log_posterior"])


def test_export(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(30)], "id long, p double")
    r = posterior.export_rows(df, ["id"], ["id", "p"], 5, 1).first()
    assert len(r["p"]) == 5 and [float(i) for i in r["id"]] == r["p"]


def test_pluggable_likelihood(spark):
    theta = spark.createDataFrame([(0, 0.5), (1, -0.5)], "id long, t double")
    got = posterior.score_posterior(
        theta, ["t"], {}, {}, {}, [("t", "uniform", -1.0, 1.0)],
        likelihood=lambda df: -F.col("t") * F.col("t")).orderBy("id").collect()
    assert [round(r["log_posterior"], 9) for r in got] == [round(-0.25 - math.log(2), 9)] * 2


def test_incomplete_predictions_have_no_score(spark):
    pred = spark.createDataFrame([(0, "a", 0, 1.0), (0, "a", 1, 2.0), (1, "a", 0, 1.0), (2, "a", 0, 1.0), (2, "a", 1, 1.0),
                                  (2, "a", 2, 1.0), (0, "b", 0, 1.0), (1, "b", 0, 1.0)],
                                 "theta_id int, qoi string, pos int, value double")
    ref = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0), ("b", 0, 1.0)], "qoi string, pos int, value double")
    n_eff = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "qoi string, n_eff double")
    sigma = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "qoi string, sigma double")
    scores = posterior.log_likelihood(pred, ref, n_eff, sigma)
    got = {(r["theta_id"], r["qoi"]): r["log_likelihood"] for r in scores.collect()}
    # Row 1 lacks a position of "a" and row 2 has one too many.
    assert got == {(0, "a"): -0.5, (1, "a"): None, (2, "a"): None, (0, "b"): 0.0, (1, "b"): 0.0}
    total = {r["theta_id"]: r["log_likelihood"] for r in posterior.total_log_likelihood(scores).collect()}
    assert total == {0: -0.5, 1: None, 2: None}


def test_parameter_without_prior(spark):
    theta = spark.createDataFrame([(0, "p", 0.5), (0, "q", 0.5)], "theta_id int, param string, value double")
    priors = spark.createDataFrame([("p", "uniform", 0.0, 1.0)], "param string, kind string, a double, b double")
    assert posterior.log_prior(theta.where("param = 'p'"), priors).first()["log_prior"] == 0.0
    with pytest.raises(Exception, match="no prior for q"):
        posterior.log_prior(theta, priors).collect()


def test_cell_without_reference(spark):
    schema = "qoi string, system_index int, label string, bin int, value double"
    ref = spark.createDataFrame([("a", 0, "x", 0, 1.0)], schema)
    samples = spark.createDataFrame([("a", 0, "x", 0, 2.0), ("b", 0, "x", 0, 2.0), ("a", 1, "x", 0, 2.0)], schema)
    assert [r["value"] for r in align.align(samples, ref).collect()] == [2.0]
    with pytest.raises(Exception, match="no reference for a 0 x 1"):
        align.align(samples.withColumn("bin", samples["bin"] + 1), ref).collect()


def test_training_rows_are_read_from_stored_totals(spark):
    """Reading the training rows again joins no orders with customers."""
    from calib.plans.posterior_queries import training
    from check import SMALLEST

    for rows in training(spark, SMALLEST):
        assert rows.count() > 0
        assert not [f for f in rows.inputFiles() if "orders" in f or "customer" in f]
