"""Priors, likelihoods, posterior scores and resampling of parameter rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calib.functions.expr import (
    NEG_INF, finite_or_neg_inf, hash_order, prior_logpdf,
)
from calib.operators.design import Specs, parameter_array, within_bounds, with_implicit
from calib.operators.ordering import attach, number_rows, running_total
from calib.operators.surrogate import Model, list_matrix, predict_batch, shared

NAN_SCORE = -1e10


def log_likelihood(pred: DataFrame, ref: DataFrame, n_eff: DataFrame, sigma: DataFrame,
                   keys: Sequence[str] = ("theta_id",)) -> DataFrame:
    """Gaussian log-likelihood per key and QoI from long predictions.

    -n_eff * MSE / (2 sigma^2) - n_eff * ln(sigma); ``sigma`` has (keys, qoi, sigma)
    or (qoi, sigma).  A row whose positions are not exactly the reference's has a NULL score.
    """
    keys = list(keys)
    diff = F.col("value") - F.col("reference")
    both = attach(pred, ref.select("qoi", "pos", F.col("value").alias("reference")), ["qoi", "pos"])
    mse = both.groupBy(*keys, "qoi").agg(
        F.avg(diff * diff).alias("__mse"), F.count(F.lit(1)).alias("__n"), F.count(diff).alias("__met"))
    wanted = ref.groupBy("qoi").agg(F.count(F.lit(1)).alias("__wanted"))
    whole = (F.col("__met") == F.col("__n")) & (F.col("__met") == F.col("__wanted"))
    mse = attach(mse, wanted, ["qoi"]).withColumn("mse", F.when(whole, F.col("__mse")))
    on = [k for k in [*keys, "qoi"] if k in sigma.columns]
    rows = attach(attach(mse, n_eff, ["qoi"]), sigma, on)
    score = (F.col("n_eff") * F.col("mse") / (F.col("sigma") * F.col("sigma")) * -0.5
             - F.col("n_eff") * F.log("sigma"))
    return rows.select(*keys, "qoi", score.alias("log_likelihood"))


def total_log_likelihood(scores: DataFrame, keys: Sequence[str] = ("theta_id",)) -> DataFrame:
    """Sum over QoIs; NULL if the score of any of them is."""
    all_known = F.count("log_likelihood") == F.count(F.lit(1))
    return scores.groupBy(*keys).agg(F.when(all_known, F.sum("log_likelihood")).alias("log_likelihood"))


def log_prior(theta: DataFrame, priors: DataFrame, keys: Sequence[str] = ("theta_id",)
              ) -> DataFrame:
    """Sum of the prior log densities per key; long theta (keys, param, value).

    A parameter without a prior is an error.
    """
    known = F.when(F.col("kind").isNull(), F.raise_error(F.concat(
        F.lit("no prior for "), F.coalesce("param", F.lit("NULL")))).cast("string")).otherwise(F.col("kind"))
    dens = prior_logpdf(F.col("kind"), F.col("value"), F.col("a"), F.col("b"))
    rows = attach(theta, priors.select("param", "kind", "a", "b"), ["param"]).withColumn("kind", known)
    return rows.groupBy(*keys).agg(
        F.sum(dens).alias("log_prior"))


def log_prior_columns(priors: Sequence[tuple[str, str, float, float]]) -> Column:
    """Log prior of a wide row; ``priors`` = (param, kind, a, b)."""
    total = F.lit(0.0)
    for name, kind, a, b in priors:
        total = total + prior_logpdf(F.lit(kind), F.col(f"`{name}`"), F.lit(float(a)),
                                     F.lit(float(b)))
    return total


def log_posterior(prior: Column, likelihood: Column, any_nan: Column) -> Column:
    """Prior + likelihood; not finite becomes -inf, rows with NaN parameters -1e10."""
    both = F.when(prior == F.lit(NEG_INF), F.lit(NEG_INF)).otherwise(prior + likelihood)
    return F.when(any_nan, F.lit(NAN_SCORE)).otherwise(
        F.coalesce(finite_or_neg_inf(both), F.lit(NEG_INF)))


def score_posterior(theta: DataFrame, params: Sequence[str], models: Mapping[str, list[Model]],
                    reference: Mapping[str, Sequence[float]], n_eff: Mapping[str, float],
                    priors: Sequence[tuple[str, str, float, float]],
                    sigma: Mapping[str, float] | None = None, specs: Specs | None = None,
                    likelihood: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Score every parameter row: prior, log-likelihood per QoI, posterior.

    No row leaves its partition: the surrogates (size-checked when they are
    collected) are broadcast, and each row gets one number per QoI.  Noise
    levels come from ``sigma`` or from ``log_sigma_<qoi>`` columns.  Parameters are
    the explicit ones when ``specs`` has constraints.
    """
    sigma = dict(sigma or {})
    qois = sorted(models)
    known = shared(theta.sparkSession, {q: (models[q], np.asarray(reference[q], dtype=float)) for q in qois})

    def mse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__x")
            x = list_matrix(batch.column(at), len(params))
            names = [n for n in batch.schema.names if n != "__x"]
            columns = [batch.column(n) for n in names]
            for k, q in enumerate(qois):
                members, ref = known()[q]
                y = np.mean([predict_batch(m, x) for m in members], axis=0)
                names.append(f"__mse{k}")
                columns.append(pa.array(((y - ref) ** 2).mean(axis=1)))
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = theta
    ok = F.lit(True)
    if specs is not None:
        complete = with_implicit(theta, specs)
        ok = within_bounds(specs.bounds)
        rows = complete
    nan = F.lit(False)
    for p in params:
        nan = nan | F.isnan(F.col(f"`{p}`"))
    rows = rows.withColumn("__x", parameter_array(params))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields
                       if f.name != "__x")
    schema += "".join(f", __mse{k} double" for k in range(len(qois)))
    scored = rows.mapInArrow(mse, schema)

    total, cols = F.lit(0.0), []
    for k, q in enumerate(qois):
        s = F.lit(float(sigma[q])) if q in sigma else F.exp(F.col(f"`log_sigma_{q}`"))
        ll = (F.col(f"__mse{k}") / (s * s) * (-0.5 * float(n_eff[q]))
              - F.log(s) * float(n_eff[q]))
        ll = F.when(ok, ll).otherwise(F.lit(NEG_INF))
        cols.append(ll.alias(f"ll_{q}"))
        total = total + ll
    if likelihood is not None:
        total = likelihood(scored)
    return scored.select(
        "*", *cols, log_prior_columns(priors).alias("log_prior"), total.alias("__ll"), nan.alias(
            "__nan")).withColumn(
        "log_posterior", log_posterior(F.col("log_prior"), F.col("__ll"), F.col("__nan"))
    ).withColumnRenamed("__ll", "log_likelihood").drop(
        "__nan", *[f"__mse{k}" for k in range(len(qois))])


def importance_weights(scores: DataFrame, target: str = "log_posterior",
                       proposal: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Normalised weights exp(target - proposal), shifted by the largest per group."""
    keys = list(keys)
    log_w = F.col(target) - F.col(proposal) if proposal else F.col(target)
    rows = scores.withColumn("__lw", finite_or_neg_inf(log_w))
    top = rows.groupBy(*keys).agg(F.max("__lw").alias("__top"))
    rows = attach(rows, top, keys).withColumn(
        "__w", F.when(F.col("__top") == F.lit(NEG_INF), F.lit(0.0)).otherwise(
            F.exp(F.col("__lw") - F.col("__top"))))
    total = rows.groupBy(*keys).agg(F.sum("__w").alias("__sum"))
    return attach(rows, total, keys).withColumn(
        "weight", F.coalesce(F.try_divide(F.col("__w"), F.col("__sum")), F.lit(0.0))
    ).drop("__lw", "__top", "__w", "__sum")


def weight_ess(weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(sum w)^2 / sum w^2."""
    w = F.col("weight")
    return weights.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)).alias("ess"))


def systematic_resample(weights: DataFrame, order: Sequence[str], n: int, offset: float = 0.5,
                        keys: Sequence[str] = ()) -> DataFrame:
    """``n`` rows at equal steps of the cumulative weight, with ``draw`` = 0..n-1.

    A row is repeated for every step that falls on its share of the total.
    """
    if not 0.0 < offset < 1.0:
        raise ValueError("offset must be between 0 and 1")
    keys = list(keys)
    rows = running_total(weights.where(F.col("weight") > 0), keys, order, "weight", "__upto")
    total = weights.groupBy(*keys).agg(F.sum("weight").alias("__total"))
    rows = attach(rows, total, keys)
    share = lambda c: F.floor(c / F.col("__total") * n - offset).cast("long")
    last = F.least(share(F.col("__upto")), F.lit(n - 1).cast("long"))
    first = share(F.col("__upto") - F.col("weight")) + 1
    steps = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
    return rows.withColumn("draw", F.explode(steps)).drop("__upto", "__total")


def best_row(scores: DataFrame, score: str, tie: Sequence[str], keys: Sequence[str] = ()
             ) -> DataFrame:
    """Row of the largest finite score per group; the first by ``tie`` on equal scores."""
    keys = list(keys)
    ok = ~F.isnan(score) & (F.abs(F.col(score)) != float("inf"))
    others = [c for c in scores.columns if c not in keys]
    # Largest score first, then the smallest tie key: compare on (-score, tie...).
    place = F.struct((-F.col(score)).alias("__s"), *[F.col(t) for t in tie])
    return scores.where(ok).groupBy(*keys).agg(
        F.min_by(F.struct(*others), place).alias("__r")).select(
        *keys, *[F.col(f"__r.`{c}`").alias(c) for c in others])


def first_stable(scores: DataFrame, score: str, order: Sequence[str], threshold: float,
                 keys: Sequence[str] = ()) -> DataFrame:
    """First row of each group whose score is finite and above the threshold."""
    keys = list(keys)
    others = [c for c in scores.columns if c not in keys]
    ok = ~F.isnan(score) & (F.abs(F.col(score)) != float("inf")) & (F.col(score) > threshold)
    return scores.where(ok).groupBy(*keys).agg(
        F.min_by(F.struct(*others), F.struct(*order)).alias("__r")).select(
        *keys, *[F.col(f"__r.`{c}`").alias(c) for c in others])


def export_rows(posterior: DataFrame, key: Sequence[str], params: Sequence[str], n: int,
                seed: int) -> DataFrame:
    """``n`` posterior rows in seeded order, one array per parameter (n is a small count)."""
    hashed = posterior.withColumn(
        "__h", hash_order(F.lit(str(seed)), *[F.col(k) for k in key]))
    picked = number_rows(hashed.orderBy("__h", *key).limit(n), [], ["__h", *key], "__i")
    row = F.array_sort(F.collect_list(F.struct("__i", *[F.col(f"`{p}`") for p in params])))
    return picked.agg(row.alias("r")).select(*[F.col(f"r.`{p}`").alias(p) for p in params])


def sanitize(scores: DataFrame, score: str) -> DataFrame:
    """NaN and infinite scores become -inf."""
    return scores.withColumn(score, finite_or_neg_inf(score))
