"""Gaussian-process surrogates of curves over parameters.

Training tables: ``train_x(train_id, params ARRAY<DOUBLE>)`` and
``train_y(train_id, qoi, pos, value)``.  One training row is one simulated sample,
and the exact solve is cubic in their number, so a model's training set is small;
its size is checked before any model is put together.  What grows is the number of
queries, candidates, QoIs and members, and those stay distributed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calib.functions.expr import hash_uniform, rbf_kernel, with_normal_quantile
from calib.operators.ordering import attach
from calib.session import materialize

MAX_TRAIN = 4096
MAX_MODEL_VALUES = 50_000_000
# Location and scale of the normal priors of log lengths, width and noise.
HYPER_LENGTH = (-2.0, 2.0)
HYPER_WIDTH = (-2.0, 2.0)
HYPER_NOISE = (-2.0, 3.0)
_UNPACKED: dict[str, Any] = {}


@dataclass
class Model:
    """One fitted member: training inputs, weights, hyperparameters and prior mean."""

    qoi: str
    member: int
    x: np.ndarray
    alpha: np.ndarray
    lengths: np.ndarray
    width: float
    mean: np.ndarray | Callable[[np.ndarray], np.ndarray]


def kernel_matrix(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, width: float) -> np.ndarray:
    """width^2 * exp(-d^2/2) with per-dimension length scales."""
    a, b = a / lengths, b / lengths
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return width * width * np.exp(-0.5 * np.maximum(d2, 0.0))


def list_matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of an Arrow list column of one length as a matrix; NULL becomes NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1 if width is None and len(column) else width or 0)


def predict_batch(model: Model, x: np.ndarray) -> np.ndarray:
    mean = model.mean(x) if callable(model.mean) else model.mean
    return mean + kernel_matrix(x, model.x, model.lengths, model.width) @ model.alpha


def centre(train_y: DataFrame, mean: DataFrame) -> DataFrame:
    """Outputs minus the prior mean (qoi[, train_id][, pos], value)."""
    on = [c for c in ("qoi", "train_id", "pos") if c in mean.columns]
    means = mean.withColumnRenamed("value", "__mean")
    return attach(train_y, means, on).withColumn(
        "value", F.col("value") - F.coalesce("__mean", F.lit(0.0))).drop("__mean")


def training_sets(train_x: DataFrame, train_y: DataFrame, max_train: int = MAX_TRAIN
                  ) -> DataFrame:
    """One row per QoI: ids, inputs and outputs as arrays in training order."""
    largest = train_x.count()
    if largest > max_train:
        raise ValueError(f"{largest} training rows exceed the dense solve limit of {max_train}")
    rows = train_y.groupBy("qoi", "train_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("c"))
    rows = rows.join(train_x, "train_id").select(
        "qoi", "train_id", "params", F.col("c.value").alias("y"))
    packed = F.array_sort(F.collect_list(F.struct("train_id", "params", "y")))
    return rows.groupBy("qoi").agg(packed.alias("r")).select(
        "qoi", F.col("r.train_id").alias("ids"), F.col("r.params").alias("xs"),
        F.col("r.y").alias("ys"))


def kernel_table(sets: DataFrame, hyper: DataFrame) -> DataFrame:
    """K(i, j) with the noise added on the diagonal: (qoi, member, i, j, k)."""
    each = sets.join(hyper, "qoi").select(
        "qoi", "member", "xs", "ids", "lengths", "width", "noise",
        F.posexplode("xs").alias("p", "x"))
    row = F.transform("xs", lambda o: rbf_kernel(F.col("x"), o, F.col("lengths"), F.col("width")))
    cells = each.select("qoi", "member", "ids", "noise", "p",
                        F.posexplode_outer(row).alias("q", "k"))
    return cells.select(
        "qoi", "member", F.get("ids", F.col("p")).alias("i"), F.get("ids", F.col("q")).alias("j"),
        F.when(F.col("p") == F.col("q"), F.col("k") + F.col("noise")).otherwise(F.col("k")
                                                                               ).alias("k"))


def _positive_definite(k: np.ndarray) -> np.ndarray:
    k = 0.5 * (k + k.T)
    try:
        np.linalg.cholesky(k)
        return k
    except np.linalg.LinAlgError:
        low = np.linalg.eigvalsh(k)[0]
        return k + (1e-8 - low) * np.eye(len(k))


def _stack(v) -> np.ndarray:
    return np.array([np.asarray(row, dtype=float) for row in v], dtype=float)


def solve_weights(sets: DataFrame, hyper: DataFrame, mean: DataFrame | None = None,
                  means: dict[str, Callable] | None = None) -> DataFrame:
    """Weights (K + noise I)^-1 (y - mean), one row per (qoi, member).

    ``hyper``: qoi, member, lengths, width, noise.  ``mean``: qoi, mean (array per QoI
    of the curve length, or of length one).  A function in ``means`` takes the place of
    a QoI's constant mean; hand the same ones to ``collect_models``.  Models are solved
    in parallel.
    """
    models = sets.join(hyper, "qoi")
    models = (models.withColumn("mean", F.array(F.lit(0.0))) if mean is None
              else models.join(mean.select("qoi", "mean"), "qoi"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                x = _stack(r.xs)
                own = (means or {}).get(r.qoi)
                y = _stack(r.ys) - (own(x) if own else np.asarray(r.mean, dtype=float))
                k = kernel_matrix(x, x, np.asarray(r.lengths, dtype=float), r.width)
                k = _positive_definite(k + r.noise * np.eye(len(x)))
                out.append(np.linalg.solve(k, y).tolist())
            yield batch.drop(columns="ys").assign(alpha=out)

    return models.select("qoi", "member", "ids", "xs", "ys", "lengths", "width", "noise",
                         "mean").repartition("qoi", "member").mapInPandas(
        solve, "qoi string, member int, ids array<bigint>, xs array<array<double>>, "
               "lengths array<double>, width double, noise double, mean array<double>, "
               "alpha array<array<double>>")


def _nested(column: pa.ChunkedArray, row: int) -> np.ndarray:
    """One cell of lists of one length as a matrix."""
    cell = column[row].values
    return cell.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(cell), -1)


def shared(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A broadcast of ``value``; calling the result in a task gives it, unpacked once per worker.

    Functions of the user may be part of it, so it is packed as closures are.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    place = uuid.uuid4().hex

    def get() -> Any:
        if place not in _UNPACKED:
            _UNPACKED.clear()
            _UNPACKED[place] = cloudpickle.loads(sent.value)
        return _UNPACKED[place]

    return get


def weight_table(models: DataFrame) -> DataFrame:
    """Weights as rows: (qoi, member, train_id, pos, alpha)."""
    rows = models.select("qoi", "member", F.inline(F.arrays_zip("ids", "alpha")))
    return rows.select("qoi", "member", F.col("ids").alias("train_id"),
                       F.posexplode("alpha").alias("pos", "alpha"))


def collect_models(models: DataFrame, means: dict[str, Callable] | None = None
                   ) -> dict[str, list[Model]]:
    """Bring fitted models to the driver for use inside tasks, after a size check."""
    size = F.size("xs") * (F.size(F.get("xs", F.lit(0))) + F.size(F.get("alpha", F.lit(0))))
    total = models.agg(F.sum(size.cast("long"))).first()[0] or 0
    if total > MAX_MODEL_VALUES:
        raise ValueError(f"models hold {total} numbers, more than {MAX_MODEL_VALUES}")
    out: dict[str, list[Model]] = {}
    table = models.orderBy("qoi", "member").toArrow()
    for i, (qoi, member, width) in enumerate(zip(*[table.column(c).to_pylist() for c in ("qoi", "member", "width")])):
        flat = lambda c: np.array(table.column(c)[i].as_py(), dtype=float)
        out.setdefault(qoi, []).append(Model(
            qoi, member, _nested(table.column("xs"), i), _nested(table.column("alpha"), i), flat("lengths"), width,
            (means or {}).get(qoi, flat("mean"))))
    return out


def predict(queries: DataFrame, key: str, models: dict[str, list[Model]],
            stochastic_seed: int | None = None) -> DataFrame:
    """Committee prediction per query and QoI: (key, qoi, pos, value).

    The mean over members, or one member per query picked by a seeded hash.  Queries
    never move; the models are broadcast.  ``queries``: key, params.
    """
    known = shared(queries.sparkSession, models)
    kind = queries.schema[key].dataType.simpleString()
    rows = queries.select(key, "params", (
        F.lit(0.0) if stochastic_seed is None
        else hash_uniform(F.lit(str(stochastic_seed)), F.col(key))).alias("__u"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = list_matrix(batch.column(1))
            u = batch.column(2).to_numpy(zero_copy_only=False)
            for qoi, members in known().items():
                y = np.array([predict_batch(m, x) for m in members])
                if stochastic_seed is None:
                    y = y.mean(axis=0)
                else:
                    y = y[(u * len(members)).astype(int), np.arange(len(x))]
                width = y.shape[1]
                values = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([qoi] * len(x)), values], [key, "qoi", "values"])

    arrays = rows.mapInArrow(run, f"`{key}` {kind}, qoi string, values array<double>")
    return arrays.select(key, "qoi", F.posexplode("values").alias("pos", "value"))


def smape(rows: DataFrame, key: Sequence[str], observed: str, predicted: str,
          by: Sequence[str] = ()) -> DataFrame:
    """100 * mean over rows of sum|y - p| / (sum|y| + sum|p|); rows are groups of ``key``."""
    by = list(by)
    per_row = rows.groupBy(*by, *key).agg(
        F.sum(F.abs(F.col(observed) - F.col(predicted))).alias("__d"),
        (F.sum(F.abs(observed)) + F.sum(F.abs(predicted))).alias("__s"))
    return per_row.groupBy(*by).agg(
        (F.avg(F.try_divide("__d", "__s")) * 100.0).alias("smape"))


def holdout_error(train_x: DataFrame, train_y: DataFrame, hyper: DataFrame,
                  split: DataFrame, mean: DataFrame | None = None) -> DataFrame:
    """Fit on the train side of ``split`` (train_id, split) and score the test side."""
    train = split.where("split = 'train'").select("train_id")
    test = split.where("split = 'test'").select("train_id")
    sets = training_sets(train_x.join(train, "train_id", "left_semi"),
                         train_y.join(train, "train_id", "left_semi"))
    models = collect_models(solve_weights(sets, hyper, mean))
    pred = predict(train_x.join(test, "train_id", "left_semi"), "train_id", models)
    both = train_y.join(pred.withColumnRenamed("value", "predicted"), ["train_id", "qoi", "pos"])
    return smape(both, ["train_id"], "value", "predicted", ["qoi"])


# -- hyperparameters -------------------------------------------------------

def loo_score(x: np.ndarray, y: np.ndarray, log_hyper: np.ndarray) -> float:
    """Leave-one-out log score of one log-hyperparameter row (lengths..., width, noise)."""
    n, m = y.shape
    hyper = np.exp(log_hyper)
    k = kernel_matrix(x, x, hyper[:-2], hyper[-2]) + hyper[-1] * np.eye(n)
    jitter = np.finfo(float).eps
    root = None
    for attempt in range(7):
        try:
            root = np.linalg.cholesky(k + (jitter * np.eye(n) if attempt else 0.0))
            break
        except np.linalg.LinAlgError:
            jitter *= 10.0 if attempt else 1.0
    if root is None:
        return float("-inf")
    inverse_root = np.linalg.inv(root)
    inverse = inverse_root.T @ inverse_root
    diag = np.diag(inverse)
    residual = ((inverse @ y) ** 2 / diag[:, None]).sum() / (2 * n)
    return float(-(residual - m / (2 * n) * np.log(diag).sum() + m / 2 * np.log(2 * np.pi)))


def score_candidates(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """Leave-one-out score of each candidate (qoi, cand_id, log_hyper ARRAY<DOUBLE>).

    Training arrays (checked for size) are broadcast.
    """
    size = F.size("xs") * (F.size(F.get("xs", F.lit(0))) + F.size(F.get("ys", F.lit(0))))
    total = sets.agg(F.sum(size.cast("long"))).first()[0] or 0
    if total > MAX_MODEL_VALUES:
        raise ValueError(f"training sets hold {total} numbers, more than {MAX_MODEL_VALUES}")
    table = sets.select("qoi", "xs", "ys").toArrow()
    data = shared(sets.sparkSession, {q: (_nested(table.column("xs"), i), _nested(table.column("ys"), i))
                                      for i, q in enumerate(table.column("qoi").to_pylist())})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = [loo_score(*data()[q], np.asarray(h, dtype=float))
                      for q, h in zip(batch["qoi"], batch["log_hyper"])]
            yield batch.assign(loo=scores)

    return candidates.select("qoi", "cand_id", "log_hyper").mapInPandas(
        run, "qoi string, cand_id long, log_hyper array<double>, loo double")


def hyper_priors(n_params: int) -> list[tuple[float, float]]:
    return [HYPER_LENGTH] * n_params + [HYPER_WIDTH, HYPER_NOISE]


def hyper_log_prior(n_params: int):
    total = F.lit(0.0)
    for i, (loc, scale) in enumerate(hyper_priors(n_params)):
        z = (F.get("log_hyper", F.lit(i)) - loc) / scale
        total = total - z * z * 0.5 - float(np.log(scale * np.sqrt(2 * np.pi)))
    return total


def search_hyperparameters(sets: DataFrame, n_params: int, n_candidates: int = 256,
                           rounds: int = 4, shrink: float = 0.4, seed: int = 0) -> DataFrame:
    """Best candidate per QoI by leave-one-out score plus log prior.

    Each round draws normal candidates around the best so far with a shrinking
    spread; all QoIs and candidates of a round are one job.  All scored candidates
    come back, with ``best`` marking the one winner of each QoI that has a finite score.
    """
    spark = sets.sparkSession
    sets = materialize(sets, "sets")  # read in every round
    qois = sorted(r["qoi"] for r in sets.select("qoi").collect())
    priors = hyper_priors(n_params)
    centres = {q: [loc for loc, _ in priors] for q in qois}
    spread = [scale for _, scale in priors]
    scored: DataFrame | None = None
    for round_ in range(rounds):
        first = round_ * n_candidates
        starts = spark.createDataFrame(
            [(q, centres[q]) for q in qois], "qoi string, centre array<double>")
        ids = spark.range(first, first + n_candidates).withColumnRenamed("id", "cand_id")
        rows = ids.select("cand_id", F.explode(F.array(*[F.lit(q) for q in qois])).alias("qoi"))
        rows = rows.join(starts, "qoi")
        cells = []
        for i, s in enumerate(spread):
            u = F.greatest(F.lit(2.0 ** -33), hash_uniform(
                F.lit(str(seed)), F.lit(str(i)), F.col("qoi"), F.col("cand_id")))
            rows = with_normal_quantile(rows.withColumn("__u", u), "__u", f"__z{i}").drop("__u")
            # The first candidate of a round is its centre.
            z = F.when(F.col("cand_id") == first, F.lit(0.0)).otherwise(F.col(f"__z{i}"))
            cells.append(F.get("centre", F.lit(i)) + z * F.lit(s * shrink ** round_))
        batch = score_candidates(
            rows.select("qoi", "cand_id", F.array(*cells).alias("log_hyper")), sets)
        batch = materialize(batch.withColumn("score", F.col("loo") + hyper_log_prior(n_params)),
                            "candidates")
        if scored is not None:
            # Its centre is the best of the rounds before, which has been scored.
            batch = batch.where(F.col("cand_id") != first)
        scored = batch if scored is None else scored.unionByName(batch)
        top = scored.where(~F.isnan("score") & (F.abs("score") != float("inf"))).groupBy(
            "qoi").agg(F.min_by(F.struct("log_hyper", "cand_id"),
                                F.struct(-F.col("score"), "cand_id")).alias("h")).collect()
        centres.update({r["qoi"]: list(r["h"]["log_hyper"]) for r in top})
    winner = F.lit(False)
    for r in top:
        winner = winner | ((F.col("qoi") == r["qoi"]) & (F.col("cand_id") == r["h"]["cand_id"]))
    return scored.withColumn("best", winner)


def hyper_table(rows: DataFrame, n_params: int) -> DataFrame:
    """Candidates (qoi, member, log_hyper) as (qoi, member, lengths, width, noise)."""
    e = F.transform("log_hyper", lambda v: F.exp(v))
    return rows.select("qoi", F.col("member").cast("int").alias("member"),
                       F.slice(e, 1, n_params).alias("lengths"),
                       F.get(e, F.lit(n_params)).alias("width"),
                       F.get(e, F.lit(n_params + 1)).alias("noise"))


def committee(scored: DataFrame, members: int, seed: int = 0) -> DataFrame:
    """Members per QoI: the best candidate alone, or candidates resampled by their weight."""
    from calib.operators.posterior import importance_weights, systematic_resample

    if members == 1:
        return scored.where("best").groupBy("qoi").agg(
            F.min_by("log_hyper", "cand_id").alias("log_hyper")).withColumn("member", F.lit(0))
    weights = importance_weights(scored, "score", keys=["qoi"])
    drawn = systematic_resample(weights, ["cand_id"], members, keys=["qoi"])
    return drawn.select("qoi", F.col("draw").cast("int").alias("member"), "log_hyper")
