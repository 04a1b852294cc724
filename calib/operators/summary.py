"""Prepared posterior rows, summaries, densities and attribution.

Prepared rows are wide: one column per parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calib.operators.chains import autocorr_time, thin
from calib.operators.ordering import WINDOW_ROWS, attach, quantiles

CHUNK = 1 << 22
LOG_SIGMA = "log_sigma_"


def to_long(df: DataFrame, params: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    pairs = [F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value"))
             for p in params]
    return df.select(*keep, F.inline(F.array(*pairs)))


def wide_quantiles(df: DataFrame, params: Sequence[str], probs: Sequence[float],
                   names: Sequence[str], window_rows: int = WINDOW_ROWS) -> DataFrame:
    """One row per column of ``params`` with its exact quantiles."""
    return quantiles(to_long(df, params), ["param"], "value", probs, names,
                     window_rows=window_rows)


def exp_nuisances(df: DataFrame) -> DataFrame:
    """Columns log_sigma_* become sigma_*."""
    return df.select(*[
        F.exp(c).alias("sigma_" + c[len(LOG_SIGMA):]) if c.startswith(LOG_SIGMA) else F.col(c)
        for c in df.columns])


def log_nuisances(df: DataFrame) -> DataFrame:
    """Columns sigma_* become log_sigma_*."""
    return df.select(*[F.log(c).alias("log_" + c) if c.startswith("sigma_") else F.col(c)
                       for c in df.columns])


def strip_outliers(df: DataFrame, params: Sequence[str], share: float = 0.01,
                   window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Rows whose every parameter lies within its central ``1 - share`` quantiles."""
    limits = wide_quantiles(df, params, [share / 2, 1 - share / 2], ["lo", "hi"], window_rows)
    edges = {r["param"]: (r["lo"], r["hi"]) for r in limits.collect()}
    keep = F.lit(True)
    for p in params:
        if p in edges:
            keep = keep & F.col(p).between(*[F.lit(v) for v in edges[p]])
    return df.where(keep)


def prepare_samples(draws: DataFrame, params: Sequence[str], discard: int, stride: int,
                    transform: Callable[[DataFrame], DataFrame] | None = None,
                    implicit: Callable[[DataFrame], DataFrame] | None = None,
                    outliers: bool = True) -> DataFrame:
    """Burn-in and thinning, transform, implicit columns, outlier strip; wide draws."""
    rows = thin(draws, discard, stride)
    if rows.isEmpty():
        raise ValueError("no draws remain after discard and thinning; use smaller values")
    before = set(rows.columns) - set(params)
    rows = (transform or exp_nuisances)(rows)
    if implicit is not None:
        rows = implicit(rows)
    if not outliers:
        return rows
    return strip_outliers(rows, [c for c in rows.columns if c not in before])


def posterior_summary(df: DataFrame, params: Sequence[str], draws: DataFrame | None = None) -> DataFrame:
    """Mean and population standard deviation of each parameter.

    ``draws``, the raw chains (param, chain, step, value), add ``autocorr_time``: the mean of
    the chains' integrated autocorrelation times.
    """
    stats = df.agg(F.array(*[
        F.struct(F.lit(p).alias("param"), F.avg(p).alias("mean"),
                 F.stddev_pop(p).alias("std")) for p in params]).alias("s"))
    rows = stats.select(F.inline("s"))
    if draws is None:
        return rows
    tau = autocorr_time(draws.where(F.col("param").isin(*params))).groupBy("param").agg(
        F.avg("tau").alias("autocorr_time"))
    return attach(rows, tau, ["param"])


def credible_intervals(df: DataFrame, params: Sequence[str],
                       window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Median with the distances to the 84 % and 16 % quantiles."""
    q = wide_quantiles(df, params, [0.16, 0.5, 0.84], ["q16", "q50", "q84"], window_rows)
    return q.select("param", F.col("q50").alias("median"),
                    (F.col("q84") - F.col("q50")).alias("upper"),
                    (F.col("q50") - F.col("q16")).alias("lower"))


def robust_standardize(df: DataFrame, keys: Sequence[str], value: str, name: str = "score",
                       window_rows: int = WINDOW_ROWS) -> DataFrame:
    """(x - median) / IQR; the scale falls back to the standard deviation, then 1."""
    keys = list(keys)
    q = quantiles(df, keys, value, [0.25, 0.5, 0.75], ["__q1", "__q2", "__q3"],
                  window_rows=window_rows)
    sd = df.groupBy(*keys).agg(F.stddev_pop(value).alias("__sd"))
    rows = attach(attach(df, q, keys), sd, keys)
    iqr = F.col("__q3") - F.col("__q1")
    scale = F.when(iqr > 1e-12, iqr).when(F.col("__sd") > 1e-12, F.col("__sd")).otherwise(
        F.lit(1.0))
    return rows.withColumn(name, (F.col(value) - F.col("__q2")) / scale).drop(
        "__q1", "__q2", "__q3", "__sd")


# -- kernel sums on a grid -------------------------------------------------
# Every task adds its rows into one vector of grid sums, so only vectors of grid
# length are shuffled, whatever the number of draws.

def _grid_sums(points: DataFrame, columns: Sequence[str], grid: np.ndarray,
               kernel: Callable[[np.ndarray, np.ndarray], np.ndarray],
               weights: Sequence[str] = ()) -> np.ndarray:
    """Sums over rows of weight * kernel(x, grid), one row of sums per weight column.

    Without weights every row counts once, and equal rows of a batch are merged.
    """
    dim, n_sums = len(columns), max(len(weights), 1)
    size = len(grid) * n_sums

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_sums, len(grid)))
        rows = max(1, CHUNK // len(grid))
        seen = False
        for batch in batches:
            data = batch.to_numpy(dtype=float)
            if weights:
                x, w = data[:, :dim], data[:, dim:]
            else:
                x, counts = np.unique(data, axis=0, return_counts=True)
                w = counts[:, None].astype(float)
            for at in range(0, len(x), rows):
                total += w[at:at + rows].T @ kernel(x[at:at + rows], grid)
                seen = True
        if seen:
            yield pd.DataFrame({"i": np.arange(size), "s": total.ravel()})

    parts = points.select(*columns, *weights).mapInPandas(sums, "i int, s double")
    out = np.zeros(size)
    for r in parts.groupBy("i").agg(F.sum("s").alias("s")).collect():
        out[r["i"]] = r["s"]
    return out.reshape(n_sums, len(grid))


def kde_grid(df: DataFrame, param: str, n_points: int = 400,
             ) -> tuple[np.ndarray, np.ndarray]:
    """Grid over the range of the draws and the Gaussian density on it."""
    n, lo, hi, var = df.agg(F.count(param), F.min(param), F.max(param),
                            F.var_samp(param)).first()
    grid = np.linspace(float(lo), float(hi), n_points)
    h = float(np.sqrt(var)) * n ** (-1.0 / 5.0)
    sums = _grid_sums(df, [param], grid[:, None],
                      lambda x, g: np.exp(-0.5 * ((x - g.T) / h) ** 2))
    return grid, sums[0] / (n * h * np.sqrt(2 * np.pi))


def kde(df: DataFrame, param: str, n_points: int = 400) -> DataFrame:
    """Scott-rule Gaussian kernel density of one parameter on an even grid."""
    grid, density = kde_grid(df, param, n_points)
    return df.sparkSession.createDataFrame(
        [(i, float(x), float(d)) for i, (x, d) in enumerate(zip(grid, density))],
        "point int, x double, density double")


def kde_2d(df: DataFrame, x: str, y: str, n_points: int = 100) -> DataFrame:
    """Gaussian kernel density of two parameters on a square grid."""
    n, x0, x1, y0, y1, vx, vy, cxy = df.agg(
        F.count(F.lit(1)), F.min(x), F.max(x), F.min(y), F.max(y),
        F.var_samp(x), F.var_samp(y), F.covar_samp(x, y)).first()
    cov = np.array([[vx, cxy], [cxy, vy]], dtype=float) * n ** (-2.0 / 6.0)
    root = np.linalg.cholesky(np.linalg.inv(cov))
    gx, gy = np.linspace(x0, x1, n_points), np.linspace(y0, y1, n_points)
    grid = np.array([(a, b) for a in gx for b in gy])

    def kernel(p, g):
        p, g = p @ root, g @ root
        d2 = (p[:, :1] - g[:, 0]) ** 2 + (p[:, 1:] - g[:, 1]) ** 2
        return np.exp(-0.5 * d2)

    sums = _grid_sums(df, [x, y], grid, kernel)[0]
    density = sums / (n * 2 * np.pi * np.sqrt(np.linalg.det(cov)))
    rows = [(i, j, float(gx[i]), float(gy[j]), float(density[i * n_points + j]))
            for i in range(n_points) for j in range(n_points)]
    return df.sparkSession.createDataFrame(
        rows, "point_x int, point_y int, x double, y double, density double")


def posterior_mode(df: DataFrame, param: str, n_points: int = 1000) -> tuple[float, float]:
    """Grid point of the highest density and that density; the first one on ties."""
    grid, density = kde_grid(df, param, n_points)
    best = int(np.argmax(density))
    return float(grid[best]), float(density[best])


def posterior_modes(df: DataFrame, params: Sequence[str], n_points: int = 1000) -> DataFrame:
    rows = [(p, *posterior_mode(df, p, n_points)) for p in params]
    return df.sparkSession.createDataFrame(rows, "param string, mode double, density double")


def responsibilities(df: DataFrame, param: str, scores: Sequence[str], n_points: int = 400,
                     temperature: float = 0.7) -> DataFrame:
    """Share of each QoI in shaping the posterior along one parameter.

    ``scores`` are standardised log-likelihood columns, one per QoI.
    """
    if not temperature > 0:
        raise ValueError("temperature must be positive")
    grid, density = kde_grid(df, param, n_points)
    n, sd, lo, hi = df.agg(F.count(param), F.stddev_pop(param), F.min(param),
                           F.max(param)).first()
    h = max(n ** -0.2 * sd, (hi - lo) / 100.0, 1e-8)
    sums = _grid_sums(df.withColumn("__one", F.lit(1.0)), [param], grid[:, None],
                      lambda x, g: np.exp(-0.5 * ((x - g.T) / h) ** 2), [*scores, "__one"])
    local = sums[:-1] / np.maximum(sums[-1], 1e-12)
    baseline = (local * density).sum(axis=1, keepdims=True) / density.sum()
    shifted = (local - baseline) / temperature
    shares = softmax(shifted)
    rows = [(i, float(grid[i]), q, float(shares[k, i]))
            for k, q in enumerate(scores) for i in range(n_points)]
    return df.sparkSession.createDataFrame(
        rows, "point int, x double, qoi string, responsibility double")


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=0))
    return e / e.sum(axis=0)


def softmax_columns(cols: Sequence[str], temperature: float = 1.0) -> list[Column]:
    """Softmax over columns of one row, one expression per column."""
    top = F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])
    e = [F.exp((F.col(c) - top) / temperature) for c in cols]
    total = sum(e[1:], e[0])
    return [v / total for v in e]
