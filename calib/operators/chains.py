"""Diagnostics over chains of draws.

Draws are long: group columns (``by``, normally the parameter and perhaps the
run), ``chain``, a gap-free 0-based ``step`` and ``value``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calib.functions.expr import with_normal_quantile
from calib.operators.ordering import (
    WINDOW_ROWS, attach, number_rows, quantiles, with_previous,
)
from calib.session import bounded_batches, materialize

LAG_BLOCK = 2048
LONG_BLOCK = 65_536
HELD_SUMS = 1 << 22
BY = ("param",)


def rank_normalize(draws: DataFrame, by: Sequence[str] = BY, value: str = "value",
                   name: str = "z", window_rows: int = WINDOW_ROWS, rank: str | None = None,
                   stored: bool = False) -> DataFrame:
    """Normal scores of ordinal ranks; ties go by step, then chain.

    ``rank`` names a column that keeps the rank, with ``<rank>_of`` for the group size;
    ``stored`` ranks are ordered once for all uses.
    """
    by = list(by)
    r = rank or "__rank"
    ranked = number_rows(draws, by, [value, "step", "chain"], r, window_rows, stored)
    sizes = draws.groupBy(*by).agg(F.count(F.lit(1)).alias(f"{r}_of"))
    u = (F.col(r) - 0.375) / (F.col(f"{r}_of") + 0.25)
    u = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), u))
    scored = with_normal_quantile(attach(ranked, sizes, by).withColumn("__u", u), "__u", name)
    return scored.drop("__u") if rank else scored.drop("__u", r, f"{r}_of")


def fold(draws: DataFrame, by: Sequence[str] = BY, value: str = "value", name: str = "folded",
         window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Distance from the lower median of the pooled draws."""
    by = list(by)
    middle = quantiles(draws, by, value, [0.5], ["__median"], interpolate=False,
                       window_rows=window_rows)
    return attach(draws, middle, by).withColumn(
        name, F.abs(F.col(value) - F.col("__median"))).drop("__median")


def step_counts(draws: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return draws.groupBy(*by).agg((F.max("step") + 1).alias("__steps"))


def split_halves(draws: DataFrame, by: Sequence[str] = BY, steps: DataFrame | None = None
                 ) -> DataFrame:
    """Add ``half`` 0/1; the middle step of an odd count is left out."""
    by = list(by)
    out = attach(draws, step_counts(draws, by) if steps is None else steps, by)
    h = F.floor(F.col("__steps") / 2)
    h = F.when(h < 2, F.raise_error(F.lit("a chain needs four steps to be halved")).cast("long")
               ).otherwise(h)
    half = F.when(F.col("step") < h, 0).when(F.col("step") >= F.col("__steps") - h, 1)
    return out.withColumn("half", half).where(F.col("half").isNotNull()).drop("__steps")


def split_rhat(draws: DataFrame, by: Sequence[str] = BY, value: str = "value",
               name: str = "rhat", steps: DataFrame | None = None) -> DataFrame:
    """Split R-hat per group."""
    by = list(by)
    halves = split_halves(draws, by, steps).groupBy(*by, "chain", "half").agg(
        F.count(F.lit(1)).alias("__n"), F.avg(value).alias("__mean"),
        F.var_samp(value).alias("__var"))
    pooled = halves.groupBy(*by).agg(
        F.max("__n").cast("double").alias("__n"), F.avg("__var").alias("__w"),
        F.var_samp("__mean").alias("__bn"))
    n, w = F.col("__n"), F.col("__w")
    ratio = F.try_divide((n - 1) / n * w + F.col("__bn"), w)
    return pooled.select(*by, F.sqrt(ratio).alias(name))


def ranked_draws(draws: DataFrame, by: Sequence[str] = BY, window_rows: int = WINDOW_ROWS
                 ) -> DataFrame:
    """Draws with normal scores ``z`` and ranks, stored for several uses."""
    return materialize(
        rank_normalize(draws.select(*by, "chain", "step", "value"), by, window_rows=window_rows,
                       rank="rank"), "ranked")


def rank_split_rhat(draws: DataFrame, by: Sequence[str] = BY,
                    window_rows: int = WINDOW_ROWS, ranked: DataFrame | None = None) -> DataFrame:
    """Larger of the rank-normalised split R-hat of the draws and of the folded draws.

    The lower median is read off the ranks, so only two global orderings are made.
    ``ranked`` may hand in the result of ``ranked_draws``; otherwise only the ranks are
    stored, as the scores are read once.
    """
    by = list(by)
    if ranked is None:
        ranked = rank_normalize(draws.select(*by, "chain", "step", "value"), by,
                                window_rows=window_rows, rank="rank", stored=True)
    steps = step_counts(ranked, by)
    plain = split_rhat(ranked, by, "z", "rhat_rank", steps)
    middle = ranked.where(F.col("rank") == F.floor((F.col("rank_of") + 1) / 2)).select(
        *by, F.col("value").alias("__median"))
    folded = attach(ranked.select(*by, "chain", "step", "value"), middle, by).select(
        *by, "chain", "step", F.abs(F.col("value") - F.col("__median")).alias("value"))
    folded = rank_normalize(folded, by, window_rows=window_rows)
    folded = split_rhat(folded, by, "z", "rhat_folded", steps)
    return attach(plain, folded, by, "inner").withColumn(
        "rhat", F.greatest("rhat_rank", "rhat_folded"))


def _blocks(draws: DataFrame, series: Sequence[str], value: str, block: int) -> DataFrame:
    """(series, n_steps, b, xs): the centred values of each chain, ``block`` steps a row."""
    means = draws.groupBy(*series).agg(
        F.avg(value).alias("__mean"), (F.max("step") + 1).cast("long").alias("n_steps"))
    rows = attach(draws, means, series).select(
        *series, "n_steps", F.floor(F.col("step") / block).cast("long").alias("b"), "step",
        (F.col(value) - F.col("__mean")).alias("x"))
    cells = F.array_sort(F.collect_list(F.struct("step", "x")))
    return rows.groupBy(*series, "n_steps", "b").agg(cells.alias("c")).select(
        *series, "n_steps", "b", F.col("c.x").alias("xs"))


def _tile_product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of x[i] * y[i + m] for m from 1 - len(x) to len(y) - 1."""
    if min(len(x), len(y)) <= 64:
        return np.correlate(y, x, "full")
    size = 1 << int(len(x) + len(y) - 1).bit_length()
    out = np.fft.irfft(np.fft.rfft(y, size) * np.conj(np.fft.rfft(x, size)), size)
    return np.concatenate([out[size - len(x) + 1:], out[:len(y)]])


def _added(sums: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of equal ``key`` added up; a task holds one array at a time."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, total = None, None
        for batch in batches:
            for k, v in zip(batch[list(key)].itertuples(index=False, name=None), batch["sums"]):
                if k == last:
                    total += v
                    continue
                if last is not None:
                    yield pd.DataFrame([(*last, total)], columns=[*key, "sums"])
                last, total = k, np.array(v)
        if last is not None:
            yield pd.DataFrame([(*last, total)], columns=[*key, "sums"])

    return sums.repartition(*key).sortWithinPartitions(*key).mapInPandas(add, sums.schema)


def _lag_sums(blocks: DataFrame, series: Sequence[str], low: int, high: int | None, block: int
              ) -> DataFrame:
    """(series, n_steps, lag, s): lag sums of all lags from ``low`` to below ``high``.

    Lag k pairs a block with those k // block and k // block + 1 blocks later.  A task holds
    two blocks at a time; the sums of ``block`` lags are one array, and arrays are added up
    before they become rows.
    """
    bounded_batches(blocks.sparkSession)
    last = F.floor((F.col("n_steps") - 1) / block) - F.col("b")
    if high is not None:
        last = F.least(last, F.lit((high - 1) // block + 1))
    first = low // block
    left = blocks.where(last >= first).withColumn(
        "d", F.explode(F.sequence(F.lit(first).cast("long"), last.cast("long"))))
    left = left.withColumn("c", F.col("b") + F.col("d")).drop("b").withColumnRenamed("xs", "left")
    right = blocks.select(*series, F.col("b").alias("c"), F.col("xs").alias("right"))
    pairs = left.join(right, [*series, "c"]).select(*series, "n_steps", "d", "left", "right")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for k, v in held.items():
                yield pd.DataFrame([(*k, v)], columns=[*series, "n_steps", "first", "sums"])
            held.clear()

        for batch in batches:
            for key, x, y in zip(batch[[*series, "n_steps", "d"]].itertuples(index=False, name=None),
                                 batch["left"], batch["right"]):
                n, d = int(key[-2]), int(key[-1])
                got = _tile_product(np.asarray(x), np.asarray(y))
                at = d * block - len(x) + 1  # the lag of the first product
                for k in (d - 1, d):
                    start = max(low, k * block)
                    stop = min((k + 1) * block, n, n if high is None else high)
                    a, b = max(start, at), min(stop, at + len(got))
                    if b > a:
                        sums = held.setdefault((*key[:-2], n, start), np.zeros(stop - start))
                        sums[a - start:b - start] += got[a - at:b - at]
            if len(held) * block > HELD_SUMS:
                yield from flush()
        yield from flush()

    kept = ", ".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in series)
    sums = pairs.mapInPandas(add, f"{kept}, n_steps long, first long, sums array<double>")
    return _added(sums, [*series, "n_steps", "first"]).select(
        *series, "n_steps", "first", F.posexplode("sums").alias("p", "s")).select(
        *series, "n_steps", (F.col("first") + F.col("p")).alias("lag"), "s")


def _rho(sums: DataFrame, zero: DataFrame, series: Sequence[str]) -> DataFrame:
    """Autocorrelation from lag sums and the lag sum ``var`` of lag 0 per step."""
    cov = F.col("s") / (F.col("n_steps") - F.col("lag"))
    return attach(sums, zero, series).withColumn(
        "rho", F.when(F.col("var") > 0, cov / F.col("var")).otherwise(F.lit(0.0)))


def autocorrelation(draws: DataFrame, by: Sequence[str] = BY, value: str = "value",
                    max_lag: int | None = None, block: int | None = None) -> DataFrame:
    """Autocorrelation of every chain at all its lags, or up to ``max_lag``.

    Chains are cut into blocks of steps.  Every pair of blocks is one product, so long
    chains spread over many tasks, and the sums of the pairs add up exactly.  Blocks grow
    with the longest chain to at most ``LONG_BLOCK`` steps, so that pairs stay few.
    """
    series = [*by, "chain"]
    if block is None:
        longest = draws.agg(F.max("step") + 1).first()[0] or 1
        block = min(max(LAG_BLOCK, 1 << ((longest - 1) // 8).bit_length()), LONG_BLOCK)
    blocks = materialize(_blocks(draws, series, value, block), "blocks")
    sums = materialize(_lag_sums(blocks, series, 0, None if max_lag is None else max_lag + 1, block), "lags")
    zero = sums.where("lag = 0").select(*series, (F.col("s") / F.col("n_steps")).alias("var"))
    return _rho(sums, zero, series).select(
        *series, "n_steps", F.col("lag").cast("int").alias("lag"), "rho")


def autocorr_time(draws: DataFrame, by: Sequence[str] = BY, value: str = "value",
                  max_lag: int | None = None, first_lag: int = 128,
                  block: int = LAG_BLOCK) -> DataFrame:
    """1 + 2 * (sum of rho up to its first non-positive lag), at least 1, per chain.

    Lags are extended in rounds, only for chains whose rho is still positive; a round adds
    its own lags to the sum of the rounds before.
    """
    series = [*by, "chain"]
    blocks = materialize(_blocks(draws, series, value, block), "blocks")
    cap = F.col("n_steps") if max_lag is None else F.least(F.col("n_steps"), F.lit(max_lag + 1))
    done: DataFrame | None = None
    state: DataFrame | None = None
    low, high = 0, first_lag + 1
    while True:
        if max_lag is not None:
            high = min(high, max_lag + 1)
        sums = _lag_sums(blocks, series, low, high, block)
        if state is None:
            sums = materialize(sums, "lags")
            state = sums.where("lag = 0").select(
                *series, (F.col("s") / F.col("n_steps")).alias("var"), F.lit(0.0).alias("sum"))
        rho = _rho(sums, state, series)
        cut = rho.groupBy(*series).agg(
            F.min(F.when((F.col("lag") > 0) & (F.col("rho") <= 0), F.col("lag"))).alias("cut"))
        counted = (F.col("lag") > 0) & (F.col("cut").isNull() | (F.col("lag") < F.col("cut")))
        now = materialize(attach(rho, cut, series).groupBy(*series).agg(
            F.first("n_steps").alias("n_steps"), F.first("cut").alias("cut"), F.first("var").alias("var"),
            (F.first("sum") + F.sum(F.when(counted, F.col("rho")).otherwise(F.lit(0.0)))).alias("sum")), "tau")
        settled = F.col("cut").isNotNull() | (cap <= high)
        part = now.where(settled).select(
            *series, F.greatest(F.lit(1.0), 1 + 2 * F.col("sum")).alias("tau"))
        done = part if done is None else done.unionByName(part)
        state = now.where(~settled).select(*series, "var", "sum")
        if state.isEmpty():
            return done
        blocks = blocks.join(state.select(*series), series, "left_semi")
        low, high = high, (high - 1) * 8 + 1


def effective_sample_size(draws: DataFrame, by: Sequence[str] = BY, value: str = "value",
                          ) -> DataFrame:
    """Number of draws over the mean autocorrelation time of the chains."""
    by = list(by)
    tau = autocorr_time(draws, by, value).groupBy(*by).agg(
        F.avg("tau").alias("tau"), F.count(F.lit(1)).alias("n_chains"))
    sizes = draws.groupBy(*by).agg(F.count(F.lit(1)).alias("n_draws"))
    return attach(tau, sizes, by, "inner").withColumn("ess", F.col("n_draws") / F.col("tau"))


def convergence_report(draws: DataFrame, run: Sequence[str] = (), param: str = "param",
                       rhat_max: float = 1.01, ess_min: float = 100.0,
                       min_steps: int = 20) -> DataFrame:
    """R-hat, tau, ESS per parameter and the verdict of the whole run."""
    by = [*run, param]
    ranked = ranked_draws(draws, by)
    ess = effective_sample_size(ranked, by, "z")
    rhat = rank_split_rhat(ranked, by, ranked=ranked)
    steps = ranked.groupBy(*by).agg((F.max("step") + 1).cast("long").alias("n_steps"))
    rows = attach(attach(rhat, ess, by, "inner"), steps, by, "inner").select(
        *by, "n_steps", "n_draws", "rhat", "tau", "ess")
    rows = materialize(rows, "convergence")
    verdict = rows.groupBy(*run).agg(
        F.max("rhat").alias("max_rhat"), F.min("ess").alias("min_ess"),
        F.min("n_steps").alias("__steps"))
    verdict = verdict.withColumn(
        "converged", (F.col("__steps") >= min_steps) & (F.col("max_rhat") < rhat_max)
        & (F.col("min_ess") > ess_min)).drop("__steps")
    return attach(rows, verdict, list(run))


def thin(draws: DataFrame, discard: int, stride: int) -> DataFrame:
    """Steps discard, discard + stride, ..."""
    return draws.where((F.col("step") >= discard)
                       & (F.pmod(F.col("step") - discard, F.lit(stride)) == 0))


def default_thinning(tau: DataFrame) -> tuple[int, int]:
    """Burn-in of twice the largest tau and stride of half the smallest."""
    top, low = tau.agg(F.max("tau"), F.min("tau")).first()
    return int(2 * top), max(1, int(0.5 * low))


def renumber_steps(draws: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Give the distinct steps of each group gap-free 0-based numbers."""
    by = list(by)
    steps = draws.select(*by, "step").distinct()
    numbered = number_rows(steps, by, ["step"], "__new")
    return attach(draws, numbered, [*by, "step"]).withColumn(
        "step", F.col("__new") - 1).drop("__new")


def acceptance_rate(draws: DataFrame, run: Sequence[str], params: Sequence[str],
                    warmup: int = 0) -> DataFrame:
    """Share of moves (any parameter changed) after the warm-up; wide draws."""
    run = list(run)
    moved = F.lit(False)
    for p in params:
        moved = moved | (F.col(p) != F.col(f"prev_{p}"))
    rows = with_previous(draws.where(F.col("step") >= warmup), [*run, "chain"], "step", params)
    moves = rows.where(F.col(f"prev_{params[0]}").isNotNull())
    out = moves.groupBy(*run) if run else moves
    return out.agg(F.count(F.lit(1)).alias("n_moves"),
                   F.avg(moved.cast("double")).alias("acceptance_rate"))


def accepted_share(draws: DataFrame, run: Sequence[str], flag: str = "accepted",
                   warmup: int = 0) -> DataFrame:
    """Share of accepted proposals after the warm-up, from a boolean column."""
    kept = draws.where(F.col("step") >= warmup)
    return (kept.groupBy(*run) if run else kept).agg(
        F.avg(F.col(flag).cast("double")).alias("acceptance_rate"))


def moment_columns(params: Sequence[str]) -> list[Column]:
    """Mergeable sums: count, sum x_i, sum x_i * x_j for i <= j."""
    out = [F.count(F.lit(1)).alias("n")]
    out += [F.sum(p).alias(f"s_{p}") for p in params]
    out += [F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}")
            for i, a in enumerate(params) for b in params[i:]]
    return out


def covariance(draws: DataFrame, run: Sequence[str], params: Sequence[str]) -> DataFrame:
    """Long sample covariance (identity below two rows) and proposal scale 2.38^2/d."""
    scale = 2.38 ** 2 / len(params)
    n = F.count(F.lit(1))
    cells = []
    for a in params:
        for b in params:
            cov = F.covar_samp(a, b) if a != b else F.var_samp(a)
            cells.append(F.struct(
                F.lit(a).alias("param_i"), F.lit(b).alias("param_j"),
                F.when(n < 2, F.lit(1.0 if a == b else 0.0)).otherwise(cov).alias("cov")))
    grouped = draws.groupBy(*run) if run else draws.groupBy()
    table = grouped.agg(n.alias("n"), F.array(*cells).alias("cells"))
    return table.select(*run, "n", F.inline("cells")).withColumn(
        "proposal_cov", F.col("cov") * scale)


def incomplete_steps(draws: DataFrame, run: Sequence[str] = (), param: str = "param",
                     ) -> DataFrame:
    """Steps that lack a chain or a parameter (or hold one twice)."""
    run = list(run)
    per_step = draws.groupBy(*run, "step").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.count_distinct("chain", param).alias("n_cells"))
    shape = attach(
        draws.select(*run, "chain").distinct().groupBy(*run).agg(
            F.count(F.lit(1)).alias("__chains")),
        draws.select(*run, param).distinct().groupBy(*run).agg(
            F.count(F.lit(1)).alias("__params")), run)
    rows = attach(per_step, shape.withColumn(
        "expected", F.col("__chains") * F.col("__params")).select(*run, "expected"), run)
    return rows.where((F.col("n_values") != F.col("expected"))
                      | (F.col("n_cells") != F.col("expected")))
