"""Histograms, profiles, rates and per-curve features.

Curves are long: key columns, ``bin`` (0-based) and ``value``.  One curve has at
most a few hundred bins, so per-curve arrays stay small whatever the input size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calib.functions.expr import (
    array_median, gaussian_smooth, histogram_bin, peaks, savgol_smooth, vec,
)
from calib.operators.ordering import attach, number_rows, with_previous
from calib.operators.pairs import bonded_triples, donor_hydrogens, pair_counts, pair_join

EPS = float(np.finfo(float).eps)


def fill_bins(counts: DataFrame, keys: Sequence[str], n_bins: int, value: str) -> DataFrame:
    """One row per key and bin, absent bins as zero."""
    cells = F.map_from_entries(F.collect_list(F.when(
        F.col("bin").isNotNull(), F.struct("bin", value))))
    maps = counts.groupBy(*keys).agg(cells.alias("__cells"))
    bins = F.sequence(F.lit(0), F.lit(n_bins - 1))
    return maps.select(*keys, F.explode(bins).alias("bin"), "__cells").select(
        *keys, "bin", F.coalesce(F.try_element_at("__cells", F.col("bin")),
                                 F.lit(0).cast(counts.schema[value].dataType)).alias(value))


def histogram(df: DataFrame, value: str, keys: Sequence[str], r_range: tuple[float, float],
              n_bins: int, weight: Column | None = None) -> DataFrame:
    """Equal-width counts per key with empty bins as zero; out-of-range values are dropped."""
    keys = list(keys)
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    binned = df.withColumn("bin", histogram_bin(value, *r_range, n_bins)).groupBy(
        *keys, "bin").agg(total.alias("count"))
    return fill_bins(binned, keys, n_bins, "count")


def shell_volume(r_range: tuple[float, float], n_bins: int) -> Column:
    lo, step = r_range[0], (r_range[1] - r_range[0]) / n_bins
    inner = F.lit(lo) + F.col("bin") * F.lit(step)
    outer = F.lit(lo) + (F.col("bin") + 1) * F.lit(step)
    return F.lit(4.0 / 3.0 * math.pi) * (F.pow(outer, F.lit(3.0)) - F.pow(inner, F.lit(3.0)))


def pair_profile(ref: DataFrame, sel: DataFrame, keys: Sequence[str],
                 group: Sequence[str] = (), label: Sequence[str] = (),
                 r_range: tuple[float, float] = (0.0, 10.0), n_bins: int = 200,
                 smooth: bool = True) -> DataFrame:
    """Pair density profile per group and label of ``ref``.

    ``keys`` name a frame and ``group`` the subset of them that stays in the result.
    Only pairs within the range are formed; the normalising number of pairs comes
    from the sizes of the two sides.  Pairs of a frame weigh its box volume.
    """
    keys, group, label = list(keys), list(group), list(label)
    out = [*group, *label]
    pairs = pair_join(ref, sel, keys, r_range[1], keep_a=label)
    pairs = pairs.withColumnsRenamed({f"{c}_a": c for c in label})
    volume = F.coalesce(F.col("bx") * F.col("by") * F.col("bz"), F.lit(1.0))
    sums = pairs.withColumn("bin", histogram_bin("distance", *r_range, n_bins)).groupBy(
        *out, "bin").agg(F.sum(volume).alias("weight"))
    totals = pair_counts(ref, sel, keys, label).groupBy(*out).agg(
        F.sum("n_pairs").alias("n_pairs"))
    absent = totals.select(*out, F.lit(None).cast("int").alias("bin"),
                           F.lit(0.0).alias("weight"))
    filled = fill_bins(sums.unionByName(absent), out, n_bins, "weight")
    profile = attach(filled, totals, out).withColumn(
        "value", F.col("weight") / (F.col("n_pairs") * shell_volume(r_range, n_bins))
    ).select(*out, "bin", "value")
    return smooth_gaussian(profile, out) if smooth else profile


def type_profiles(atoms: DataFrame, keys: Sequence[str], solute: str | Column,
                  solvent: str | Column, group: Sequence[str] = (), min_mass: float = 0.5,
                  **options) -> DataFrame:
    """One profile per atom type found (with a real mass) in the solute.

    Reference atoms are all atoms of that type, in the solute or not.
    """
    as_column = lambda p: F.expr(p) if isinstance(p, str) else p
    types = atoms.where(as_column(solute) & (F.col("mass") > min_mass)).select("type").distinct()
    ref = atoms.join(types, "type", "left_semi")
    return pair_profile(ref, atoms.where(as_column(solvent)), keys, group, ["type"], **options)


def event_rates(atoms: DataFrame, bonds: DataFrame, keys: Sequence[str], solute: str | Column,
                solvent: str | Column, group: Sequence[str] = (), system: Sequence[str] = (),
                distance_cutoff: float = 3.5, angle_cutoff: float = 150.0,
                elements: Sequence[str] = ("O", "N", "S")) -> DataFrame:
    """Bonds per frame and label ``res(type) to res(type)``, both directions.

    Every possible donor/acceptor combination is present; when both directions give
    one label the later direction holds.
    """
    as_column = lambda p: F.expr(p) if isinstance(p, str) else p
    keys, group, system = list(keys), list(group), list(system)
    n_frames = atoms.select(*keys).distinct().groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_frames"))
    site = lambda res, typ: F.concat(res, F.lit("("), typ, F.lit(")"))
    rates, labels = [], []
    for direction, (give, take) in enumerate(((solute, solvent), (solvent, solute))):
        side, other = atoms.where(as_column(give)), atoms.where(as_column(take))
        names = side.select(*system, "atom_id", "element").distinct()
        # The bonded partner may lie outside the donor-side selection.
        partners = atoms.select(*system, "atom_id", "element").distinct()
        hyd = names.where(F.col("element") == "H").unionByName(
            partners.where(F.col("element") != "H"))
        links = donor_hydrogens(hyd, bonds, system, elements)
        acceptors = other.where(F.col("element").isin(*elements))
        donors = atoms.join(links.select(*system, F.col("donor").alias("atom_id")).distinct(),
                            [*system, "atom_id"], "left_semi")
        found = bonded_triples(donors, side.where(F.col("element") == "H"), acceptors, links,
                               keys, system, distance_cutoff, angle_cutoff,
                               ["resname", "type"], ["resname", "type"])
        found = found.withColumn("label", F.concat(
            site(F.col("donor_resname"), F.col("donor_type")), F.lit(" to "),
            site(F.col("acceptor_resname"), F.col("acceptor_type"))))
        rates.append(found.groupBy(*group, "label").agg(
            F.count(F.lit(1)).alias("events")).withColumn("direction", F.lit(direction)))
        from_ = donors.select(*group, site(F.col("resname"), F.col("type")).alias("d")).distinct()
        to = acceptors.select(*group, site(F.col("resname"), F.col("type")).alias("a")).distinct()
        # Distinct types only: gather the few acceptor types per group into an array.
        to = to.groupBy(*group).agg(F.collect_list("a").alias("as"))
        combos = attach(from_, to, group).select(*group, "d", F.explode("as").alias("a"))
        labels.append(combos.select(*group, F.concat("d", F.lit(" to "), "a").alias("label")))
    counts = rates[0].unionByName(rates[1]).groupBy(*group, "label").agg(
        F.max_by("events", "direction").alias("events"))
    possible = labels[0].unionByName(labels[1]).distinct()
    rows = attach(attach(possible, counts, [*group, "label"]), n_frames, group)
    return rows.select(
        *group, "label", (F.coalesce("events", F.lit(0)) / F.col("n_frames")).alias("value"))


def distance_distribution(a: DataFrame, b: DataFrame, keys: Sequence[str],
                          group: Sequence[str], label: Sequence[str],
                          r_range: tuple[float, float], n_bins: int) -> DataFrame:
    """Histogram of pair distances over its sum; an all-zero histogram stays zero."""
    out = [*group, *label]
    pairs = pair_join(a, b, keys, r_range[1], keep_a=list(label)).withColumnsRenamed(
        {f"{c}_a": c for c in label})
    counts = histogram(pairs, "distance", out, r_range, n_bins)
    totals = counts.groupBy(*out).agg(F.sum("count").alias("__total"))
    return attach(counts, totals, out).select(
        *out, "bin", F.coalesce(F.try_divide(F.col("count"), F.col("__total")), F.lit(0.0)
                                ).alias("value"))


def mean_box(frames: DataFrame, keys: Sequence[str], columns: Sequence[str],
             discard: float = 0.2) -> DataFrame:
    """Mean box values after the first ``discard`` share of frames, four decimals.

    The scaled mean is rounded as a double, half to even; its decimal spelling is not.
    """
    keys = list(keys)
    sizes = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    kept = attach(frames, sizes, keys).where(F.col("frame") >= F.floor(F.col("__n") * discard))
    mean = lambda c: F.sum(c).cast("double") / F.count(c)
    return kept.groupBy(*keys).agg(*[(F.rint(mean(c) * 10_000) / 10_000).alias(c) for c in columns])


# -- per-curve arrays ------------------------------------------------------

def as_array(curves: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """One array ``y`` per curve, in bin order."""
    cells = F.array_sort(F.collect_list(F.struct("bin", value)))
    return curves.groupBy(*keys).agg(cells.alias("__cells")).select(
        *keys, F.col(f"__cells.{value}").alias("y"))


def from_array(arrays: DataFrame, keys: Sequence[str], array: str = "y") -> DataFrame:
    return arrays.select(*keys, F.posexplode_outer(array).alias("bin", "value")).where(
        F.col("bin").isNotNull())


def smooth_gaussian(curves: DataFrame, keys: Sequence[str], sigma: float = 3.0) -> DataFrame:
    arrays = as_array(curves, keys)
    return from_array(arrays.withColumn("y", gaussian_smooth(F.col("y"), sigma)), keys)


def smooth_savgol(curves: DataFrame, keys: Sequence[str], n_bins: int) -> DataFrame:
    """Cubic local smoothing of curves of ``n_bins`` values, window of at most 15."""
    arrays = as_array(curves, keys)
    return from_array(arrays.withColumn("y", savgol_smooth(F.col("y"), n_bins)), keys)


def curve_peaks(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Local maxima of each curve with height and prominence."""
    arrays = as_array(curves, keys)
    return arrays.select(*keys, F.inline_outer(peaks(F.col("y")))).where(
        F.col("bin").isNotNull())


def effective_observations(curves: DataFrame, keys: Sequence[str], tolerance: float,
                           n_bins: int) -> DataFrame:
    """Effective number of resolved features per curve of ``n_bins`` values."""
    if not (tolerance > 0 and math.isfinite(tolerance)):
        raise ValueError("tolerance must be positive and finite")
    if n_bins < 11:
        raise ValueError("a curve needs at least 11 values")
    arrays = as_array(curves, keys)
    bad = (F.size("y") != n_bins) | F.exists("y", lambda v: v.isNull() | F.isnan(v)
                                             | (F.abs(v) == float("inf")))
    arrays = arrays.withColumn("y", F.when(bad, F.raise_error(F.lit(
        "a curve must hold n_bins finite values")).cast("array<double>")).otherwise(F.col("y")))
    arrays = arrays.withColumn("s", savgol_smooth(F.col("y"), n_bins))
    noise = array_median(F.zip_with("y", "s", lambda a, b: F.abs(a - b)))
    arrays = arrays.withColumn("least", F.greatest(noise * 5.0, F.lit(EPS)))
    found = F.concat(peaks(F.col("s")), peaks(F.transform("s", lambda v: -v)))
    arrays = arrays.withColumn("p", F.filter(
        found, lambda p: p["prominence"] >= F.col("least")))
    total = F.aggregate("p", F.lit(0.0), lambda acc, p: acc + F.greatest(
        F.lit(1.0), F.log(p["prominence"] / F.lit(tolerance))))
    return arrays.select(*keys, F.greatest(F.lit(1.0), total).alias("n_eff"))


def resolve_n_eff(models: DataFrame, curve_n_eff: DataFrame) -> DataFrame:
    """n_eff per QoI: given value, else the size when independent, else the sum over curves."""
    sums = curve_n_eff.groupBy("qoi").agg(F.sum("n_eff").alias("__sum"))
    return attach(models, sums, ["qoi"]).select(
        "qoi", F.coalesce("n_eff", F.when(F.col("independent"), F.col("size").cast("double")),
                          "__sum").alias("n_eff"))


def curve_dimensions(qoi: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of curves (labels) and their common length; the size must divide."""
    sized = qoi.groupBy(*keys).agg(F.count_distinct("label").alias("n_curves"),
                                   F.count(F.lit(1)).alias("size"))
    uneven = F.pmod(F.col("size"), F.col("n_curves")) != 0
    return sized.select(
        *keys, "n_curves",
        F.when(uneven, F.raise_error(F.lit("values do not divide into curves")).cast("long"))
        .otherwise((F.col("size") / F.col("n_curves")).cast("long")).alias("curve_length"))


def mean_outputs(train_y: DataFrame, keys: Sequence[str] = ("qoi",)) -> DataFrame:
    return train_y.groupBy(*keys).agg(F.avg("value").alias("value"))


def baseline_shift(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Curve minus its minimum."""
    lowest = curves.groupBy(*keys).agg(F.min("value").alias("__min"))
    return attach(curves, lowest, keys).withColumn(
        "value", F.col("value") - F.col("__min")).drop("__min")


def interpolate(points: DataFrame, keys: Sequence[str], grid: Sequence[float],
                x: str = "x", y: str = "value") -> DataFrame:
    """Linear interpolation of each curve onto ``grid``; constant beyond both ends.

    Each segment between neighbouring points emits the grid points inside it, so
    no curve is joined with the grid.
    """
    keys, grid = list(keys), sorted(float(g) for g in grid)
    rows = number_rows(points.select(*keys, F.col(x).alias("__x"), F.col(y).alias("__y")),
                       keys, ["__x"], "__i")
    rows = with_previous(rows, keys, "__i", ["__x", "__y"])
    sizes = rows.groupBy(*keys).agg(F.max("__i").alias("__n"))
    rows = attach(rows, sizes, keys)
    cells = F.transform(vec(grid), lambda g, i: F.struct(i.alias("bin"), g.alias("x")))
    x1, y1, x0, y0 = (F.col(c) for c in ("__x", "__y", "prev___x", "prev___y"))
    first, last = F.col("__i") == 1, F.col("__i") == F.col("__n")
    inside = F.filter(cells, lambda c: F.when(first, c["x"] < x1).otherwise(
        (c["x"] >= x0) & (c["x"] < x1)) | (last & (c["x"] >= x1)))
    out = rows.select(*keys, "__x", "__y", "prev___x", "prev___y", "__i", F.inline_outer(inside)).where(
        F.col("bin").isNotNull())
    between = y0 + (y1 - y0) / (x1 - x0) * (F.col("x") - x0)
    value = F.when(F.col("x") >= x1, y1).when(first, y1).otherwise(between)
    return out.select(*keys, "bin", "x", value.alias("value"))


def first_appearance(df: DataFrame, item: str, position: str, keys: Sequence[str] = ()
                     ) -> DataFrame:
    """Distinct items with their first position and their rank by it."""
    keys = list(keys)
    firsts = df.groupBy(*keys, item).agg(F.min(position).alias("first"))
    return number_rows(firsts, keys, ["first", item], "ord")
