"""Scalar and array Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEG_INF = float("-inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vec(values: Sequence[float]) -> Column:
    """Literal array of doubles."""
    return F.array(*[F.lit(float(v)) for v in values])


# -- hash uniforms ---------------------------------------------------------

def hash_uniform(*parts) -> Column:
    """Uniform in [0, 1) that depends only on the parts (32 bits of md5)."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *cols))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_order(*parts) -> Column:
    """Pseudo-random sort key that depends only on the parts."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *cols))


# -- normal quantile -------------------------------------------------------

# Coefficients of Wichura's algorithm AS 241 (PPND16).
_CENTRE_NUM = (
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
    1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
    3.3430575583588128105e4, 2.5090809287301226727e3,
)
_CENTRE_DEN = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
    5.2264952788528545610e3,
)
_MID_NUM = (
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
    3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
    2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
_MID_DEN = (
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
    1.05075007164441684324e-9,
)
_TAIL_NUM = (
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
    2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
    2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
_TAIL_DEN = (
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
    2.04426310338993978564e-15,
)


def _poly_sql(coefs: Sequence[float], x: str) -> str:
    text = f"{coefs[-1]!r}e0" if "e" not in repr(coefs[-1]) else repr(coefs[-1])
    for c in reversed(coefs[:-1]):
        lit = repr(c) if "e" in repr(c) else f"{c!r}e0"
        text = f"({text} * {x} + {lit})"
    return text


def normal_quantile_sql(u: str) -> str:
    """SQL text of the standard normal quantile of ``u`` in (0, 1)."""
    q = f"({u} - 0.5e0)"
    s = f"(0.180625e0 - {q} * {q})"
    r = f"sqrt(-ln(least({u}, 1e0 - {u})))"
    mid, tail = f"({r} - 1.6e0)", f"({r} - 5e0)"
    return (
        f"CASE WHEN abs({q}) <= 0.425e0 "
        f"THEN {q} * {_poly_sql(_CENTRE_NUM, s)} / {_poly_sql(_CENTRE_DEN, s)} "
        f"ELSE sign({q}) * CASE WHEN {r} <= 5e0 "
        f"THEN {_poly_sql(_MID_NUM, mid)} / {_poly_sql(_MID_DEN, mid)} "
        f"ELSE {_poly_sql(_TAIL_NUM, tail)} / {_poly_sql(_TAIL_DEN, tail)} END END"
    )


def with_normal_quantile(df: DataFrame, u: str, name: str) -> DataFrame:
    """Add the standard normal quantile sqrt(2) * erfinv(2u - 1) of column ``u``.

    Built in steps, so every intermediate value is computed once per row; the last one
    passes through a generator, so that a later filter on it is not pushed into the steps.
    A generator is not compiled, so it gets the finished value.  Names that start with
    ``__z_`` are taken by the steps.
    """

    def poly(coefs):
        total = F.lit(coefs[-1])
        for c in reversed(coefs[:-1]):
            total = total * F.col("__z_t") + c
        return total

    q = F.col("__z_q")
    root = F.sqrt(-F.log(F.least(F.col(u), F.lit(1.0) - F.col(u))))
    steps = (
        df.withColumn("__z_q", F.col(u) - 0.5)
        .withColumn("__z_r", F.when(F.abs(q) > 0.425, root))
        .withColumn("__z_b", F.when(F.abs(q) <= 0.425, 0).when(F.col("__z_r") <= 5.0, 1).otherwise(2))
        .withColumn("__z_t", F.when(F.col("__z_b") == 0, F.lit(0.180625) - q * q)
                    .otherwise(F.col("__z_r") - F.when(F.col("__z_b") == 1, 1.6).otherwise(5.0)))
    )
    sign = F.signum(q)
    z = F.when(F.col("__z_b") == 0, q * poly(_CENTRE_NUM) / poly(_CENTRE_DEN)).when(
        F.col("__z_b") == 1, sign * poly(_MID_NUM) / poly(_MID_DEN)).otherwise(
        sign * poly(_TAIL_NUM) / poly(_TAIL_DEN))
    return steps.withColumn("__z_done", z).withColumn(name, F.explode(F.array("__z_done"))).drop(
        "__z_q", "__z_r", "__z_b", "__z_t", "__z_done")


# -- kernels and mean functions -------------------------------------------

def rbf_kernel(x: Column, y: Column, lengths: Column, width: Column) -> Column:
    """width^2 * exp(-1/2 * sum(((x - y) / length)^2)) on array columns."""
    diff = F.zip_with(x, y, lambda a, b: a - b)
    scaled = F.zip_with(diff, lengths, lambda a, b: (a / b) * (a / b))
    dist = F.aggregate(scaled, F.lit(0.0), lambda acc, v: acc + v)
    return width * width * F.exp(dist * -0.5)


def sigmoid_mean(x: str | Column, slope: float = 5.0, centre: float = 3.0) -> Column:
    """Sigmoid rising from 0 to 1 around ``centre``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp((col(x) - centre) * -slope))


def bin_centre(bin_: str | Column, lo: float, hi: float, n_bins: int) -> Column:
    return F.lit(lo) + (col(bin_) + 0.5) * ((hi - lo) / n_bins)


def mie_mean(r: str | Column, epsilon, sigma, n, m=6.0, kt=1.0) -> Column:
    """exp(-V(r)/kT) for a Mie potential with exponents n and m."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    r, epsilon, sigma, n, m, kt = col(r), *map(lit, (epsilon, sigma, n, m, kt))
    prefactor = n / (n - m) * F.pow(n / m, m / (n - m))
    ratio = sigma / r
    energy = prefactor * epsilon * (F.pow(ratio, n) - F.pow(ratio, m))
    return F.exp(-energy / kt)


# -- densities -------------------------------------------------------------

def normal_logpdf(x: Column, loc: Column, scale: Column) -> Column:
    z = (x - loc) / scale
    return z * z * -0.5 - F.log(scale) - F.lit(0.5 * float(np.log(2 * np.pi)))


def uniform_logpdf(x: Column, lower: Column, upper: Column) -> Column:
    inside = (x >= lower) & (x <= upper)
    return F.when(inside, -F.log(upper - lower)).otherwise(F.lit(NEG_INF))


def prior_logpdf(kind: Column, x: Column, a: Column, b: Column) -> Column:
    """Log density of a normal(a, b) or uniform(a, b) prior."""
    return F.when(kind == "normal", normal_logpdf(x, a, b)).otherwise(uniform_logpdf(x, a, b))


def prior_mean(kind: Column, a: Column, b: Column) -> Column:
    return F.when(kind == "normal", a).otherwise((a + b) / 2.0)


def prior_scale(kind: Column, a: Column, b: Column) -> Column:
    return F.when(kind == "normal", b).otherwise((b - a) / F.sqrt(F.lit(12.0)))


def finite_or_neg_inf(x: str | Column) -> Column:
    """NaN and +inf become -inf; NULL stays NULL."""
    x = col(x)
    bad = F.isnan(x) | (x == F.lit(float("inf")))
    return F.when(bad, F.lit(NEG_INF)).otherwise(x)


# -- periodic geometry -----------------------------------------------------

def min_image(delta: Column, length: Column) -> Column:
    """Shortest periodic image of a coordinate difference (half-even rounding)."""
    return F.when(length.isNull(), delta).otherwise(delta - F.rint(delta / length) * length)


def norm3(dx: Column, dy: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def angle(u: Sequence[Column], v: Sequence[Column]) -> Column:
    """Angle in radians between two vectors."""
    dot = u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    cosine = F.try_divide(dot, norm3(*u) * norm3(*v))
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


def cell_vectors(a: Column, b: Column, c: Column, alpha: Column, beta: Column,
                 gamma: Column) -> Column:
    """Nine cell-vector components from lengths and angles in degrees."""
    ca, cb, cg = (F.cos(F.radians(x)) for x in (alpha, beta, gamma))
    sg = F.sin(F.radians(gamma))
    sg = F.when(F.abs(sg) < 1e-12, F.raise_error(F.lit("degenerate cell: sin(gamma) is zero"))
                .cast("double")).otherwise(sg)
    cx, cy = c * cb, c * (ca - cb * cg) / sg
    cz = F.sqrt(F.greatest(c * c - cx * cx - cy * cy, F.lit(0.0)))
    zero = F.lit(0.0)
    return F.array(a, zero, zero, b * cg, b * sg, zero, cx, cy, cz)


def usable_length(x: Column) -> Column:
    """Box length, or NULL when it is missing, not finite or not positive."""
    ok = x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))
    return F.when(ok, x)


def usable_box(*boxes: Column) -> Column:
    """First box (array of >= 3 lengths) whose three lengths are all usable."""

    def clean(box):
        first = F.slice(box, 1, 3)
        ok = (F.size(box) >= 3) & F.forall(
            first, lambda v: v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf")))
        return F.when(ok, first)

    return F.coalesce(*[clean(b) for b in boxes],
                      F.raise_error(F.lit("no usable box")).cast("array<double>"))


# -- binning ---------------------------------------------------------------

def histogram_bin(v: str | Column, lo: float, hi: float, n_bins: int) -> Column:
    """Equal-width bin of [lo, hi]; the last bin is closed; NULL when outside."""
    v = col(v)
    step = (hi - lo) / n_bins
    raw = F.least(F.floor((v - lo) / (hi - lo) * n_bins), F.lit(n_bins - 1)).cast("int")
    fixed = (
        F.when(v < F.lit(lo) + raw * F.lit(step), raw - 1)
        .when((v >= F.lit(lo) + (raw + 1) * F.lit(step)) & (raw != n_bins - 1), raw + 1)
        .otherwise(raw)
    )
    return F.when((v >= lo) & (v <= hi), fixed)


# -- curve arrays ----------------------------------------------------------

def savgol_matrix(window: int, order: int = 3) -> np.ndarray:
    """Rows map a window of samples to the fitted value at each of its positions."""
    x = np.arange(window, dtype=float) - (window - 1) / 2
    basis = np.vander(x, order + 1, increasing=True)
    return basis @ np.linalg.pinv(basis)


def savgol_smooth(y: Column, n: int) -> Column:
    """Cubic local polynomial smoothing of an array of ``n`` values."""
    window = min(15, n if n % 2 else n - 1)
    half = window // 2
    rows = F.array(*[vec(r) for r in savgol_matrix(window)])

    def at(_, i):
        start = F.greatest(F.lit(0), F.least(i - half, F.lit(n - window)))
        terms = F.zip_with(F.slice(y, start + 1, window), F.get(rows, i - start),
                           lambda a, b: a * b)
        return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)

    return F.transform(y, at)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    x = np.arange(-radius, radius + 1, dtype=float)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    return w / w.sum()


def gaussian_smooth(y: Column, sigma: float = 3.0) -> Column:
    """Gaussian smoothing of an array with mirrored borders."""
    w = gaussian_weights(sigma)
    radius = len(w) // 2
    size = F.size(y)
    taps = F.array(*[F.struct(F.lit(k - radius).alias("k"), F.lit(float(v)).alias("w"))
                     for k, v in enumerate(w)])

    def at(_, i):
        def tap(acc, t):
            m = F.pmod(i + t["k"], size * 2)
            j = F.when(m >= size, size * 2 - 1 - m).otherwise(m)
            return acc + t["w"] * F.get(y, j)
        return F.aggregate(taps, F.lit(0.0), tap)

    return F.transform(y, at)


def peaks(y: Column) -> Column:
    """Interior local maxima of an array with their prominence.

    A flat top counts once, at its middle (rounded down).
    """
    size = F.size(y)

    def plateau_end(i):
        higher_or_lower = F.filter(F.sequence(i, size - 1), lambda j: F.get(y, j) != F.get(y, i))
        return F.coalesce(F.try_element_at(higher_or_lower, F.lit(1)), size)

    starts = F.filter(
        F.sequence(F.lit(1), F.greatest(size - 2, F.lit(1))),
        lambda i: (i < size - 1) & (F.get(y, i - 1) < F.get(y, i))
        & (plateau_end(i) < size) & (F.get(y, plateau_end(i)) < F.get(y, i)),
    )
    mids = F.transform(starts, lambda i: ((i + plateau_end(i) - 1) / 2).cast("int"))

    def side_min(p, left):
        idx = F.sequence(F.lit(0), p) if left else F.sequence(p, size - 1)
        walls = F.filter(idx, lambda j: F.get(y, j) > F.get(y, p))
        if left:
            first = F.coalesce(F.array_max(walls) + 1, F.lit(0))
            return F.array_min(F.slice(y, first + 1, p - first + 1))
        last = F.coalesce(F.array_min(walls) - 1, size - 1)
        return F.array_min(F.slice(y, p + 1, last - p + 1))

    return F.transform(mids, lambda p: F.struct(
        p.alias("bin"), F.get(y, p).alias("height"),
        (F.get(y, p) - F.greatest(side_min(p, True), side_min(p, False))).alias("prominence"),
    ))


def array_median(y: Column) -> Column:
    """Median of an array without NULLs."""
    s, n = F.array_sort(y), F.size(y)
    hi = F.floor(n / 2).cast("int")
    lo = F.floor((n - 1) / 2).cast("int")
    return (F.get(s, lo) + F.get(s, hi)) / 2.0


# -- text ------------------------------------------------------------------

def duration_text(seconds: str | Column) -> Column:
    """Whole seconds as '1h 2m 3s', leading zero units left out."""
    s = F.floor(col(seconds)).cast("long")
    h, m, r = F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60))
    return (
        F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r))
        .when(m > 0, F.format_string("%dm %ds", m, r))
        .otherwise(F.format_string("%ds", r))
    )


def fixed4(x: Column) -> Column:
    """Four decimals; values that round to zero lose their sign."""
    return F.format_string("%.4f", F.when(F.abs(x) < 5e-5, F.lit(0.0)).otherwise(x))


def general(x: Column, digits: int) -> Column:
    """Shortest text with at most ``digits`` significant digits."""
    def of_parts(v: Column, parts: Column) -> Column:
        mantissa = F.when(F.instr(parts[0], ".") > 0, F.regexp_replace(parts[0], r"\.?0+$", "")).otherwise(parts[0])
        exponent = parts[1].cast("int")
        pieces = F.lit(None).cast("string")
        for e in range(-4, digits):
            decimals = max(digits - 1 - e, 0)
            shown = F.format_string(f"%.{decimals}f", v)
            if decimals:
                shown = F.regexp_replace(shown, r"\.?0+$", "")
            pieces = F.when(exponent == e, shown).otherwise(pieces)
        sci = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"),
                       F.lpad(F.abs(exponent).cast("string"), 2, "0"))
        return F.when(v == 0, F.lit("0")).when((exponent < -4) | (exponent >= digits), sci).otherwise(pieces)

    # Values bound by a lambda are found once; each use would format the number again.
    parts = lambda v: F.array(F.split(F.format_string(f"%.{digits - 1}e", v), "e"))
    return F.get(F.transform(F.array(x), lambda v: F.get(F.transform(
        parts(v), lambda p: of_parts(v, p)), F.lit(0))), F.lit(0))


def pad_id(x: str | Column, width: int = 3) -> Column:
    """Zero-padded numeric system id."""
    c = col(x).cast("string")
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)
