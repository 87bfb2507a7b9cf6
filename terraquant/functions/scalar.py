"""Scalar functions of spatial quantile regression, as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Floors of densities and scales, and the factor that makes a MAD a standard deviation.
DENSITY_FLOOR = 1e-12
SCALE_FLOOR = 1e-8
MAD_FACTOR = 1.4826

# Rational approximations of erf and erfc in three ranges (Cody, 1969).
ERF_P = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
ERF_Q = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
ERFC_P = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
ERFC_Q = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
TAIL_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
TAIL_Q = (2.56852019228982242e00, 1.87295284992346047e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
NEAR, MIDDLE = 0.46875, 4.0


def rational(y, p, q):
    """Numerator (whose last coefficient leads) over denominator (whose leading coefficient is 1), both by Horner's rule."""
    num = y * p[-1]
    den = y
    for a, b in zip(p[:-2], q[:-1]):
        num = (num + a) * y
        den = (den + b) * y
    return (num + p[-2]) / (den + q[-1])


def erfc(x: Column) -> Column:
    y = F.abs(x)
    near = 1 - x * rational(x * x, ERF_P, ERF_Q)
    tail = 1 / F.greatest(y * y, F.lit(1e-300))
    far = F.exp(-y * y) / F.greatest(y, F.lit(1e-300)) * (1 / math.sqrt(math.pi) - tail * rational(tail, TAIL_P, TAIL_Q))
    upper = F.when(y <= MIDDLE, F.exp(-y * y) * rational(y, ERFC_P, ERFC_Q)).otherwise(far)
    return F.when(y <= NEAR, near).otherwise(F.when(x < 0, 2 - upper).otherwise(upper))


def normal_cdf(x: Column) -> Column:
    return 0.5 * erfc(-x / math.sqrt(2))


def normal_pdf(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def check_loss(u: Column, tau: float) -> Column:
    """u * (tau - 1[u < 0])."""
    return u * (F.lit(tau) - F.when(u < 0, 1.0).otherwise(0.0))


def smooth_loss(u: Column, tau: float, h: float) -> Column:
    """Check loss smoothed by a Gaussian kernel of bandwidth h."""
    return u * smooth_score(u, tau, h) + h * normal_pdf(u / h)


def smooth_score(u: Column, tau: float, h: float) -> Column:
    return tau - 1 + normal_cdf(u / h)


def smooth_curvature(u: Column, h: float) -> Column:
    return normal_pdf(u / h) / h


def smooth_bandwidth(n: float, scale: float = 1.0) -> float:
    m = max(n, 3)
    return scale * (math.log(m) / m) ** 0.2


def ald_density(u: Column, sigma: Column | float, tau: float) -> Column:
    """Asymmetric Laplace density; the scale has a floor."""
    s = F.greatest(sigma if isinstance(sigma, Column) else F.lit(float(sigma)), F.lit(SCALE_FLOOR))
    return tau * (1 - tau) / s * F.exp(-check_loss(u, tau) / s)


def ald_draw(u: Column, tau: float, sigma: float) -> Column:
    """Asymmetric Laplace variate of a uniform u."""
    low = F.lit(sigma / (1 - tau)) * F.log(u / tau)
    return F.when(u < tau, low).otherwise(F.lit(-sigma / tau) * F.log((1 - u) / (1 - tau)))


def floored(density: Column) -> Column:
    return F.greatest(density, F.lit(DENSITY_FLOOR))


def softmax(scores: list[Column]) -> list[Column]:
    """Class probabilities of linear scores, the first class having score 0; shifted by the largest score."""
    every = [F.lit(0.0), *scores]
    top = F.greatest(*every) if len(every) > 1 else every[0]
    parts = [F.exp(s - top) for s in every]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return [p / total for p in parts]


def matern(h: Column, reach: float, nu: float) -> Column:
    """Matern correlation at distance h for smoothness 0.5 or 1.5."""
    if reach <= 0:
        raise ValueError("range must be positive")
    if nu == 0.5:
        return F.exp(-h / reach)
    if nu == 1.5:
        s = math.sqrt(3) * h / reach
        return (1 + s) * F.exp(-s)
    raise ValueError("nu must be 0.5 or 1.5")


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def dot(columns: list[Column], weights: list[float]) -> Column:
    """Unrolled inner product, which stays inside generated code."""
    out = F.lit(0.0)
    for c, w in zip(columns, weights):
        out = out + c * F.lit(float(w))
    return out


def entropy(probs: list[Column]) -> Column:
    """Entropy of class probabilities relative to its maximum; one class has none."""
    if len(probs) < 2:
        return F.lit(0.0)
    out = F.lit(0.0)
    for p in probs:
        out = out - F.when(p > 0, p * F.log(p)).otherwise(0.0)
    return out / math.log(len(probs))


def first_max(probs: list[Column]) -> Column:
    """1-based number of the first largest value."""
    arr = F.array(*probs)
    return F.array_position(arr, F.array_max(arr)).cast("int")


def normalized(values: list[Column]) -> list[Column]:
    """Values over their sum; where the sum is not positive they stay."""
    total = values[0]
    for v in values[1:]:
        total = total + v
    total = F.when(total <= 0, 1.0).otherwise(total)
    return [v / total for v in values]


def interval(estimate: Column, se: Column, z: float) -> tuple[Column, Column, Column]:
    """(lower, upper, credible): credible where the standard error is finite and the interval excludes 0."""
    lower, upper = estimate - z * se, estimate + z * se
    finite = se.isNotNull() & ~F.isnan(se) & (F.abs(se) < float("inf"))
    return lower, upper, F.coalesce(finite & ((lower > 0) | (upper < 0)), F.lit(False))


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def no_nan(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), c)


def interpolated(x: Column, grid, value) -> Column:
    """Linear interpolation of a function given on an even grid; 0 outside."""
    step = float(grid[1] - grid[0])
    known = F.lit([float(v) for v in value])
    at = (x - float(grid[0])) / step
    low = F.greatest(F.lit(0), F.least(F.floor(at), F.lit(len(grid) - 2))).cast("int")
    a, b = F.get(known, low), F.get(known, low + 1)
    inside = (at >= 0) & (at <= len(grid) - 1)
    return F.when(inside, a + (b - a) * (at - low)).when(x.isNotNull(), F.lit(0.0))


def uniform_draw(key: Column, seed: int, half: int = 0) -> Column:
    """A number in (0, 1) for each key: 52 bits of the checksum of seed and key, the same in any partitioning. Two halves are independent."""
    bits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1 + 13 * half, 13)
    return (F.conv(bits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def normal_draw(key: Column, seed: int) -> Column:
    """A standard normal number for each key."""
    return F.sqrt(-2 * F.log(uniform_draw(key, seed))) * F.cos(F.lit(2 * math.pi) * uniform_draw(key, seed, 1))


def mixture_mean(probs: list[Column], values: list[Column]) -> Column:
    """Values weighted by class probabilities."""
    out = F.lit(0.0)
    for p, v in zip(probs, values):
        out = out + p * v
    return out
