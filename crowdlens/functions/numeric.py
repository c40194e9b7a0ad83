"""Numeric column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published coefficients of Wichura's AS241 (PPND16) approximation of the normal quantile,
# as (numerator, denominator), highest power first.
AS241_CENTRE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4,
     1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4,
     5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
AS241_NEAR_TAIL = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0,
     3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
     6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0),
)
AS241_FAR_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
     2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
     1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)


def clip(value: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; null stays null (`greatest` alone would turn it into `low`)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def finite_or_zero(value: Column) -> Column:
    """Null, NaN and both infinities become 0."""
    number = value.cast("double")
    broken = number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(broken, F.lit(0.0)).otherwise(number)


def logistic(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def _ratio(coefficients, x: Column) -> Column:
    def horner(terms):
        total = F.lit(terms[0])
        for term in terms[1:]:
            total = total * x + F.lit(term)
        return total

    numerator, denominator = coefficients
    return horner(numerator) / horner(denominator)


def norm_ppf(p: Column) -> Column:
    """Standard normal quantile for p strictly between 0 and 1, else null."""
    centred = p - F.lit(0.5)
    tail = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    distance = F.when(tail <= 5.0, _ratio(AS241_NEAR_TAIL, tail - F.lit(1.6))).otherwise(
        _ratio(AS241_FAR_TAIL, tail - F.lit(5.0))
    )
    return F.when(
        (p > 0.0) & (p < 1.0),
        F.when(
            F.abs(centred) <= 0.425,
            centred * _ratio(AS241_CENTRE, F.lit(0.180625) - centred * centred),
        ).otherwise(F.signum(centred) * distance),
    )


def _fraction(x: Column, a: Column, b: Column, steps: int = 300) -> Column:
    """Continued fraction of the incomplete beta function (modified Lentz): converges fast for x below (a + 1) / (a + b + 2)."""
    tiny = F.lit(1e-300)

    def safe(value: Column) -> Column:
        return F.when(F.abs(value) < tiny, tiny).otherwise(value)

    def half(state: Column, factor: Column) -> Column:
        d = F.lit(1.0) / safe(F.lit(1.0) + factor * state["d"])
        c = safe(F.lit(1.0) + factor / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))

    def step(state: Column, m: Column) -> Column:
        even = half(state, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
        return half(even, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
    first = F.lit(1.0) / safe(F.lit(1.0) - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda state: state["h"])


def _log_beta_half(freedom: Column) -> Column:
    """ln B(freedom / 2, 1 / 2) for whole degrees of freedom, from B(1/2, 1/2) = pi, B(1, 1/2) = 2 and B(a + 1, 1/2) = B(a, 1/2) a / (a + 1/2)."""
    odd = F.pmod(freedom, F.lit(2)) == 1
    base = F.when(odd, F.log(F.lit(math.pi))).otherwise(F.log(F.lit(2.0)))
    first = F.when(odd, F.lit(0.5)).otherwise(F.lit(1.0))
    times = F.ceil(freedom / 2.0).cast("int") - 1
    terms = F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(terms, base, lambda total, k: total + F.log((first + k) / (first + k + 0.5)))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation `r` of `n` pairs under none: Student's t with n - 2 degrees of freedom, by the regularised
    incomplete beta function. Null for fewer than three pairs."""
    freedom = n.cast("long") - 2
    a, b = freedom / 2.0, F.lit(0.5)
    x = F.greatest(F.lit(0.0), F.lit(1.0) - r * r)  # = freedom / (freedom + t * t)
    front = F.exp(a * F.log(x) + b * F.log(F.lit(1.0) - x) - _log_beta_half(freedom))
    near = front * _fraction(x, a, b) / a
    far = F.lit(1.0) - front * _fraction(F.lit(1.0) - x, b, a) / b
    value = F.when(x <= 0.0, F.lit(0.0)).when(x >= 1.0, F.lit(1.0)).when(x < (a + 1) / (a + b + 2), near).otherwise(far)
    return F.when((freedom > 0) & r.isNotNull() & ~F.isnan(r), value)
