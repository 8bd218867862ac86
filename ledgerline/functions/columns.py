"""Column expressions that Spark lacks, and the windows that panels share."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

# Coefficients of Hart's rational approximation to the normal distribution, highest power first.
HART_P = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_Q = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# Wichura's AS 241 (PPND16), lowest power first, for the centre, the middle and the tail.
WICHURA = (
    (
        (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
        (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
    ),
    (
        (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
        (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
    ),
    (
        (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
    ),
)
ANNUAL = 252
EULER_GAMMA = 0.5772156649015329


def horner(x: Column, highest_first) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), highest_first[1:], F.lit(highest_first[0]))


def normal_cdf(x: Column) -> Column:
    """P(Z <= x) of a standard normal, to about 1e-15."""
    a = F.abs(x)
    near = horner(a, HART_P) / horner(a, HART_Q)
    far = F.lit(1.0) / (a + F.lit(1.0) / (a + F.lit(2.0) / (a + F.lit(3.0) / (a + F.lit(4.0) / (a + F.lit(0.65)))))) / math.sqrt(2 * math.pi)
    tail = F.when(a > 37, F.lit(0.0)).otherwise(F.exp(-a * a / 2) * F.when(a < 7.07106781186547, near).otherwise(far))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_quantile(p: Column) -> Column:
    """The inverse of :func:`normal_cdf`; null outside (0, 1)."""
    ratio = lambda x, k: horner(x, WICHURA[k][0][::-1]) / horner(x, WICHURA[k][1][::-1])
    q = p - F.lit(0.5)
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.when(r <= 5, ratio(r - F.lit(1.6), 1)).otherwise(ratio(r - F.lit(5.0), 2))
    value = F.when(F.abs(q) <= 0.425, q * ratio(F.lit(0.180625) - q * q, 0)).otherwise(F.signum(q) * tail)
    return F.when((p > 0) & (p < 1), value)


def trailing(rows: int, *by: str, order: str = "date") -> WindowSpec:
    """The last ``rows`` rows of each series, this one included."""
    return Window.partitionBy(*by).orderBy(order).rowsBetween(-(rows - 1), 0)


def so_far(*by: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, over: Column, window: WindowSpec, rows: int) -> Column:
    """``value`` where the window holds ``rows`` non-null ``over``, else null."""
    return F.when(F.count(over).over(window) == rows, value)


def in_order(*by: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def slug(x: Column, most: int = 60) -> Column:
    """Lower case, other characters than letters and digits as single underscores."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, most)


def normal_text(x: Column) -> Column:
    """Trimmed, lower-case, runs of white space as one space."""
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def messages(*pairs: tuple[Column, str | Column]) -> Column:
    """The messages whose conditions hold, in order; conditions that are null do not hold."""
    return F.array_compact(F.array(*[F.when(c, m if isinstance(m, Column) else F.lit(m)) for c, m in pairs]))


def fingerprint(*fields: str) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of the named columns as JSON, in name order."""
    return F.substring(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(fields)])), 256), 1, 16)
