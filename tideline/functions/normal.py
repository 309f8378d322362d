"""The standard normal distribution function as a column expression."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of Hart (1968) as given by West (2005), highest power first.
NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
SPLIT = 7.07106781186547


def _poly(coef, z):
    return reduce(lambda acc, c: acc * z + c, coef[1:], coef[0])


def norm_cdf(x: Column) -> Column:
    z = F.abs(x)
    e = F.exp(-z * z / 2.0)
    near = e * _poly(tuple(F.lit(c) for c in NUMERATOR), z) / _poly(
        tuple(F.lit(c) for c in DENOMINATOR), z
    )
    tail = z + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = z + F.lit(k) / tail
    far = e / tail / math.sqrt(2.0 * math.pi)
    upper = F.when(z < SPLIT, near).otherwise(far)
    return F.when(x > 0, 1.0 - upper).otherwise(upper)


def norm_cdf_sql(x: str) -> str:
    """The same function as SQL text, for the result check."""
    num = reduce(lambda acc, c: f"({acc})*abs({x})+{c!r}", NUMERATOR[1:], repr(NUMERATOR[0]))
    den = reduce(lambda acc, c: f"({acc})*abs({x})+{c!r}", DENOMINATOR[1:], repr(DENOMINATOR[0]))
    up = f"(exp(-({x})*({x})/2.0)*({num})/({den}))"
    return f"(CASE WHEN ({x}) > 0 THEN 1.0-{up} ELSE {up} END)"
