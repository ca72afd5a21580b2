"""Numbers: guarded division, half-even rounding, p-value of a slope."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


from loreline.functions.text import let

TWO_OVER_PI = 2.0 / math.pi


def safe_ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """A / b, `default` when b is zero."""
    ratio = F.try_divide(a, b)
    return ratio if default is None else F.coalesce(ratio, F.lit(default))


def round_metric(c: Column, digits: int = 4) -> Column:
    """Half-even rounding; never a negative zero."""
    return F.bround(c, digits) + F.lit(0.0)


def slope_p_value(n: Column, sxx: Column, sxy: Column, syy: Column) -> Column:
    """Two-sided p of a least-squares slope, from its sums of squares.

    With nu = n - 2 and r2 = sxy^2 / (sxx * syy), the angle of the t statistic has
    sine sqrt(r2) and cosine sqrt(1 - r2), and the central probability of
    Student's t is a finite sum of powers of the cosine (Abramowitz and Stegun
    26.7.3 for odd nu, 26.7.4 for even nu). Null for a constant series.
    """
    r2 = F.try_divide(sxy * sxy, sxx * syy)
    inputs = F.struct((n - 2).cast("int").alias("nu"), r2.alias("r2"))
    return let(inputs, lambda v: F.when(v["r2"].isNotNull(), _two_sided(v["nu"], v["r2"])))


def _two_sided(nu: Column, r2: Column) -> Column:
    def central(v: Column) -> Column:
        odd, sin, cos2 = nu % 2 == 1, v["sin"], v["cos2"]
        half = F.when(odd, 1).otherwise(0)
        terms = F.floor((nu - 2 - half) / 2).cast("int")
        first = F.when(odd, F.sqrt(cos2)).otherwise(F.lit(1.0))
        start = F.struct(first.alias("total"), first.alias("term"))

        def step(acc: Column, j: Column) -> Column:
            up = (2 * j - 1 + half).cast("double")
            return let(
                acc["term"] * cos2 * up / (up + 1),
                lambda t: F.struct((acc["total"] + t).alias("total"), t.alias("term")),
            )

        steps = F.when(terms > 0, F.sequence(F.lit(1), F.greatest(terms, F.lit(1)))).otherwise(
            F.array().cast("array<int>")
        )
        total = sin * F.aggregate(steps, start, step)["total"]
        return (
            F.when(nu == 1, F.asin(sin) * TWO_OVER_PI)
            .when(odd, (F.asin(sin) + total) * TWO_OVER_PI)
            .otherwise(total)
        )

    angle = F.struct(F.sqrt(r2).alias("sin"), (F.lit(1.0) - r2).alias("cos2"))
    p = F.greatest(F.lit(1.0) - let(angle, central), F.lit(0.0))
    return F.when(nu >= 1, F.when(r2 >= 1.0, F.lit(0.0)).otherwise(p))
