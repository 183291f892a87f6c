"""Functions of mention series, oldest first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from undertow.config import D
from undertow.functions.text import let


def ewma(series: Column, alpha: float = D.alpha) -> Column:
    """Exponentially weighted means; the first value starts them.

    A step is an affine map, and maps compose whatever the brackets, so the means are a prefix scan: each pass adds what is
    1, 2, 4, ... places before, weighted by (1 - alpha) to that power. Passes end where that weight is below a double's
    precision, so a series of n values costs n times their number, however long it is.
    """
    keep = 1 - alpha
    steps = [1]
    while keep ** steps[-1] > 1e-18 and steps[-1] < 1 << 30:
        steps.append(2 * steps[-1])
    start = F.transform(series, lambda x, i: F.when(i == 0, x.cast("double")).otherwise(alpha * x))
    before = lambda acc, i, step: F.when(i >= step["at"], step["weight"] * F.get(acc, i - step["at"])).otherwise(0.0)
    passes = F.array(*[F.struct(F.lit(s).alias("at"), F.lit(keep**s).alias("weight")) for s in steps])
    return F.aggregate(passes, start, lambda acc, step: F.transform(acc, lambda x, i: x + before(acc, i, step)))


def acceleration(series: Column) -> Column:
    """Second differences; none for fewer than three values."""

    def of(s: Column) -> Column:
        n = F.size(s) - 2
        ends = F.zip_with(F.slice(s, 3, n), F.slice(s, 1, n), lambda x, z: x + z)
        return F.when(n > 0, F.zip_with(ends, F.slice(s, 2, n), lambda e, y: e - 2 * y)).otherwise(F.array().cast("array<double>"))

    return let(series, of)


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)


def z_of_last(accel: Column) -> Column:
    """The last value against mean and population deviation of those before; bounded where those are flat."""

    def of(a: Column) -> Column:
        base, last = F.slice(a, 1, F.size(a) - 1), F.element_at(a, -1)
        squares = lambda centre: F.aggregate(base, F.lit(0.0), lambda acc, x: acc + (x - centre) * (x - centre)) / F.size(base)
        flat = F.when(F.abs(last) < D.eps, 0.0).otherwise(D.flat_z)
        scaled = lambda centre: let(F.sqrt(squares(centre)), lambda d: F.when(d < D.eps, flat).otherwise((last - centre) / d))
        return let(mean(base), scaled)

    return let(accel, of)


def gap_score(z: Column, presence: Column, weight: Column, inauthenticity: Column) -> Column:
    return F.greatest(F.lit(0.0), z) * (1 - presence) * weight * (1 - inauthenticity)


def corroboration_weight(state: Column) -> Column:
    return F.when(state == "primary_backed", 1.0).when(state == "corroborated", 0.7).otherwise(0.0)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def inauthenticity(social: Column, origins: Column, copies: Column, synced: Column, low_rep: Column) -> Column:
    parts = (clamp(1 - origins / social), clamp(copies / social), clamp(synced / social), clamp(low_rep / social))
    total = sum((w * p for w, p in zip(D.weights, parts, strict=True)), F.lit(0.0))
    return F.when(social < D.min_social, 0.0).otherwise(clamp(total))


def bin_start(ts: Column, seconds: int) -> Column:
    """Seconds since the epoch, cut to a multiple of seconds."""
    return F.floor(ts / seconds) * seconds
