"""Numeric array functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def energy(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))


def rms(x: Column) -> Column:
    """Root mean square; an empty array gives 0."""
    return F.when(F.size(x) == 0, 0.0).otherwise(F.sqrt(F.try_divide(energy(x), F.size(x))))


def norm(x: Column) -> Column:
    return F.sqrt(energy(x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is below 1e-9."""
    na, nb = norm(a), norm(b)
    return F.when((na < 1e-9) | (nb < 1e-9), 0.0).otherwise(F.try_divide(dot(a, b), na * nb))


def unit(x: Column) -> Column:
    n = norm(x)
    return F.when(n < 1e-9, F.transform(x, lambda v: v.cast("double"))).otherwise(F.transform(x, lambda v: F.try_divide(v.cast("double"), n)))


def scaled(x: Column, factor: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double") * factor)


def peak_normalised(x: Column, target_db: float = -1.0) -> Column:
    peak = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))
    return F.when(peak > 1e-9, scaled(x, F.try_divide(F.lit(10 ** (target_db / 20)), peak))).otherwise(scaled(x, F.lit(1.0)))


def rms_normalised(x: Column, target_db: float = -20.0) -> Column:
    level = rms(x)
    return F.when(level > 1e-9, scaled(x, F.try_divide(F.lit(10 ** (target_db / 20)), level))).otherwise(scaled(x, F.lit(1.0)))


def mono(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a.cast("double") + b.cast("double")) / 2)


def crossfaded(a: Column, b: Column, n: int) -> Column:
    """The last ``n`` of ``a`` fade linearly into the first ``n`` of ``b``."""
    tail, head = F.slice(a, F.size(a) - n + 1, n), F.slice(b, 1, n)
    blend = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(tail, i) * (1 - i / max(n - 1, 1)) + F.get(head, i) * (i / max(n - 1, 1)))
    return F.concat(F.slice(a, 1, F.size(a) - n), blend, F.slice(b, n + 1, F.size(b)))


def stretched(x: Column, n: int) -> Column:
    """Linear interpolation onto ``n`` points."""
    step = (F.size(x) - 1) / F.lit(max(n - 1, 1))

    def at(i: Column) -> Column:
        low = F.least(F.floor(i * step).cast("int"), F.size(x) - 1)
        high = F.least(low + 1, F.size(x) - 1)
        return F.get(x, low) + (F.get(x, high) - F.get(x, low)) * (i * step - low)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def padded(x: Column, n: int) -> Column:
    """Cut or filled with zeros to ``n``."""
    return F.slice(F.concat(F.transform(x, lambda v: v.cast("double")), F.array_repeat(F.lit(0.0), n)), 1, n)


def snr(x: Column) -> Column:
    """dB between the means of the loudest and the quietest fifth; under 4 values 0, a silent floor 60."""
    loud = F.array_sort(F.transform(x, lambda v: F.abs(v.cast("double"))))
    k = F.floor(F.size(x) / 5).cast("int")
    k = F.greatest(k, F.lit(1))
    low, high = F.try_divide(total(F.slice(loud, 1, k)), k), F.try_divide(total(F.slice(loud, F.size(x) - k + 1, k)), k)
    return F.when(F.size(x) < 4, 0.0).when(low < 1e-9, 60.0).otherwise(20 * F.log10(F.greatest(F.try_divide(high, low), F.lit(1e-12))))


def ending_score(x: Column, tail: int) -> Column:
    """1 where the end is no louder than the rest; falls to 0 as the ratio of levels goes from 0.7 to 1.7."""
    whole = rms(x)
    ratio = F.try_divide(rms(F.slice(x, -tail, tail)), whole)
    return F.when((F.size(x) >= tail) & (whole > 1e-9), 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio - 0.7)))
