"""Column expressions for phases, complex numbers and circular statistics.

Missing values are NULL, never NaN; a complex number is two columns, and 0+0i
counts as missing where an operator says so.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * pi


def valid(v: Column) -> Column:
    """NaN and infinities become NULL."""
    d = v.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def wrap(v: Column) -> Column:
    """Into [-pi, pi) by flooring."""
    return v - TWO_PI * F.floor((v + pi) / TWO_PI)


def power(re: Column, im: Column) -> Column:
    return re * re + im * im


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def angle(re: Column, im: Column) -> Column:
    """Phase, NULL for 0+0i."""
    return F.when((re != 0) | (im != 0), F.atan2(im, re))


def direction(re: Column, im: Column) -> Column:
    """Phase as the C library's ``atan2`` has it: zeros keep their sign, which Spark's drops."""
    minus = lambda v: v.cast("string") == "-0.0"
    return F.when((im == 0) & ((re < 0) | minus(re)), F.when(minus(im), -pi).otherwise(pi)).otherwise(F.atan2(im, re))


def iexp(v: Column, sign: int = -1) -> tuple[Column, Column]:
    """exp(sign i v) as (re, im)."""
    return F.cos(v), F.sin(v) * sign


def times_conj(ar: Column, ai: Column, br: Column, bi: Column) -> tuple[Column, Column]:
    """a * conj(b)."""
    return ar * br + ai * bi, ai * br - ar * bi


def times(ar: Column, ai: Column, br: Column, bi: Column) -> tuple[Column, Column]:
    return ar * br - ai * bi, ar * bi + ai * br


def resultant(v: Column) -> Column:
    """Aggregate: length R of the mean phasor."""
    return F.sqrt(F.pow(F.avg(F.cos(v)), 2) + F.pow(F.avg(F.sin(v)), 2))


def circular_mean(v: Column) -> Column:
    """Aggregate: direction of the mean phasor; NULL where R < 1e-10."""
    return F.when(resultant(v) >= 1e-10, F.atan2(F.avg(F.sin(v)), F.avg(F.cos(v))))


def circular_std(v: Column) -> Column:
    """Aggregate: sqrt(-2 ln R), R held within [1e-16, 1]."""
    return F.sqrt(-2 * F.ln(F.least(F.greatest(resultant(v), F.lit(1e-16)), F.lit(1.0))))


def circular_var(v: Column) -> Column:
    return 1 - resultant(v)


def rounded(v: Column, digits: int = 6) -> Column:
    """For results: rounded half away from zero as scaled doubles, as the SQL engine does, without a negative zero."""
    scale = 10.0**digits
    return F.round(v * scale, 0) / scale + 0.0
