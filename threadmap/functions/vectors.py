"""Vectors as array<double> columns: higher-order functions that Catalyst runs in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def vector(column: Column | str) -> Column:
    """The column as array<double>; float arrays are widened first, so sums are in doubles."""
    return (F.col(column) if isinstance(column, str) else column).cast("array<double>")


def total(array: Column) -> Column:
    """The sum of an array, from the left."""
    return F.aggregate(array, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def sqdist(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sqdist(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda v: v * v)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p - q)


def plus_scaled(a: Column, t: Column, b: Column) -> Column:
    """a + t * b."""
    return F.zip_with(a, b, lambda p, q: p + t * q)


def unit(a: Column) -> Column:
    """a over its norm; the zero vector where the norm is next to zero."""
    n = norm(a)
    return F.transform(a, lambda v: F.when(n <= TINY, F.lit(0.0)).otherwise(v / n))


def tangent_inconsistency(a: Column, b: Column) -> Column:
    """1 - |cos|, and 0 where either vector is zero."""
    u, v = unit(a), unit(b)
    return F.when((norm(a) <= TINY) | (norm(b) <= TINY), F.lit(0.0)).otherwise(1 - F.abs(dot(u, v)))


def departure_angle(a: Column, b: Column) -> Column:
    """1 - cos, clipped, and infinity where either vector is zero."""
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(unit(a), unit(b))))
    return F.when((norm(a) <= TINY) | (norm(b) <= TINY), F.lit(float("inf"))).otherwise(1 - cosine)


def rounded(array: Column, digits: int = 6) -> Column:
    return F.transform(array, lambda v: F.round(v, digits))


def one_hot(value: Column, size: Column) -> Column:
    """size zeros, with a one in the place of value, from 0."""
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: (i == value).cast("double"))


def octilinear_bin(dx: Column, dy: Column) -> Column:
    """The eighth of the circle, from 0, whose middle is nearest to the direction."""
    return F.pmod(F.floor(F.degrees(F.atan2(dy, dx)) / 45 + 0.5), F.lit(8)).cast("int")
