"""Comparisons and guarded arithmetic used by indicators, rules and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two prices or indicators closer than this count as equal.  A cluster adds
# floats in no fixed order, so the last bits of a mean differ between runs;
# without a tolerance a flat market would give random crosses.
EPS = 1e-9
# A deviation below this share of the mean size is what rounding leaves of equal values.
FLAT = 1e-12


def above(a: Column, b: Column | float) -> Column:
    return a - b > EPS


def below(a: Column, b: Column | float) -> Column:
    return a - b < -EPS


def at_least(a: Column, b: Column | float) -> Column:
    return a - b > -EPS


def at_most(a: Column, b: Column | float) -> Column:
    return a - b < EPS


def side(difference: Column) -> Column:
    """+1, -1 or 0 (equal within the tolerance); NULL stays NULL."""
    return (
        F.when(difference > EPS, 1).when(difference < -EPS, -1).when(difference.isNotNull(), 0)
    )


def safe_divide(a: Column, b: Column, zero: Column | float | None = None) -> Column:
    """``a / b``, or ``zero`` where ``b`` is 0; NULL inputs stay NULL."""
    fallback = zero if isinstance(zero, Column) else F.lit(zero).cast("double")
    return F.when(b == 0, fallback).otherwise(F.try_divide(a, b))


def real_deviation(deviation: Column, size: Column) -> Column:
    """``deviation``, or NULL where the values are all equal but for rounding (``size``: their mean absolute value)."""
    return F.when(deviation > FLAT * size, deviation)


def if_else(condition: Column, a: Column, b: Column) -> Column:
    """``a`` where the condition holds, else ``b``; an unknown condition gives NULL."""
    return F.when(condition, a).when(~condition, b)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def apart(whole: str) -> Column:
    """``whole`` as it is, by a function for which Spark makes no code.

    A projection that holds one is evaluated on its own, in short methods.
    In one generated method with the operators around it, all rules are too
    long for the JVM to compile, and every row is interpreted.
    """
    return F.get(F.transform(F.array(whole), lambda value: value), F.lit(0)).alias(whole)
