"""Significance, arg-max and quantile expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def significant(most: Column, total: Column, z: float) -> Column:
    """Whether `most` of `total` fair coin tosses is over the normal quantile z; False for no tosses."""
    return F.coalesce((2 * most - total) > F.lit(float(z)) * F.sqrt(total.cast("double")), F.lit(False)) & (total > 0)


def normal_cdf(x: Column, p: float, n: Column) -> Column:
    """The normal approximation of P(Binomial(n, p) <= x), by a series for erf good to 1.2e-7."""
    sd = F.sqrt(n * (p * (1 - p)))
    t_in = (x - n * p) / (sd * F.sqrt(F.lit(2.0)))
    t = 1 / (1 + 0.5 * F.abs(t_in))
    # Coefficients of a published rational approximation of erfc.
    terms = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        poly = poly * t + c
    tail = t * F.exp(-t_in * t_in + poly)
    erf = F.when(t_in >= 0, 1 - tail).otherwise(tail - 1)
    return F.lit(0.5) * (1 + erf)


def max_and_index(counts: list[Column]) -> tuple[Column, Column]:
    """The largest of the counts and the place of its first occurrence."""
    most = F.greatest(*counts)
    place = F.when(counts[0] == most, F.lit(0))
    for i, c in enumerate(counts[1:], 1):
        place = place.when(c == most, F.lit(i))
    return most, place


def second_largest(counts: list[Column]) -> Column:
    """The largest count that differs from the maximum, 0 if all are equal."""
    most = F.greatest(*counts)
    return F.greatest(F.lit(0), *[F.when(c != most, c) for c in counts])


def swapped_quantile(ordered: Column, q: float) -> Column:
    """The q-th quantile of a sorted array, where the neighbour before gets the fractional part as its
    weight and the one after the rest (so the two weights are swapped against linear interpolation)."""
    place = (F.size(ordered) - 1) * F.lit(float(q))
    before, after = F.floor(place).cast("int"), F.ceil(place).cast("int")
    weight = place - before
    return weight * F.element_at(ordered, before + 1) + (1 - weight) * F.element_at(ordered, after + 1)


def grouped_quantile(rows: DataFrame, by: list[str], value: str, q: float, name: str = "q") -> DataFrame:
    """(by..., name): the swapped_quantile of the values of each group that are not null; groups of nulls alone are left out.

    Values are counted before they meet, so a group is a window over its different values, never a list of its rows.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*by)
    up_to = F.sum("__n").over(group.orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = counts.withColumns({"__up": up_to, "__place": (F.sum("__n").over(group) - 1) * F.lit(float(q))})
    at = lambda place: F.min(F.when(F.col("__up") > place, F.col("__v")))
    found = counted.groupBy(*by).agg(at(F.floor("__place")).alias("__a"), at(F.ceil("__place")).alias("__b"), F.max("__place").alias("__place"))
    weight = F.col("__place") - F.floor("__place")
    return found.select(*by, (weight * F.col("__a") + (1 - weight) * F.col("__b")).alias(name))
