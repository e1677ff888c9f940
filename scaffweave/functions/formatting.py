"""Numbers as short strings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _shortest(digits: int):
    @F.pandas_udf("string")
    def shortest(x: pd.Series) -> pd.Series:
        return x.map(lambda v: f"{v:.{digits}g}", na_action="ignore")

    return shortest


def significant_digits(x: Column, digits: int) -> Column:
    """The shorter of plain and exponent form with at most so many digits, rounded by the number's exact value.

    Java's formats round by other rules and keep zeros at the end, so this is done in an Arrow function."""
    return _shortest(digits)(x.cast("double"))


def _scaled(n: Column, digits: int, steps: list[tuple[float | None, float, str]]) -> Column:
    """The unit of the first step that n is below; null for null."""
    x = n.cast("double")
    value, unit = F.lit(None).cast("double"), F.lit(None).cast("string")
    for below, by, name in reversed(steps):
        fits = F.lit(True) if below is None else x < below
        value, unit = F.when(fits, x / by).otherwise(value), F.when(fits, F.lit(name)).otherwise(unit)
    return F.concat(significant_digits(value, digits), unit)


def to_si(n: Column) -> Column:
    """Three digits, a space, and k, M, G or T by powers of a thousand: '123 k', and '999 ' without a unit."""
    return _scaled(n, 3, [(1e3, 1, " "), (1e6, 1e3, " k"), (1e9, 1e6, " M"), (1e12, 1e9, " G"), (None, 1e12, " T")])


def to_eng(n: Column) -> Column:
    """Four digits and an exponent of 6, 9 or 12 from ten millions on. Whole numbers below that are kept in full."""
    x = n.cast("double")
    whole = F.when((x < 1e7) & (x == F.floor(x)), F.floor(x).cast("string"))
    return F.coalesce(whole, _scaled(n, 4, [(1e7, 1, ""), (1e9, 1e6, "e6"), (1e12, 1e9, "e9"), (None, 1e12, "e12")]))


def strictly_starts_with(text: Column, start: str) -> Column:
    """Starts with it and goes on."""
    return text.startswith(start) & (F.length(text) > len(start))


def strictly_ends_with(text: Column, end: str) -> Column:
    return text.endswith(end) & (F.length(text) > len(end))
