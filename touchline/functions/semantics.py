"""Null / NaN / division rules of the source tables, written as Spark Columns.

The pages compute with pandas, whose rules differ from SQL in a few places
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def pandas_div(n, d) -> Column:
    """n / d with pandas float semantics: 0/0 -> NULL (NaN), x/0 -> +-inf.

    Spark's ANSI ``/`` raises on a zero divisor; this never raises.
    """
    n, d = _c(n).cast("double"), _c(d).cast("double")
    inf = F.lit(float("inf"))
    return (F.when(d == 0,
                   F.when(n == 0, F.lit(None).cast("double"))
                   .when(n > 0, inf).otherwise(-inf))
            .otherwise(n / d))


def not_equal_keep_null(col, value) -> Column:
    """pandas ``col != value``: a NULL cell counts as "not equal" (kept)."""
    return ~_c(col).eqNullSafe(F.lit(value))


def is_member(col, values: Iterable) -> Column:
    """pandas ``isin``: never matches NULL; an empty list selects nothing."""
    values = list(values)
    if not values:
        return F.lit(False)
    return _c(col).isin(values) & _c(col).isNotNull()


def percent_of(part, whole) -> Column:
    """part / whole * 100 as double (NULL when whole is 0)."""
    return F.try_divide(_c(part).cast("double"), _c(whole).cast("double")) * F.lit(100.0)


def sum_or_zero(col) -> Column:
    """pandas ``sum``: an all-null (or empty) group sums to 0, not NULL."""
    return F.coalesce(F.sum(_c(col)), F.lit(0))


def all_of(conditions: Iterable[Column]) -> Column:
    conds = list(conditions)
    if not conds:
        return F.lit(True)
    return reduce(lambda a, b: a & b, conds)
