"""Content-driven cleaning of a loaded table (``clean``).

For each text column, in column order:
1. a protected free-text column (campaign name) is left alone;
2. if any value contains a date (``dddd-dd-dd`` or ``dddd/dd/dd``) the
   whole column becomes DATE, unparseable values NULL;
3. protected category columns are left alone;
4. otherwise '$' and ',' are stripped and the column cast to integer --
   strict mode raises on text that is not an integer, lenient mode gives
   NULL.
Then whole-row duplicates are dropped (when at least one column reached the
dedup step in the source rule: any non-text or converted column).
Floating-point NaN becomes NULL: pandas treats NaN as missing (skipped by
sums and means, sorted last), while Spark treats it as a value above every
number.

Plan: one aggregate pass decides the date columns (a single row comes back
to the driver), one select applies all casts, one ``dropDuplicates``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

from touchline.functions.text import DATE_LIKE, to_day, to_int_lenient, to_int_strict

# Columns the source never converts.
FREE_TEXT = ("CAMPAIGN_GROUP",)
CATEGORIES = ("PLATFORM", "GMV_CATEGORY", "COUNTRY")


def date_like_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Text columns with at least one date-shaped value (one small action)."""
    if not cols:
        return []
    row = df.agg(*[F.max(F.col(f"`{c}`").rlike(DATE_LIKE)).alias(f"c{i}")
                   for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"c{i}"]]


def clean(df: DataFrame, strict: bool = True, free_text: Sequence[str] = FREE_TEXT,
          categories: Sequence[str] = CATEGORIES,
          date_columns: Sequence[str] | None = None) -> DataFrame:
    """See above.  With ``date_columns`` (a declared schema) the content test
    is skipped and building the plan runs no job."""
    text = [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in free_text]
    dates = set(date_like_columns(df, text) if date_columns is None else date_columns)
    to_int = to_int_strict if strict else to_int_lenient
    out, dedup = [], False
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            out.append(F.when(~F.isnan(c), c).alias(f.name))
            dedup = True
        elif not isinstance(f.dataType, StringType):
            out.append(c)
            dedup = True
        elif f.name in free_text:
            out.append(c)
        elif f.name in dates:
            out.append(to_day(c).alias(f.name))
        elif f.name in categories:
            out.append(c)
        else:
            out.append(to_int(c).alias(f.name))
            dedup = True
    res = df.select(*out)
    return res.dropDuplicates() if dedup else res
