"""Column-level reshaping used by the profile pages."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def insert_after(df: DataFrame, anchor: str, name: str, col: Column) -> DataFrame:
    """Place ``col`` as ``name`` right after ``anchor`` (replacing an
    existing column of that name)."""
    cols = [c for c in df.columns if c != name]
    at = cols.index(anchor) + 1
    sel = [_q(c) for c in cols[:at]] + [col.alias(name)] + [_q(c) for c in cols[at:]]
    return df.select(*sel)


def drop_if_present(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name) if name in df.columns else df


def drop_last(df: DataFrame, n: int) -> DataFrame:
    """Drop the last ``n`` columns by position."""
    return df.select(*[_q(c) for c in df.columns[:-n]]) if n else df


def with_campaign_length(df: DataFrame, start: str = "CAMPAIGN_START_DATE",
                         last: str = "CAMPAIGN_LAST_DATE",
                         name: str = "CAMPAIGN_LENGTH") -> DataFrame:
    """Days from start to last date, placed after the last-date column."""
    return insert_after(df, last, name, F.datediff(_q(last), _q(start)).cast("bigint"))


def campaign_spans(df: DataFrame, metric: str, group: str = "CAMPAIGN_GROUP",
                   start: str = "CAMPAIGN_START_DATE",
                   last: str = "CAMPAIGN_LAST_DATE") -> DataFrame:
    """One span per campaign row with all four fields present, plus the hover
    label 'Start: ..<br>End: ..<br>metric: value'."""
    rows = df
    for c in (start, last, metric, group):
        rows = rows.filter(_q(c).isNotNull())
    label = F.concat(F.lit("Start: "), _q(start).cast("string"), F.lit("<br>End: "),
                     _q(last).cast("string"), F.lit(f"<br>{metric}: "), _q(metric).cast("string"))
    return rows.select(_q(group).alias("CAMPAIGN_GROUP"), _q(start).alias("START"),
                       _q(last).alias("END"), _q(metric).alias("VALUE"), label.alias("LABEL"))


def scatter_pairs(df: DataFrame, x: str, y: str, color: str,
                  hover: Sequence[str] = ()) -> DataFrame:
    """Points (x, y, colour) behind a scatter chart."""
    return df.select(_q(x).alias("X"), _q(y).alias("Y"), _q(color).alias("COLOR"),
                     *[_q(h) for h in hover])
