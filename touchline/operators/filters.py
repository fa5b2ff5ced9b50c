"""Row filters of the profile and sizing pages."""

from __future__ import annotations

from typing import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.semantics import all_of, is_member, not_equal_keep_null

ALL = "All"


def optional_filters(df: DataFrame, eq: Mapping[str, object] | None = None,
                     isin: Mapping[str, Iterable] | None = None) -> DataFrame:
    """AND of equality and membership filters; a value of 'All' (or None)
    means no filter on that column.  Values travel as typed literals, so a
    quote inside a value is just a character."""
    conds = []
    for c, v in (eq or {}).items():
        if v is None or v == ALL:
            continue
        conds.append(F.col(f"`{c}`") == F.lit(v))
    for c, vs in (isin or {}).items():
        if vs is None or vs == ALL:
            continue
        conds.append(is_member(F.col(f"`{c}`"), vs))
    return df.filter(all_of(conds)) if conds else df


def require_rows(df: DataFrame) -> DataFrame:
    """Raise when the table is empty (one tiny action)."""
    if df.isEmpty():
        raise ValueError("input table is empty")
    return df


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def tam_scope(market: DataFrame, platform: str = "Shopify",
              excluded_category: str = "a) < $1M",
              arr: str = "POLAR ARR ($)") -> DataFrame:
    """Addressable market rows: one platform, not the smallest GMV class
    (a NULL class is kept, as pandas ``!=`` keeps it), positive ARR."""
    return market.filter((F.col("PLATFORM") == F.lit(platform))
                         & not_equal_keep_null(F.col("GMV_CATEGORY"), excluded_category)
                         & (F.col(f"`{arr}`") > 0))
