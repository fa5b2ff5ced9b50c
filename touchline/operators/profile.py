"""Column profiles and group summaries of the exploration pages."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DateType, DecimalType, FractionalType, IntegralType, NumericType, StringType, TimestampNTZType, TimestampType,
)

from touchline.functions.semantics import sum_or_zero
from touchline.functions.text import log1p_positive
from touchline.operators.quantiles import (
    SHIFTS, exact_quantiles, in_bins, join_groups, keyed_values, ordered_key, quantiles_of,
)
from touchline.session import reliable_checkpoint

WIDE = 16             # columns; beyond, cells beat a copy of the row per column
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def _unpivot(wide: DataFrame, cols: Sequence[str], value: str) -> DataFrame:
    """(COLUMN_NAME, ``value``) from columns named c0, c1, ... in the order of
    ``cols``; names with dots or other signs are only ever literals."""
    names = F.create_map(*[F.lit(x) for i, c in enumerate(cols) for x in (f"c{i}", c)])
    return (wide.unpivot([], [f"c{i}" for i in range(len(cols))], "COLUMN_NAME", value)
            .withColumn("COLUMN_NAME", names[F.col("COLUMN_NAME")]))


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(COLUMN_NAME, VALUE double) -- one row per cell of ``cols``."""
    wide = df.select(*[_q(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    return _unpivot(wide, cols, "VALUE")


def describe(df: DataFrame, cols: Sequence[str] | None = None,
             approx: bool = False, decimals: int | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per numeric column, one
    row per column.  Quartiles are exact (linear interpolation), found by rank
    selection over histograms (``quantiles``); ``approx=True`` uses
    ``percentile_approx`` instead (one pass).  NULL and NaN are skipped.

    Mean and std depend on the order of floating-point addition, which no
    distributed engine fixes; ``decimals`` rounds them for reproducible
    output."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    long = _long(df, cols).filter(F.col("VALUE").isNotNull() & ~F.isnan("VALUE"))
    v = F.col("VALUE")
    if approx:
        out = long.groupBy("COLUMN_NAME").agg(
            F.count(v).cast("double").alias("count"), F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
            *[F.percentile_approx(v, p, 10000).alias(n) for n, p in QUARTILES.items()])
    else:
        out = exact_quantiles(long, ["COLUMN_NAME"], "VALUE", QUARTILES, extra={
            "count": lambda c: F.count(c).cast("double"), "mean": F.avg,
            "std": F.stddev_samp, "min": F.min, "max": F.max})
    if decimals is not None:
        out = out.withColumns({c: F.round(c, decimals) for c in ("mean", "std")})
    return out.select("COLUMN_NAME", "count", "mean", "std", "min",
                      *QUARTILES.keys(), "max")


def unique_counts(df: DataFrame, cols: Sequence[str] | None = None,
                  approx: bool = False, wide: int = WIDE) -> DataFrame:
    """Distinct non-null values per column as (COLUMN_NAME, UNIQUE_VALUES
    text).  Exact counts of more than ``wide`` columns turn a row into narrow
    cells (column number, value), distinct in each task before the shuffle,
    which so grows with the distinct values.  Several distinct aggregates, the
    form of fewer columns, copy the whole row per column: the square of the
    width.  ``approx=True`` uses HyperLogLog sketches.  NaN counts as one
    value, -0.0 as 0.0.  Types without a cell form (``_cell``) take the second form."""
    cols = list(cols) if cols is not None else df.columns
    cells = [_cell(_q(c), df.select(_q(c)).schema[0].dataType) for c in cols]
    if approx or len(cols) <= wide or any(c is None for c in cells):
        fn = F.approx_count_distinct if approx else F.count_distinct
        agg = df.agg(*[fn(_q(c)).cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
        return _unpivot(agg, cols, "UNIQUE_VALUES")
    rows = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("at"), whole.alias("n"), text.alias("s"))
        for i, (whole, text) in enumerate(cells)])))
    # A cell without a value for each column: columns without values count 0.
    none = df.sparkSession.range(len(cols)).select(
        F.col("id").alias("at"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("string").alias("s"))
    names = F.create_map(*[F.lit(x) for i, c in enumerate(cols) for x in (i, c)])
    return (rows.unionByName(none).distinct().groupBy("at")
            .agg(F.count_if(F.col("n").isNotNull() | F.col("s").isNotNull()).cast("string").alias("UNIQUE_VALUES"))
            .select(names[F.col("at").cast("int")].alias("COLUMN_NAME"), "UNIQUE_VALUES"))


def _cell(c: Column, kind) -> tuple[Column, Column] | None:
    """A value as (BIGINT, text), one of them NULL; different values of the
    type give different cells.  None for types that have no such form."""
    whole = text = None
    if isinstance(kind, (IntegralType, BooleanType)):
        whole = c.cast("bigint")
    elif isinstance(kind, DateType):
        whole = F.unix_date(c).cast("bigint")
    elif isinstance(kind, TimestampType):
        whole = F.unix_micros(c)
    elif isinstance(kind, FractionalType):
        text = (c if isinstance(kind, DecimalType) else c + F.lit(0.0)).cast("string")
    elif isinstance(kind, TimestampNTZType):
        text = c.cast("string")
    elif type(kind) is StringType and kind.collation == StringType().collation:
        text = c
    else:
        return None
    null = F.lit(None)
    return (null.cast("bigint") if whole is None else whole), (null.cast("string") if text is None else text)


def distinct_values(df: DataFrame, col: str, ordered: bool = True) -> DataFrame:
    out = df.select(_q(col)).filter(_q(col).isNotNull()).distinct()
    return out.orderBy(_q(col)) if ordered else out


def sum_by(df: DataFrame, key: str, metric: str, descending: bool = False) -> DataFrame:
    """Sum of ``metric`` per non-null ``key``; an all-null group sums to 0."""
    out = (df.filter(_q(key).isNotNull()).groupBy(_q(key).alias(key))
           .agg(sum_or_zero(_q(metric)).alias(metric)))
    if descending:
        out = out.orderBy(_q(metric).desc_nulls_last(), _q(key))
    return out


def top_n_by_sum(df: DataFrame, key: str, metric: str, n: int = 10) -> DataFrame:
    """The n keys with the largest sum; ties keep the smaller key."""
    return sum_by(df, key, metric).orderBy(_q(metric).desc(), _q(key)).limit(n)


def top_n_distinct(df: DataFrame, key: str, value: str, n: int = 10) -> DataFrame:
    """The n keys with the most distinct values; ties keep the smaller key."""
    return (df.filter(_q(key).isNotNull()).groupBy(_q(key).alias(key))
            .agg(F.count_distinct(_q(value)).alias(value))
            .orderBy(_q(value).desc(), _q(key)).limit(n))


def metric_by_start_month(df: DataFrame, metric: str,
                          date_col: str = "CAMPAIGN_START_DATE") -> DataFrame:
    """Sum of ``metric`` per month of year (1-12, years merged); rows
    without a date are dropped."""
    m = F.month(_q(date_col))
    return (df.filter(_q(date_col).isNotNull()).groupBy(m.cast("bigint").alias("START_MONTH"))
            .agg(sum_or_zero(_q(metric)).alias(metric)))


def box_stats(df: DataFrame, key: str, value: str, log: bool = False,
              decimals: int | None = None, approx: bool = False) -> DataFrame:
    """What a box chart draws of ``value`` per ``key``: quartiles by the chart
    library's rule (interpolated at place n p - 0.5), whiskers (the last
    values within 1.5 box lengths of the box), and how many points lie beyond
    them.  ``approx=True``: ``percentile_approx`` quartiles, no ranking.
    ``log=True`` first maps x to log(1 + x) for x > 0, else NULL (dropped).
    ``decimals`` rounds the statistics."""
    v = log1p_positive(_q(value)) if log else _q(value).cast("double")
    base = df.select(_q(key).alias("KEY"), v.alias("VALUE"))
    base = base.filter(F.col("VALUE").isNotNull() & ~F.isnan("VALUE"))
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    values = keyed_values(base, ["KEY"], "VALUE")
    if approx:
        box = values.groupBy("KEY").agg(
            *[F.percentile_approx("_v", p, 10000).alias(n) for n, p in probs.items()])
    else:
        box = quantiles_of(values, ["KEY"], probs, "chart")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fence = {"low": F.col("q1") - reach, "high": F.col("q3") + reach}
    # One row per key; every part below reads it.
    box = reliable_checkpoint(box.select("*", *[x.alias(n) for n, x in fence.items()], *[
        F.shiftright(ordered_key(x), SHIFTS[0]).alias(f"{n}_bin") for n, x in fence.items()]))

    # Values by bin of the histogram; those in a fence's bin one by one, so that
    # each row lies on one side of both fences.
    bin_ = F.shiftright("_key", SHIFTS[0])
    sides = [F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi")]
    bins = values.groupBy("KEY", bin_.alias("bin")).agg(*sides).withColumn("whole", F.lit(True))
    fences = box.select("KEY", F.explode(F.array("low_bin", "high_bin")).alias("b"))
    near = (in_bins(values, fences, ["KEY"], bin_, "b").groupBy("KEY", bin_.alias("bin"), "_key").agg(*sides)
            .drop("_key").withColumn("whole", F.lit(False)))
    rows = join_groups(bins.unionByName(near), box, ["KEY"])
    at_fence = (F.col("bin") == F.col("low_bin")) | (F.col("bin") == F.col("high_bin"))
    rows = rows.filter(F.col("whole") != at_fence)
    j = rows.groupBy("KEY", *probs).agg(
        F.sum("c").alias("count"), F.min("lo").alias("min"), F.max("hi").alias("max"),
        F.least("q1", F.min(F.when(F.col("lo") >= F.col("low"), F.col("lo")))).alias("lower_whisker"),
        F.greatest("q3", F.max(F.when(F.col("hi") <= F.col("high"), F.col("hi")))).alias("upper_whisker"),
        F.sum(F.when((F.col("hi") < F.col("low")) | (F.col("lo") > F.col("high")), F.col("c")).otherwise(0))
        .alias("outliers"))
    stats = ["min", "lower_whisker", "q1", "median", "q3", "upper_whisker", "max"]
    if decimals is not None:
        j = j.withColumns({c: F.round(c, decimals) for c in stats})
    return j.select(F.col("KEY").alias(key), "count", *stats, "outliers")


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows as stored (no sort)."""
    return df.limit(n)
