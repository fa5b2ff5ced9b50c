"""Exact quantiles (linear interpolation, as pandas / numpy default) per
group by rank selection: no value is sorted, checkpointed or shuffled as such.

A double is mapped to a 64-bit key that keeps its order.  A histogram over the
keys' leading 22 bits (partial aggregates; at most 4 M bins a group) tells in
which bin each wanted rank lies; the next 21 bits are counted for rows of those
bins only, then the last 21, and a rank's value is its key turned back.  Which
rows lie in a wanted bin is told by a bitmap of fixed size over (group, bin),
read as a scalar subquery, so rows never meet a table to be filtered; a false
hit of the bitmap goes at the join with the wanted bins, after aggregation.

For n values of a group and probability p, h = (n - 1) p (``RULES`` has the
chart library's rule as well); the result is
v[floor h] + (v[ceil h] - v[floor h]) * (h - floor h) with v 0-indexed in
ascending order.  NULL and NaN values are ignored; -0.0 counts as 0.0.
"""

from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Place of probability p among n sorted values, counted from 0.
RULES: dict[str, Callable[[Column, float], Column]] = {
    "linear": lambda n, p: (n - 1).cast("double") * F.lit(float(p)),
    # The chart library's default for box plots; outside 0..n-1 the end value.
    "chart": lambda n, p: F.greatest(F.lit(0.0), F.least(
        n.cast("double") * F.lit(float(p)) - 0.5, (n - 1).cast("double"))),
}

SHIFTS = (42, 21, 0)          # bits below the prefix of each round
BITS = 32_768                 # of the bitmap; fixed by the aggregate


def ordered_key(v: Column) -> Column:
    """The double's sign and IEEE bits as a BIGINT of the same order."""
    return _ordered(F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), v).cast("bigint"))


def _ordered(bits: Column) -> Column:
    return F.when(bits < 0, -bits.bitwiseAND(F.lit((1 << 63) - 1))).otherwise(bits)


def value_of(key: Column) -> Column:
    """The double of ``ordered_key``."""
    a = F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), F.abs(key)).cast("double")
    return F.when(key < 0, -a).otherwise(a)


def keyed_values(df: DataFrame, group_cols: Sequence[str], value_col: str) -> DataFrame:
    """Group columns, ``_v`` and ``_key`` of the values that count."""
    v = df.select(*group_cols, F.col(value_col).cast("double").alias("_v"))
    v = v.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    # The method call stands in a select of its own, so it runs once per row.
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), F.col("_v")).cast("bigint")
    return v.withColumn("_bits", bits).withColumn("_key", _ordered(F.col("_bits"))).drop("_bits")


def _bit(g: Sequence[str], prefix: Column) -> Column:
    return F.pmod(F.xxhash64(*g, prefix), F.lit(BITS))


def in_bins(values: DataFrame, bins: DataFrame, g: Sequence[str], prefix: Column, bin_col: str) -> DataFrame:
    """Rows whose (group, prefix) may be among ``bins`` (never misses one)."""
    bits = bins.agg(F.bitmap_construct_agg(_bit(g, F.col(bin_col)))).scalar()
    at = _bit(g, prefix)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    return values.filter(F.getbit(byte.cast("bigint"), (at % 8).cast("int")) == 1)


def _same(left: DataFrame, right: DataFrame, pairs) -> Column:
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def selected(values: DataFrame, g: Sequence[str], wanted: Callable[[Column], Column]) -> DataFrame:
    """``_n`` (group size), ``_r`` and ``_v`` for every rank (from 1) in the
    array ``wanted(n)``; ``values`` as from ``keyed_values``."""
    g = list(g)
    found = None
    for level, shift in enumerate(SHIFTS):
        prefix = F.shiftright("_key", shift)
        if found is None:
            h = values.groupBy(*g, prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
            w = Window.partitionBy(*g)
            h = h.select("*", F.sum("_c").over(w.orderBy("_p")).alias("_cum"), F.sum("_c").over(w).alias("_n"))
            h = h.withColumn("_w", F.transform(F.array_distinct(wanted(F.col("_n"))), lambda r: F.struct(
                r.alias("r"), F.lit(0).cast("bigint").alias("skip"))))
        else:
            outer = F.shiftright("_key", SHIFTS[level - 1])
            h = (in_bins(values, found, g, outer, "_p")
                 .groupBy(*g, outer.alias("_o"), prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_c")))
            bins = found.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(g)], F.col("_p").alias("_b")).agg(
                F.first("_n").alias("_n"), F.collect_list(F.struct(F.col("_r").alias("r"), F.col("_skip").alias("skip"))).alias("_w"))
            h = h.join(bins, _same(h, bins, [*[(c, f"_g{i}") for i, c in enumerate(g)], ("_o", "_b")]))
            h = h.withColumn("_cum", F.sum("_c").over(Window.partitionBy(*g, "_o").orderBy("_p")))
        here = F.filter("_w", lambda x: (x["r"] - x["skip"] > F.col("_cum") - F.col("_c"))
                        & (x["r"] - x["skip"] <= F.col("_cum")))
        found = h.select(*g, "_p", "_n", F.col("_cum"), F.col("_c"), F.explode(here).alias("_x")).select(
            *g, "_p", "_n", F.col("_x.r").alias("_r"), (F.col("_x.skip") + F.col("_cum") - F.col("_c")).alias("_skip"))
    return found.select(*g, "_n", "_r", value_of(F.col("_p")).alias("_v"))


def quantiles_of(values: DataFrame, group_cols: Sequence[str], probs: Mapping[str, float],
                 rule: str = "linear") -> DataFrame:
    """One row per group and a column per entry of ``probs``."""
    g = list(group_cols)
    place = {name: (lambda n, p=p: RULES[rule](n, p)) for name, p in probs.items()}
    hits = selected(values, g, lambda n: F.array(*[
        f(at(n)).cast("bigint") + 1 for at in place.values() for f in (F.floor, F.ceil)]))

    def value(at) -> Column:
        h = at(F.col("_n"))
        lo = F.max(F.when(F.col("_r") == F.floor(h) + 1, F.col("_v")))
        hi = F.max(F.when(F.col("_r") == F.ceil(h) + 1, F.col("_v")))
        return lo + (hi - lo) * F.max(h - F.floor(h))

    return hits.groupBy(*g).agg(*[value(at).alias(name) for name, at in place.items()])


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                    probs: dict[str, float],
                    extra: Mapping[str, Callable[[Column], Column]] | None = None,
                    rule: str = "linear") -> DataFrame:
    """One row per group with one column per entry of ``probs``.

    ``extra`` adds other aggregates of the same values (name -> function of
    the value column).  Nothing runs while the plan is built."""
    g = list(group_cols)
    values = keyed_values(df, g, value_col)
    out = quantiles_of(values, g, probs, rule)
    if not extra:
        return out
    if not g:
        raise ValueError("extra aggregates need at least one group column")
    stats = values.groupBy(*g).agg(*[fn(F.col("_v")).alias(name) for name, fn in extra.items()])
    return join_groups(out, stats, g)


def join_groups(left: DataFrame, right: DataFrame, g: Sequence[str]) -> DataFrame:
    """Join on group columns that may be NULL."""
    r = right.select(*[F.col(c).alias(f"_s_{c}") if c in g else F.col(c) for c in right.columns])
    cond = [left[c].eqNullSafe(r[f"_s_{c}"]) for c in g]
    return left.join(r, cond).drop(*[f"_s_{c}" for c in g])
