"""Ordered numbering and running totals that never put one group in one task.

``row_number() OVER (PARTITION BY g ORDER BY o)`` and a running ``SUM`` are
evaluated by Spark one window partition per task: a hot group (or a window
with no partition key at all) becomes one task.  Here the rows are range
partitioned on the *whole* sort key (g, o) instead, so a big group is cut
into many buckets of similar size:

1. ``repartitionByRange(g, o)``; the bucket id is the partition id.  With
   no explicit bucket count, AQE coalesces neighbouring range partitions
   up to the advisory partition size, so buckets stay contiguous key
   ranges.  A piece of a hot group is the input's size divided by
   ``spark.sql.shuffle.partitions`` at least, so that number (or
   ``n_buckets``) is to be set from the input's size on large data.  The
   result is checkpointed to the shared folder so both later reads see the
   same bucket ids even after a lost executor.  The input is persisted
   while this runs: the range partitioner samples its input in a separate
   job, which would otherwise compute the upstream (e.g. a join) twice.
2. per (bucket, g): row count / value sum -- at most ``n`` rows per group.
3. per g, running sum over its buckets (window over <= n rows) -> offset.
4. per (bucket, g): local row number / running sum + offset.

The result equals the plain window when the sort key is a total order
inside each group (add a unique tie-breaker).
"""

from __future__ import annotations

from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FractionalType, IntegralType

from touchline.session import reliable_checkpoint

_B = "_tl_bucket"
_OFF = "_tl_offset"


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not keys:
        return left.join(right, on=[_B])
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])
    cond = [left[_B] == r[f"_r_{_B}"]] + [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    j = left.join(r, on=cond).drop(*[f"_r_{k}" for k in keys], f"_r_{_B}")
    for c in right.columns:
        if c not in keys and c != _B:
            j = j.withColumnRenamed(f"_r_{c}", c)
    return j


def running(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence,
            out: str, value: str | None = None, n_buckets: int | None = None,
            total_out: str | None = None) -> DataFrame:
    """Add ``out``: row number (``value=None``) or running sum of ``value``
    (ROWS frame, unbounded preceding .. current row) within
    ``partition_cols`` in ``order_cols`` order.  ``total_out`` also adds the
    group's row count / value total.

    ``order_cols`` are column names or sort Columns (``F.col(x).desc()``).
    """
    pcols = list(partition_cols)
    order = [_col(c) for c in order_cols]
    sort_key = [F.col(c).asc_nulls_first() for c in pcols] + order
    held = df.storageLevel.useMemory or df.storageLevel.useDisk   # the caller's own cache
    src = df if held else df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ranged = (src.repartitionByRange(n_buckets, *sort_key) if n_buckets
                  else src.repartitionByRange(*sort_key))
        b = reliable_checkpoint(ranged.withColumn(_B, F.spark_partition_id()))
    finally:
        if not held:
            src.unpersist()

    measure = F.count(F.lit(1)) if value is None else F.sum(F.col(value))
    per_bucket = b.groupBy(_B, *pcols).agg(measure.alias("_tl_m"))
    before = Window.partitionBy(*pcols).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    extra = []
    if total_out:
        extra = [F.sum("_tl_m").over(Window.partitionBy(*pcols)).alias(total_out)]
    offsets = per_bucket.select(
        _B, *pcols, F.coalesce(F.sum("_tl_m").over(before), F.lit(0)).alias(_OFF), *extra)

    local = Window.partitionBy(_B, *pcols).orderBy(*order)
    if value is None:
        local_val = F.row_number().over(local)
    else:
        local_val = F.sum(F.col(value)).over(local.rowsBetween(Window.unboundedPreceding, 0))
    joined = _null_safe_join(b, offsets, pcols)
    return (joined.withColumn(out, local_val + F.col(_OFF))
            .drop(_B, _OFF))


def row_number_within(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence,
                      out: str = "row_number", n_buckets: int | None = None,
                      total_out: str | None = None) -> DataFrame:
    return running(df, partition_cols, order_cols, out, None, n_buckets, total_out)


def running_sum(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence,
                value: str, out: str, n_buckets: int | None = None,
                total_out: str | None = None) -> DataFrame:
    return running(df, partition_cols, order_cols, out, value, n_buckets, total_out)


def dealt_once(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` hash partitioned on ``keys``, its columns packed as ``_row``.

    Several readers of the result share one exchange, so ``df`` is computed
    once: they all take the whole ``_row`` (``unpacked`` or ``inside``) and the
    filters that joins on the keys would infer stand here already, which keeps
    their exchanges the same plan.  Rows with a null key are dropped.
    """
    present = F.lit(True)
    for k in keys:
        present = present & F.col(f"`{k}`").isNotNull()
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    return df.filter(present).select(*[F.col(f"`{k}`").alias(f"_k_{k}") for k in keys], row) \
        .repartition(*[F.col(f"`_k_{k}`") for k in keys])


def unpacked(dealt: DataFrame) -> DataFrame:
    keys = [c for c in dealt.columns if c != "_row"]
    return dealt.select(F.inline(F.array("_row")), *[F.col(f"`{k}`") for k in keys])


def inside(expr) -> Column:
    """A value computed from the whole packed row (``expr`` takes the row)."""
    return F.element_at(F.transform(F.array("_row"), expr), 1)


def running_by_pieces(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence,
                      piece: Column, out: str, value: str | None = None,
                      total_out: str | None = None) -> DataFrame:
    """``running`` without a job while the plan is built, and without a sort
    or checkpoint of the whole relation: pieces come from the data.

    ``piece`` must not fall along ``order_cols`` (for example a leading order
    column divided by a width, rounded down; null counts as first), so a group
    is cut into runs of rows that stand together.  Per-piece measures are summed
    into offsets by a window over one row per piece, a local window adds them.
    The rows are exchanged once.  ``partition_cols`` must hold no null.
    """
    pcols = list(partition_cols)
    keyed = df.withColumn("_piece", F.coalesce(piece.cast("bigint"), F.lit(-(1 << 63))))
    dealt = dealt_once(keyed, [*pcols, "_piece"])
    keys = [f"_k_{c}" for c in pcols]
    measure = inside(lambda r: F.lit(1).cast("bigint") if value is None else r[value])
    per = dealt.groupBy(*keys, "_k__piece").agg(F.sum(measure).alias("_m"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_k__piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = [F.sum("_m").over(whole).alias("_total")] if total_out else []
    offsets = per.select(*[F.col(k).alias(f"_o{k}") for k in keys], F.col("_k__piece").alias("_o_piece"),
                         F.coalesce(F.sum("_m").over(before), F.lit(0)).alias(_OFF), *totals)
    local = Window.partitionBy(*keys, "_k__piece").orderBy(*[_col(c) for c in order_cols])
    here = (F.row_number().over(local) if value is None
            else F.sum(F.col(value)).over(local.rowsBetween(Window.unboundedPreceding, 0)))
    rows = unpacked(dealt).withColumn("_here", here)
    cond = [rows[k] == offsets[f"_o{k}"] for k in keys] + [rows["_k__piece"] == offsets["_o_piece"]]
    extra = [F.col("_total").alias(total_out)] if total_out else []
    return rows.join(offsets, cond).select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_here") + F.col(_OFF)).alias(out), *extra)


SAMPLED = 16          # sampled sort keys per piece


def rising_key(df: DataFrame, order: Sequence) -> Column:
    """A struct that compares, ascending, as the rows of ``df`` stand in ``order``.

    Entries are column names (ascending, nulls first) or pairs (name, way) with
    way ``asc``, ``asc_nulls_last`` or ``desc`` (nulls last; numbers only)."""
    fields = []
    for entry in order:
        name, way = (entry, "asc") if isinstance(entry, str) else entry
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType
        if way == "asc":
            fields.append(c)
        elif way == "asc_nulls_last":
            fields += [c.isNull(), c]
        elif way != "desc":
            raise ValueError(f"unknown way {way!r}")
        elif isinstance(kind, IntegralType):
            fields += [c.isNull(), F.bitwise_not(c)]
        elif isinstance(kind, DecimalType):
            fields += [c.isNull(), -c]
        elif isinstance(kind, FractionalType):
            fields += [c.isNull(), ~F.isnan(c), -c]
        else:
            raise ValueError(f"descending order needs a number, {name!r} is {kind.simpleString()}")
    return F.struct(*[f.alias(f"k{i}") for i, f in enumerate(fields)])


def running_in_order(df: DataFrame, order: Sequence, out: str, value: str | None = None,
                     total_out: str | None = None, pieces: int | None = None) -> DataFrame:
    """Number or running total over the whole relation, as ``running`` without
    partition columns, but with no job while the plan is built and no
    checkpoint: the cut points are an aggregate of the plan itself.

    Rows are dealt by the hash of their sort key (``rising_key``); the number
    of rows, a sample of sort keys by hash (about ``SAMPLED`` a piece) and
    the rows themselves are read from that one exchange.  Every ``SAMPLED``-th
    sampled key cuts, whole keys and not leading columns, so a value that many
    rows share is cut as well.  A row finds its piece by binary search.  Everything
    follows from the data, so a lost task computes the same pieces again.

    ``pieces`` defaults to ``spark.sql.shuffle.partitions``.  Rows with equal
    sort keys stand in one piece, in any order: add a unique tie-breaker.
    """
    n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_order", rising_key(df, order)).withColumn("_deal", F.xxhash64("_order"))
    dealt = dealt_once(keyed, ["_deal"])
    count = dealt.agg(F.sum(inside(lambda r: F.lit(1).cast("bigint"))).alias("n")).scalar()
    share = F.lit(float(n * SAMPLED)) / F.greatest(F.coalesce(count, F.lit(1)), F.lit(1)).cast("double")
    key = inside(lambda r: r["_order"])
    place = F.pmod(inside(lambda r: r["_deal"]), F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))
    sample = dealt.agg(F.sort_array(F.collect_set(F.when(place < share, key))).alias("keys"))
    cuts = sample.select(F.filter("keys", lambda k, i: i % SAMPLED == SAMPLED - 1)).scalar()
    # Cuts at or before the key; beyond 2^bits cuts the last piece takes the rest.
    bits = (2 * n).bit_length()
    piece = F.aggregate(
        F.array(*[F.lit(1 << b) for b in reversed(range(bits))]), F.lit(0),
        lambda at, step: F.when(F.get("_cuts", at + step - 1) <= F.col("_order"), at + step).otherwise(at))
    # A function over an array takes no subquery; the cuts are a column first.
    placed = unpacked(dealt).drop("_k__deal").withColumn("_cuts", cuts).withColumn("_at", piece).drop("_cuts")
    done = running_by_pieces(placed, [], ["_order"], F.col("_at"), out, value, total_out)
    return done.select(*[F.col(f"`{c}`") for c in df.columns], out, *([total_out] if total_out else []))
