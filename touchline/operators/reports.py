"""Attribution page summaries, computed from the marts.

``report`` is an attribution model mart (``attribution_report``); ``cjm``
is the customer-journey mart (``touch_journey``).  Group keys that are
NULL are dropped and page-side integer casts truncate, as the pages do.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.semantics import is_member, percent_of
from touchline.functions.text import trunc_int

SOURCE = "ATTRIBUTION_SOURCE"


def source_share(report: DataFrame) -> DataFrame:
    """Attributed orders per source and its percent of all orders.

    The grand total is a window over the aggregated rows (one per source), so
    the report behind them is computed once."""
    agg = (report.filter(F.col(SOURCE).isNotNull())
           .groupBy(SOURCE)
           .agg(F.sum(trunc_int("ATTRIBUTED_ORDERS")).alias("ATTRIBUTED_ORDERS")))
    total = F.sum("ATTRIBUTED_ORDERS").over(Window.partitionBy())
    return agg.withColumn("PERCENTAGE",
                          F.col("ATTRIBUTED_ORDERS").cast("double") / total.cast("double")
                          * F.lit(100.0))


def monthly_by_source(report: DataFrame) -> DataFrame:
    """Orders and revenue (truncated to int per row) by (month, source);
    the stacked bars of one month add up to these sums."""
    return (report.filter(F.col("MONTH").isNotNull() & F.col(SOURCE).isNotNull())
            .groupBy("MONTH", SOURCE)
            .agg(F.sum(trunc_int("ATTRIBUTED_ORDERS")).alias("ATTRIBUTED_ORDERS"),
                 F.sum(trunc_int("ATTRIBUTED_REVENUE")).alias("ATTRIBUTED_REVENUE")))


def referrer_contribution(report: DataFrame, n: int | None = None) -> DataFrame:
    """Orders and revenue per page referrer, largest first (ties by name).
    ``n`` keeps the first n referrers (the page shows ten)."""
    out = (report.filter(F.col("PAGEREFERRER").isNotNull())
           .groupBy("PAGEREFERRER")
           .agg(F.sum(trunc_int("ATTRIBUTED_ORDERS")).alias("total_orders"),
                F.sum(trunc_int("ATTRIBUTED_REVENUE")).alias("total_revenue"))
           .orderBy(F.col("total_orders").desc(), F.col("total_revenue").desc(),
                    F.col("PAGEREFERRER")))
    return out.limit(n) if n else out


def step_orders(cjm: DataFrame) -> DataFrame:
    """Distinct orders by (touch step, source)."""
    return (cjm.filter(F.col("TOUCHPOINT_STEP").isNotNull() & F.col(SOURCE).isNotNull())
            .groupBy("TOUCHPOINT_STEP", SOURCE)
            .agg(F.count_distinct("SHOPIFYORDERID").alias("ORDER_COUNT")))


def touch_funnel(cjm: DataFrame, sources: Iterable[str] | None = None,
                 max_step: int = 10) -> DataFrame:
    """Distinct orders per step (steps below ``max_step``) for each selected
    source, with the percent of the source's first step ("percent initial").
    ``sources=None`` computes every source at once."""
    f = cjm.filter(F.col("SHOPIFYORDERID").isNotNull()
                   & (F.col("TOUCHPOINT_STEP").cast("double") < max_step))
    if sources is not None:
        f = f.filter(is_member(F.col(SOURCE), sources))
    return funnel_of_counts(f.groupBy(SOURCE, "TOUCHPOINT_STEP")
                            .agg(F.count_distinct("SHOPIFYORDERID").alias("ORDER_COUNT")))


def funnel_of_counts(agg: DataFrame) -> DataFrame:
    """``touch_funnel`` from orders by step and source (``step_counts``)."""
    # One row per step and source: a small window.
    first = F.min_by("ORDER_COUNT", "TOUCHPOINT_STEP").over(Window.partitionBy(SOURCE))
    return agg.withColumn("PERCENT_INITIAL", percent_of(F.col("ORDER_COUNT"), first))


def source_edges(report: DataFrame) -> DataFrame:
    """Weighted edges source -> 'Purchase' with node indexes (sources in
    name order, then 'Purchase')."""
    agg = (report.filter(F.col(SOURCE).isNotNull())
           .groupBy(SOURCE).agg(F.sum(trunc_int("ATTRIBUTED_ORDERS")).alias("VALUE")))
    # One row per distinct source, so a plain window over them will do.
    numbered = (agg.withColumn("_n", F.row_number().over(Window.orderBy(SOURCE)))
                .withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy())))
    return numbered.select(F.col(SOURCE).alias("SOURCE"),
                           (F.col("_n") - 1).cast("bigint").alias("SOURCE_INDEX"),
                           F.lit("Purchase").alias("TARGET"),
                           F.col("_k").cast("bigint").alias("TARGET_INDEX"), "VALUE")


def orders_by_month_chart(orders_month_store: DataFrame) -> DataFrame:
    """Bars of the orders-per-month mart (month, count, colour = store)."""
    return orders_month_store.select("MONTH", "ORDER_COUNT", "STORE")
