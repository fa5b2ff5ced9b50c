"""Outbound sizing: Pareto share of campaigns, addressable market, funnel,
ICP rates and the rule-based limitations summary.

Global totals are scalar subqueries (computed once, inlined as a value),
except the Pareto total, which comes out of the same pass by pieces
that computes the running total; no single task sees the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.semantics import pandas_div, percent_of
from touchline.functions.text import fixed_text, money_text
from touchline.operators.filters import tam_scope
from touchline.operators.sequence import running_in_order

ARR = "NEW_ARR_FROM_OB_ALL_TIME"
MARKET_ARR = "POLAR ARR ($)"
TOP, OTHER = "Top 80%", "Other"


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _label(cum: Column, total: Column, threshold: float) -> Column:
    return F.when(cum <= F.lit(float(threshold)) * total.cast("double"), F.lit(TOP)) \
        .otherwise(F.lit(OTHER))


def pareto(df: DataFrame, metric: str = ARR, label_key: str = "CAMPAIGN_GROUP",
           threshold: float = 0.8, n_buckets: int | None = None) -> DataFrame:
    """Rows sorted by ``metric`` descending (ties by ``label_key``) with the
    running total (ROWS frame: ties do not merge) and 'Top 80%' while the
    running total is within ``threshold`` of the grand total.  A NULL metric
    sorts last and gets no running total ('Other')."""
    # The grand total comes out of the same pass (sum of the pieces' sums),
    # so the input is not computed a second time.
    with_cum = running_in_order(df.withColumn("_m", F.coalesce(_q(metric), F.lit(0))),
                                [(metric, "desc"), (label_key, "asc_nulls_last")], out="CUMULATIVE_NEW_ARR",
                                value="_m", total_out="_total", pieces=n_buckets)
    cum = F.when(_q(metric).isNotNull(), F.col("CUMULATIVE_NEW_ARR"))
    # The total keeps the metric's type, fractions included.
    return (with_cum.withColumn("CUMULATIVE_NEW_ARR", cum)
            .withColumn("COLOR_LABEL",
                        F.coalesce(_label(cum, F.col("_total"), threshold), F.lit(OTHER)))
            .drop("_m", "_total"))


# Texts the sizing page prints around its numbers.
TITLE_PARETO = "{pct}% of Campaigns Account for 80% of Total New ARR"
TEXT_OUTBOUND_ARR = "Total New ARR from Outbound Campaigns: "
TEXT_TAM = "Total Addressable Market (TAM): "
TEXT_CONTRIBUTION = "Outbound Campaigns contribute {pct}% to the Total Addressable Market (TAM)"


def _fill(template: str, value: Column) -> Column:
    head, tail = template.split("{pct}")
    return F.concat(F.lit(head), value, F.lit(tail))


def pareto_summary(labelled: DataFrame) -> DataFrame:
    """Number and percent of campaigns inside the top share, and the chart
    title that reports it."""
    out = labelled.agg(F.count_if(F.col("COLOR_LABEL") == TOP).alias("NUM_CAMPAIGNS_TOP"),
                       F.count(F.lit(1)).alias("NUM_CAMPAIGNS")) \
        .withColumn("PERCENT_CAMPAIGNS_TOP",
                    percent_of(F.col("NUM_CAMPAIGNS_TOP"), F.col("NUM_CAMPAIGNS")))
    return out.withColumn("TITLE", _fill(TITLE_PARETO, fixed_text("PERCENT_CAMPAIGNS_TOP", 0)))


def tam_share(market: DataFrame, country: str) -> DataFrame:
    """Total potential ARR of the addressable market and one country's
    percent of it."""
    scope = tam_scope(market)
    arr = _q(MARKET_ARR)
    agg = scope.agg(F.coalesce(F.sum(arr), F.lit(0)).alias("POTENTIAL_ARR"),
                    F.coalesce(F.sum(F.when(F.col("COUNTRY") == F.lit(country), arr)), F.lit(0))
                    .alias("COUNTRY_ARR"))
    share = pandas_div("COUNTRY_ARR", "POTENTIAL_ARR") * 100
    return agg.select(F.lit(country).alias("COUNTRY"), "POTENTIAL_ARR", "COUNTRY_ARR",
                      share.alias("COUNTRY_SHARE"),
                      money_text("POTENTIAL_ARR").alias("POTENTIAL_ARR_TEXT"),
                      F.concat(fixed_text(share, 0), F.lit("%")).alias("COUNTRY_SHARE_TEXT"))


def tam_rollup(market: DataFrame) -> DataFrame:
    """Treemap levels: total, per GMV class, per (class, country).  ``LEVEL``
    is the grouping id (3 total, 1 class, 0 leaf).  ``COLOR_VALUE`` is the
    ARR-weighted mean ARR the chart colours inner nodes with."""
    arr = _q(MARKET_ARR)
    scope = tam_scope(market)
    return (scope.rollup("GMV_CATEGORY", "COUNTRY")
            .agg(F.grouping_id().alias("LEVEL"),
                 F.sum(arr).alias(MARKET_ARR),
                 F.sum(arr.cast("decimal(38,0)") * arr).alias("_sq"))
            .withColumn("COLOR_VALUE", pandas_div(F.col("_sq").cast("double"), _q(MARKET_ARR)))
            .drop("_sq"))


# Funnel stage names and the outbound columns they sum.
FUNNEL_STAGES = (
    ("Contacts Touched", "NB_CONTACTS_TOUCHED"),
    ("Companies Touched", "NB_COMPANIES_TOUCHED"),
    ("ICP Companies Touched", "NB_COMPANIES_TOUCHED_ICP"),
    ("ICP Companies Clicked", "NB_COMPANIES_CLICKED_ICP"),
    ("ICP Companies Replied", "NB_COMPANIES_REPLIED_ICP"),
    ("ICP Positive Replies", "NB_COMPANIES_REPLIED_POSITIVE_ICP"),
)


def outbound_funnel(outbound: DataFrame) -> DataFrame:
    """Six global sums as (STAGE_ORDER, STAGE, COUNT) rows: one aggregate
    pass, then the single row is unfolded."""
    sums = outbound.agg(*[F.coalesce(F.sum(_q(c)), F.lit(0)).cast("bigint").alias(f"s{i}")
                          for i, (_, c) in enumerate(FUNNEL_STAGES)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("STAGE_ORDER"), F.lit(name).alias("STAGE"),
                              F.col(f"s{i}").alias("COUNT"))
                     for i, (name, _) in enumerate(FUNNEL_STAGES)])
    return sums.select(F.inline(rows))


def tam_contribution(outbound: DataFrame, market: DataFrame) -> DataFrame:
    """Outbound ARR as a percent of the addressable-market ARR."""
    tam = tam_scope(market).select(F.coalesce(F.sum(_q(MARKET_ARR)), F.lit(0))).scalar()
    ob = outbound.agg(F.coalesce(F.sum(_q(ARR)), F.lit(0)).alias("OUTBOUND_ARR"))
    pct = pandas_div(F.col("OUTBOUND_ARR"), tam) * 100
    return ob.select("OUTBOUND_ARR", tam.alias("POTENTIAL_ARR"), pct.alias("CONTRIBUTION_PERCENT"),
                     F.concat(F.lit(TEXT_OUTBOUND_ARR), money_text("OUTBOUND_ARR"))
                     .alias("OUTBOUND_ARR_TEXT"),
                     F.concat(F.lit(TEXT_TAM), money_text(tam)).alias("TAM_TEXT"),
                     _fill(TEXT_CONTRIBUTION, fixed_text(pct, 2)).alias("CONTRIBUTION_TEXT"))


ICP_RATES = (
    ("ICP_click_through_rate", "NB_COMPANIES_CLICKED_ICP"),
    ("ICP_reply_rate", "NB_COMPANIES_REPLIED_ICP"),
    ("ICP_positive_reply_rate", "NB_COMPANIES_REPLIED_POSITIVE_ICP"),
)


def icp_rates(outbound: DataFrame) -> DataFrame:
    """Per-campaign ICP ratios with pandas division (0/0 NULL, n/0 inf)."""
    return outbound.withColumns({name: pandas_div(_q(num), _q("NB_COMPANIES_TOUCHED_ICP"))
                                 for name, num in ICP_RATES})


def icp_avg_rates(outbound: DataFrame, decimals: int | None = None) -> DataFrame:
    """Unweighted means of the three ratios (NULL skipped, inf propagates).
    A float mean depends on the order of addition; ``decimals`` rounds it
    for reproducible output."""
    r = icp_rates(outbound)
    out = r.agg(*[F.avg(name).alias(f"avg_{name}") for name, _ in ICP_RATES])
    if decimals is not None:
        out = out.select(*[F.round(c, decimals).alias(c) for c in out.columns])
    return out


def icp_share(outbound: DataFrame) -> DataFrame:
    """ICP companies touched / all companies touched (a rate, not x100)."""
    agg = outbound.agg(F.coalesce(F.sum("NB_COMPANIES_TOUCHED_ICP"), F.lit(0)).alias("ICP_TOUCHED"),
                       F.coalesce(F.sum("NB_COMPANIES_TOUCHED"), F.lit(0)).alias("TOUCHED"))
    return agg.withColumn("ICP_SHARE", pandas_div("ICP_TOUCHED", "TOUCHED"))


# Rule thresholds and message texts of the limitations summary.
LIMIT_CTR = 0.2
LIMIT_REPLY = 0.1
LIMIT_POSITIVE = 0.05
LIMIT_ICP_CONTACTED = 1000
MSG_CTR = "    \n- Low click-through rate for ICP contacts. ({pct}%)"
MSG_REPLY = "    \n- Low reply rate from ICP contacts. ({pct}%)"
MSG_POSITIVE = "    \n- Low positive reply rate from ICP contacts. ({pct}%)"
MSG_ICP = "Limited ICP data – not enough ICP companies are being contacted."
MSG_HEAD = "\nOutbound is facing the following limitations:\n"
MSG_OK = "Outbound is performing well with respect to ICP conversion rates."


def outbound_limitations(outbound: DataFrame) -> DataFrame:
    """One row: the three average ICP rates, ICP companies contacted, the
    list of triggered rule messages and the final summary text."""
    r = icp_rates(outbound)
    agg = r.agg(*[F.avg(name).alias(f"avg_{name}") for name, _ in ICP_RATES],
                F.coalesce(F.sum("NB_COMPANIES_TOUCHED_ICP"), F.lit(0)).alias("ICP_CONTACTED"))
    ctr, rep, pos = (F.col(f"avg_{n}") for n, _ in ICP_RATES)
    msgs = F.array_compact(F.array(
        F.when(ctr < LIMIT_CTR, _fill(MSG_CTR, fixed_text(ctr, 2))),
        F.when(rep < LIMIT_REPLY, _fill(MSG_REPLY, fixed_text(rep, 2))),
        F.when(pos < LIMIT_POSITIVE, _fill(MSG_POSITIVE, fixed_text(pos, 2))),
        F.when(F.col("ICP_CONTACTED") < LIMIT_ICP_CONTACTED, F.lit(MSG_ICP))))
    text = F.when(F.size(msgs) > 0, F.concat(F.lit(MSG_HEAD), F.array_join(msgs, "\n"))) \
        .otherwise(F.lit(MSG_OK))
    return agg.select("*", msgs.alias("LIMITATIONS"),
                      F.size(msgs).cast("bigint").alias("NUM_LIMITATIONS"), text.alias("MESSAGE"))
