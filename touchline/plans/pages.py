"""Page-level query sets: each returns a dict of named DataFrames (the data
behind every table and chart of one page).  Choices made with widgets in
the source become arguments."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from touchline.operators import profile, projections, reports, sizing
from touchline.operators.cleaning import clean
from touchline.functions.text import money, to_number
from touchline.operators.filters import optional_filters, require_columns, require_rows

OUTBOUND_METRIC = "NB_CONTACTS_TOUCHED"


def attribution_page(marts: dict[str, DataFrame], source: str | None = None) -> dict:
    model = marts["attribution_model_90"]
    cjm = marts["attribution_cjm"]
    return {
        "orders_by_month_chart": reports.orders_by_month_chart(marts["orders_month_store"]),
        "source_share": reports.source_share(model),
        "source_edges": reports.source_edges(model),
        "monthly_by_source": reports.monthly_by_source(model),
        "referrer_contribution": reports.referrer_contribution(model, n=10),
        "touch_step_orders": reports.step_orders(cjm),
        "touch_funnel": reports.touch_funnel(cjm, [source] if source else None),
    }


def outbound_frame(outbound: DataFrame) -> DataFrame:
    """Cleaned campaigns with CAMPAIGN_LENGTH after the last-date column."""
    df = projections.drop_if_present(clean(outbound), "CAMPAIGN_LENGTH")
    return projections.with_campaign_length(df)


def outbound_profile(outbound: DataFrame, group: str = "All",
                     metric: str = OUTBOUND_METRIC) -> dict:
    df = outbound_frame(outbound)
    table = projections.drop_last(optional_filters(df, eq={"CAMPAIGN_GROUP": group}), 3)
    return {
        "table": table,
        "describe": profile.describe(table),
        "unique_counts": profile.unique_counts(table),
        "metric_by_campaign": profile.sum_by(df, "CAMPAIGN_GROUP", metric, descending=True),
        "campaign_spans": projections.campaign_spans(df, metric),
        "length_scatter": projections.scatter_pairs(
            df, "CAMPAIGN_LENGTH", metric, "CAMPAIGN_GROUP",
            hover=("CAMPAIGN_START_DATE", "CAMPAIGN_LAST_DATE")),
        "metric_by_start_month": profile.metric_by_start_month(df, metric),
    }


def market_frame(market: DataFrame, platform: str = "All",
                 categories: Iterable[str] | None = None, country: str = "All") -> DataFrame:
    """Cleaned market rows under the page filters.  ``categories=None`` is
    the default selection (every non-null class), so NULL classes drop."""
    df = clean(market)
    if categories is None:
        # default selection = every non-null class; no need to list them
        df = df.filter(df["GMV_CATEGORY"].isNotNull())
        return optional_filters(df, eq={"PLATFORM": platform, "COUNTRY": country})
    return optional_filters(df, eq={"PLATFORM": platform, "COUNTRY": country},
                            isin={"GMV_CATEGORY": list(categories)})


def with_money_columns(df: DataFrame, cols: Iterable[str] = ("TOTAL_GMV", "AVG_GMV")) -> DataFrame:
    """Currency text -> number for the GMV columns, as the market page does
    before summing and plotting; columns that are numbers stay as they are."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    return df.withColumns({c: money(df[c]) for c in cols if c in text})


def market_profile(market: DataFrame, platform: str = "All",
                   categories: Iterable[str] | None = None, country: str = "All",
                   log: bool = False) -> dict:
    require_columns(market, ("PLATFORM", "GMV_CATEGORY", "COUNTRY", "TOTAL_GMV", "AVG_GMV",
                             "NB_DOMAINS"))
    df = with_money_columns(market_frame(require_rows(market), platform, categories, country))
    by_platform = optional_filters(df, eq={"PLATFORM": platform})
    return {
        "table": df,
        "describe": profile.describe(df),
        "unique_counts": profile.unique_counts(df),
        "gmv_by_category": profile.sum_by(df, "GMV_CATEGORY", "TOTAL_GMV"),
        "box_stats": profile.box_stats(df, "GMV_CATEGORY", "AVG_GMV", log=log),
        "domains_scatter": projections.scatter_pairs(
            df.withColumn("NB_DOMAINS", to_number("NB_DOMAINS")), "NB_DOMAINS", "TOTAL_GMV",
            "GMV_CATEGORY"),
        "top_platforms": profile.top_n_by_sum(df, "PLATFORM", "TOTAL_GMV", 10),
        "top_countries": profile.top_n_by_sum(by_platform, "COUNTRY", "TOTAL_GMV", 10),
    }


def tenants_profile(tenants: DataFrame) -> dict:
    require_columns(tenants, ("TENANT_ID", "DATASOURCE_ID"))
    require_rows(tenants)
    return {
        "preview": profile.preview(tenants, 5),
        "unique_counts": profile.unique_counts(tenants),
        "tenant_stores": profile.top_n_distinct(tenants, "TENANT_ID", "DATASOURCE_ID", 10),
    }


def sizing_page(outbound: DataFrame, market: DataFrame,
                         country: str = "NATION_0") -> dict:
    ob = clean(outbound)
    mk = clean(market)
    labelled = sizing.pareto(ob.select("CAMPAIGN_GROUP", sizing.ARR))
    return {
        "pareto": labelled,
        "pareto_summary": sizing.pareto_summary(labelled),
        "tam_rollup": sizing.tam_rollup(mk),
        "tam_share": sizing.tam_share(mk, country),
        "outbound_funnel": sizing.outbound_funnel(ob),
        "tam_contribution": sizing.tam_contribution(ob, mk),
        "icp_rates": sizing.icp_rates(ob),
        "icp_avg_rates": sizing.icp_avg_rates(ob),
        "icp_share": sizing.icp_share(ob),
        "outbound_limitations": sizing.outbound_limitations(ob),
    }


def page_summary(page: dict[str, DataFrame], totals: dict[str, str] | None = None) -> DataFrame:
    """One row per part of a page: ``MEMBER``, ``ROW_COUNT`` and ``TOTAL``, the
    sum of the part's column in ``totals`` (NULL without one)."""
    out = None
    for name, df in page.items():
        col = (totals or {}).get(name)
        total = F.sum(F.col(f"`{col}`")).cast("bigint") if col else F.lit(None).cast("bigint")
        row = df.agg(F.count(F.lit(1)).alias("ROW_COUNT"), total.alias("TOTAL")).select(
            F.lit(name).alias("MEMBER"), "ROW_COUNT", "TOTAL")
        out = row if out is None else out.unionByName(row)
    return out
