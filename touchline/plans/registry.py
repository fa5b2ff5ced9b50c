"""Named queries: each takes (spark, sf_dir) and returns a DataFrame over
the whole shared tables.  ``__spark_entry__`` exposes this registry."""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions.text import to_number
from touchline.operators import attribution as att
from touchline.operators import profile, projections, reports, sizing
from touchline.operators.cleaning import clean
from touchline.operators.joins import lookback_join, with_brand
from touchline.operators.sequence import running_in_order
from touchline.plans import inputs, pages
from touchline.plans.marts import MaintainedModel, build_marts, write_marts
from touchline.session import ensure_checkpoint_dir
from touchline.sources.events import event_table, read_events
from touchline.sources.profiled import clean_staged, stage_profiled
from touchline.sources.tables import read_table

ONE_GROUP = "Brand#11/SMALL"
TWO_CATEGORIES = ("a) < $1M", "c) > $3M")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# --- attribution (event log) -------------------------------------------------

@register("orders_per_month_store")
def q_orders_per_month_store(spark, sf_dir):
    return att.orders_per_month_store(inputs.events(spark, sf_dir))


@register("attribution_report")
def q_attribution_report(spark, sf_dir):
    return att.attribution_report(att.last_touch(inputs.events(spark, sf_dir), days=90))


@register("attribution_report_180")
def q_attribution_report_180(spark, sf_dir):
    return att.attribution_report(att.last_touch(inputs.events(spark, sf_dir), days=180))


@register("last_touch")
def q_last_touch(spark, sf_dir):
    lt = att.last_touch(inputs.events(spark, sf_dir), days=90)
    return lt.withColumn("shopifyOrderTotalPrice", F.col("shopifyOrderTotalPrice").cast("double"))


@register("touch_journey")
def q_touch_journey(spark, sf_dir):
    """Steps are in the rows; ``ordered=True`` would add a sort of all pairs."""
    return att.touch_journey(inputs.events(spark, sf_dir), ordered=False)


@register("attribution_lookback_user_3d")
def q_attribution_lookback_user_3d(spark, sf_dir):
    """Last touch by user identity inside a 3-day lookback (range join)."""
    ev = inputs.events(spark, sf_dir)
    return att.attribution_report(att.last_touch(ev, days=3, keys=att.KEYS_IDENTITY))


@register("lookback_pairs")
def q_lookback_pairs(spark, sf_dir):
    """Purchases x events of the same user within the 3 days before the
    purchase (full-precision timestamps)."""
    ev = read_table(spark, sf_dir, "events")
    o = ev.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("ORDER_EVENT_ID"), F.col("user_id").alias("USER_ID"),
        F.col("ts").alias("o_ts"))
    t = ev.select(F.col("event_id").alias("TOUCH_EVENT_ID"), F.col("user_id").alias("t_user"),
                  F.col("ts").alias("t_ts"))
    pairs = lookback_join(o, t, [("USER_ID", "t_user")], "o_ts", "t_ts", 3)
    return pairs.select("ORDER_EVENT_ID", "TOUCH_EVENT_ID", "USER_ID")


# --- attribution page (over the marts) ---------------------------------------

def _model_90(spark, sf_dir):
    return att.attribution_report(att.last_touch(inputs.events(spark, sf_dir), days=90),
                                  ordered=False)


def _cjm(spark, sf_dir):
    return att.touch_journey(inputs.events(spark, sf_dir), ordered=False)


@register("source_share")
def q_source_share(spark, sf_dir):
    return reports.source_share(_model_90(spark, sf_dir))


@register("monthly_by_source")
def q_monthly_by_source(spark, sf_dir):
    return reports.monthly_by_source(_model_90(spark, sf_dir))


@register("referrer_contribution")
def q_referrer_contribution(spark, sf_dir):
    return reports.referrer_contribution(_model_90(spark, sf_dir))


@register("source_edges")
def q_source_edges(spark, sf_dir):
    return reports.source_edges(_model_90(spark, sf_dir))


@register("touch_step_orders")
def q_touch_step_orders(spark, sf_dir):
    """Counted per (ip, time): no row per order and touch."""
    counts = att.step_counts(inputs.events(spark, sf_dir))
    return counts.filter(F.col("ATTRIBUTION_SOURCE").isNotNull())


@register("touch_funnel")
def q_touch_funnel(spark, sf_dir):
    """Steps under ten only, counted without the journey's pairs."""
    return reports.funnel_of_counts(att.step_counts(inputs.events(spark, sf_dir), below=10))


@register("journey_lookback")
def q_journey_lookback(spark, sf_dir):
    """The journey by user identity, with match type and both lookback flags."""
    pairs = att.journey(inputs.events(spark, sf_dir), keys=att.KEYS_IDENTITY, days=3)
    return pairs.select(F.col("order_id").alias("ORDER_ID"), F.col("o_event_id").alias("ORDER_EVENT_ID"),
                        F.col("t_event_id").alias("TOUCH_EVENT_ID"),
                        F.col("attribution_source").alias("ATTRIBUTION_SOURCE"),
                        F.col("match_type").alias("MATCH_TYPE"),
                        F.col("is_within_lookback").alias("IS_WITHIN_LOOKBACK"))


def _marketing_touch(days: int) -> Query:
    def query(spark, sf_dir):
        """Last touch with a campaign source before the order, by user: rare
        enough that the window decides."""
        last = att.last_touch(inputs.events(spark, sf_dir), days=days, keys=att.KEYS_IDENTITY,
                              strict=True, touches=F.col("utmSource").isNotNull())
        return att.attribution_report(last)
    return query


for _days in (3, 10, 25):
    register(f"attribution_marketing_touch_{_days}d")(_marketing_touch(_days))


@register("attribution_brand")
def q_attribution_brand(spark, sf_dir):
    return with_brand(_model_90(spark, sf_dir), inputs.store_tenants(spark, sf_dir))


@register("referrer_top10")
def q_referrer_top10(spark, sf_dir):
    return reports.referrer_contribution(_model_90(spark, sf_dir), n=10)


@register("orders_by_month_chart")
def q_orders_by_month_chart(spark, sf_dir):
    return reports.orders_by_month_chart(
        att.orders_per_month_store(inputs.events(spark, sf_dir), ordered=False))


def _numbered(df: DataFrame, *order) -> DataFrame:
    """Rows with their place in the stated order."""
    return running_in_order(df, order, out="POSITION") \
        .withColumn("POSITION", F.col("POSITION").cast("bigint"))


@register("orders_per_month_ordered")
def q_orders_per_month_ordered(spark, sf_dir):
    mart = att.orders_per_month_store(inputs.events(spark, sf_dir), ordered=False)
    return _numbered(mart, "STORE", "MONTH")


@register("attribution_report_ordered")
def q_attribution_report_ordered(spark, sf_dir):
    return _numbered(_model_90(spark, sf_dir), "STORE", "MONTH", ("ATTRIBUTED_ORDERS", "desc"),
                     "ATTRIBUTION_SOURCE", "PAGEREFERRER", "MEDIUM", "CAMPAIGN")


def _scratch(spark, name: str) -> str:
    """A new folder on the shared storage."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _written_log(spark, sf_dir, keep=None) -> str:
    """The log as files of JSON lines."""
    log = inputs.event_log(spark, sf_dir)
    path = _scratch(spark, "log")
    (log if keep is None else log.filter(keep)).write.text(path)
    return path


@register("orders_per_month_from_files")
def q_orders_per_month_from_files(spark, sf_dir):
    """The log written as JSON lines and read back by the log reader."""
    return att.orders_per_month_store(event_table(read_events(spark, _written_log(spark, sf_dir))), ordered=False)


def _written_arrays(spark, sf_dir) -> str:
    """The log as files of JSON arrays: one array per partition of the log."""
    place = Window.partitionBy("part").orderBy("DATA")
    log = inputs.event_log(spark, sf_dir).withColumn("part", F.spark_partition_id()) \
        .withColumn("n", F.row_number().over(place)).withColumn("last", F.count("*").over(Window.partitionBy("part")))
    text = F.concat(F.when(F.col("n") == 1, "[").otherwise(","), "DATA",
                    F.when(F.col("n") == F.col("last"), "]").otherwise(""))
    path = _scratch(spark, "arrays")
    log.repartition("part").sortWithinPartitions("part", "n").select(text).write.text(path)
    return path


@register("orders_per_month_from_arrays")
def q_orders_per_month_from_arrays(spark, sf_dir):
    """The log written as JSON arrays and read back, each file by byte ranges."""
    log = read_events(spark, _written_arrays(spark, sf_dir), fmt="array")
    return att.orders_per_month_store(event_table(log), ordered=False)


@register("attribution_model_maintained")
def q_attribution_model_maintained(spark, sf_dir):
    """The 90-day mart kept from two parts of the log that share keys and
    orders: each part read from files, states merged, mart published and read."""
    mart = MaintainedModel(spark, _scratch(spark, "model"))
    odd = F.get_json_object("DATA", "$.event_id").cast("bigint") % 2 == 1
    for part in (odd, ~F.coalesce(odd, F.lit(False))):
        mart.add(event_table(read_events(spark, _written_log(spark, sf_dir, part))))
    return mart.refresh()


@register("source_share_from_marts")
def q_source_share_from_marts(spark, sf_dir):
    """The marts built, written and read again; the page's shares from them."""
    base = _scratch(spark, "marts")
    marts = build_marts(inputs.events(spark, sf_dir), (90,), stage_dir=f"{base}/events")
    paths = write_marts({"attribution_model_90": marts["attribution_model_90"]}, base)
    return reports.source_share(spark.read.parquet(paths["attribution_model_90"]))


# --- outbound sizing page -------------------------------------------------------

def _ob(spark, sf_dir):
    return clean(inputs.outbound(spark, sf_dir))


def _mk(spark, sf_dir):
    return clean(inputs.market(spark, sf_dir))


def _pareto(spark, sf_dir):
    # only the two columns the ranking needs go into its checkpoint
    return sizing.pareto(_ob(spark, sf_dir).select("CAMPAIGN_GROUP", sizing.ARR))


@register("pareto")
def q_pareto(spark, sf_dir):
    return _pareto(spark, sf_dir).select(
        "CAMPAIGN_GROUP", sizing.ARR, "CUMULATIVE_NEW_ARR", "COLOR_LABEL")


@register("pareto_summary")
def q_pareto_summary(spark, sf_dir):
    return sizing.pareto_summary(_pareto(spark, sf_dir))


@register("tam_rollup")
def q_tam_rollup(spark, sf_dir):
    return sizing.tam_rollup(_mk(spark, sf_dir))


@register("tam_share")
def q_tam_share(spark, sf_dir):
    return sizing.tam_share(_mk(spark, sf_dir), "NATION_0")


@register("outbound_funnel")
def q_outbound_funnel(spark, sf_dir):
    return sizing.outbound_funnel(_ob(spark, sf_dir))


@register("tam_contribution")
def q_tam_contribution(spark, sf_dir):
    return sizing.tam_contribution(_ob(spark, sf_dir), _mk(spark, sf_dir))


@register("icp_rates")
def q_icp_rates(spark, sf_dir):
    return sizing.icp_rates(_ob(spark, sf_dir)).select(
        "CAMPAIGN_GROUP", *[n for n, _ in sizing.ICP_RATES])


@register("icp_avg_rates")
def q_icp_avg_rates(spark, sf_dir):
    return sizing.icp_avg_rates(_ob(spark, sf_dir), decimals=9)


@register("icp_share")
def q_icp_share(spark, sf_dir):
    return sizing.icp_share(_ob(spark, sf_dir))


@register("outbound_limitations")
def q_outbound_limitations(spark, sf_dir):
    return sizing.outbound_limitations(_ob(spark, sf_dir)).select(
        "ICP_CONTACTED", "NUM_LIMITATIONS", "MESSAGE")


# --- outbound profile page --------------------------------------------------------

def _ob_frame(spark, sf_dir):
    return pages.outbound_frame(inputs.outbound(spark, sf_dir))


@register("outbound_table")
def q_outbound_table(spark, sf_dir):
    return projections.drop_last(_ob_frame(spark, sf_dir), 3)


@register("describe_outbound")
def q_describe_outbound(spark, sf_dir):
    return profile.describe(projections.drop_last(_ob_frame(spark, sf_dir), 3), decimals=6)


@register("unique_counts_outbound")
def q_unique_counts_outbound(spark, sf_dir):
    return profile.unique_counts(projections.drop_last(_ob_frame(spark, sf_dir), 3))


@register("metric_by_campaign")
def q_metric_by_campaign(spark, sf_dir):
    return profile.sum_by(_ob_frame(spark, sf_dir), "CAMPAIGN_GROUP", pages.OUTBOUND_METRIC,
                          descending=True)


@register("campaign_spans")
def q_campaign_spans(spark, sf_dir):
    return projections.campaign_spans(_ob_frame(spark, sf_dir), pages.OUTBOUND_METRIC) \
        .drop("START", "END")


@register("campaign_spans_dotted")
def q_campaign_spans_dotted(spark, sf_dir):
    return projections.campaign_spans(_ob_frame(spark, sf_dir), "NB_COMPANIES_REPLIED_ICP.1") \
        .drop("START", "END")


@register("metric_by_campaign_dotted")
def q_metric_by_campaign_dotted(spark, sf_dir):
    df = profile.sum_by(_ob_frame(spark, sf_dir), "CAMPAIGN_GROUP", "NB_COMPANIES_CLICKED_ICP.1")
    return df.toDF("CAMPAIGN_GROUP", "CLICKED_ICP")


@register("metric_by_campaign_ordered")
def q_metric_by_campaign_ordered(spark, sf_dir):
    df = profile.sum_by(_ob_frame(spark, sf_dir), "CAMPAIGN_GROUP", pages.OUTBOUND_METRIC)
    return _numbered(df, (pages.OUTBOUND_METRIC, "desc"), "CAMPAIGN_GROUP")


@register("describe_outbound_full")
def q_describe_outbound_full(spark, sf_dir):
    return profile.describe(_ob_frame(spark, sf_dir), decimals=6)


@register("outbound_one_group")
def q_outbound_one_group(spark, sf_dir):
    """The page's table under its campaign group filter."""
    return pages.outbound_profile(inputs.outbound(spark, sf_dir), group=ONE_GROUP)["table"]


@register("clean_lenient")
def q_clean_lenient(spark, sf_dir):
    return clean(inputs.outbound_text(spark, sf_dir, dirty=True), strict=False)


@register("clean_from_staged")
def q_clean_from_staged(spark, sf_dir):
    """The text export staged with its profile in one pass, then cleaned by the profile."""
    path = _scratch(spark, "profiled")
    stage_profiled(inputs.outbound_text(spark, sf_dir, dirty=True), path)
    return clean_staged(spark, path, strict=False)


@register("clean_strict")
def q_clean_strict(spark, sf_dir):
    return clean(inputs.outbound_text(spark, sf_dir, dirty=False), strict=True,
                 date_columns=["CAMPAIGN_START_DATE"])


@register("length_scatter")
def q_length_scatter(spark, sf_dir):
    return projections.scatter_pairs(_ob_frame(spark, sf_dir), "CAMPAIGN_LENGTH",
                                     pages.OUTBOUND_METRIC, "CAMPAIGN_GROUP")


@register("metric_by_start_month")
def q_metric_by_start_month(spark, sf_dir):
    return profile.metric_by_start_month(_ob_frame(spark, sf_dir), pages.OUTBOUND_METRIC)


# --- market profile page ------------------------------------------------------------

def _mk_frame(spark, sf_dir):
    return pages.market_frame(inputs.market(spark, sf_dir))


@register("describe")
def q_describe(spark, sf_dir):
    return profile.describe(_mk_frame(spark, sf_dir), decimals=6)


@register("unique_counts")
def q_unique_counts(spark, sf_dir):
    return profile.unique_counts(_mk_frame(spark, sf_dir))


@register("market_table")
def q_market_table(spark, sf_dir):
    return _mk_frame(spark, sf_dir)


@register("gmv_by_category")
def q_gmv_by_category(spark, sf_dir):
    df = pages.with_money_columns(_mk_frame(spark, sf_dir))
    return profile.sum_by(df, "GMV_CATEGORY", "TOTAL_GMV")


@register("gmv_two_categories")
def q_gmv_two_categories(spark, sf_dir):
    """The category selection of the market page."""
    df = pages.market_frame(inputs.market(spark, sf_dir), categories=TWO_CATEGORIES)
    return profile.sum_by(df, "GMV_CATEGORY", "TOTAL_GMV")


@register("box_stats")
def q_box_stats(spark, sf_dir):
    df = pages.with_money_columns(_mk_frame(spark, sf_dir))
    return profile.box_stats(df, "GMV_CATEGORY", "AVG_GMV")


@register("box_stats_log")
def q_box_stats_log(spark, sf_dir):
    df = pages.with_money_columns(_mk_frame(spark, sf_dir))
    return profile.box_stats(df, "GMV_CATEGORY", "AVG_GMV", log=True, decimals=9)


@register("domains_scatter")
def q_domains_scatter(spark, sf_dir):
    df = pages.with_money_columns(_mk_frame(spark, sf_dir))
    df = df.withColumn("NB_DOMAINS", to_number("NB_DOMAINS"))
    return projections.scatter_pairs(df, "NB_DOMAINS", "TOTAL_GMV", "GMV_CATEGORY")


@register("top_platforms")
def q_top_platforms(spark, sf_dir):
    return profile.top_n_by_sum(_mk_frame(spark, sf_dir), "PLATFORM", "TOTAL_GMV", 10)


@register("top_countries")
def q_top_countries(spark, sf_dir):
    return profile.top_n_by_sum(_mk_frame(spark, sf_dir), "COUNTRY", "TOTAL_GMV", 10)


@register("top_countries_shopify")
def q_top_countries_shopify(spark, sf_dir):
    df = pages.market_frame(inputs.market(spark, sf_dir), platform="Shopify")
    return profile.top_n_by_sum(df, "COUNTRY", "TOTAL_GMV", 10)


@register("distinct_countries")
def q_distinct_countries(spark, sf_dir):
    return profile.distinct_values(_mk(spark, sf_dir), "COUNTRY")


# --- tenants page ---------------------------------------------------------------------

@register("tenants_preview")
def q_tenants_preview(spark, sf_dir):
    return profile.preview(inputs.tenants(spark, sf_dir), 5)


@register("unique_counts_tenants")
def q_unique_counts_tenants(spark, sf_dir):
    return profile.unique_counts(inputs.tenants(spark, sf_dir))


@register("tenant_stores")
def q_tenant_stores(spark, sf_dir):
    return profile.top_n_distinct(inputs.tenants(spark, sf_dir), "TENANT_ID", "DATASOURCE_ID", 10)


# --- whole pages ------------------------------------------------------------------------

# Per page: its parts, each with the query that gives the same rows and an integer column.
PAGE_PARTS = {
    "attribution_page": {
        "orders_by_month_chart": ("orders_by_month_chart", "ORDER_COUNT"),
        "source_share": ("source_share", "ATTRIBUTED_ORDERS"),
        "source_edges": ("source_edges", "VALUE"),
        "monthly_by_source": ("monthly_by_source", "ATTRIBUTED_ORDERS"),
        "referrer_contribution": ("referrer_top10", "total_orders"),
        "touch_step_orders": ("touch_step_orders", "ORDER_COUNT"),
        "touch_funnel": ("touch_funnel", "ORDER_COUNT"),
    },
    "sizing_page": {
        "pareto": ("pareto", sizing.ARR), "pareto_summary": ("pareto_summary", None),
        "tam_rollup": ("tam_rollup", None), "tam_share": ("tam_share", None),
        "outbound_funnel": ("outbound_funnel", None), "tam_contribution": ("tam_contribution", None),
        "icp_rates": ("icp_rates", None), "icp_avg_rates": ("icp_avg_rates", None),
        "icp_share": ("icp_share", None), "outbound_limitations": ("outbound_limitations", "NUM_LIMITATIONS"),
    },
    "market_page": {
        "table": ("market_table", None), "describe": ("describe", None), "unique_counts": ("unique_counts", None),
        "gmv_by_category": ("gmv_by_category", "TOTAL_GMV"), "box_stats": ("box_stats", "count"),
        "domains_scatter": ("domains_scatter", None), "top_platforms": ("top_platforms", "TOTAL_GMV"),
        "top_countries": ("top_countries", "TOTAL_GMV"),
    },
    "tenants_page": {
        "preview": ("tenants_preview", None), "unique_counts": ("unique_counts_tenants", None),
        "tenant_stores": ("tenant_stores", "DATASOURCE_ID"),
    },
}


def _summary(page: str, parts: dict[str, DataFrame]) -> DataFrame:
    totals = {name: col for name, (_, col) in PAGE_PARTS[page].items() if col}
    return pages.page_summary(parts, totals)


@register("attribution_page")
def q_attribution_page(spark, sf_dir):
    """The page over the marts: built from one parse of the log, written, read again."""
    base = _scratch(spark, "page")
    paths = write_marts(build_marts(inputs.events(spark, sf_dir), (90,), stage_dir=f"{base}/events"), base)
    marts = {name: spark.read.parquet(path) for name, path in paths.items()}
    return _summary("attribution_page", pages.attribution_page(marts))


@register("sizing_page")
def q_sizing_page(spark, sf_dir):
    return _summary("sizing_page", pages.sizing_page(inputs.outbound(spark, sf_dir), inputs.market(spark, sf_dir)))


@register("market_page")
def q_market_page(spark, sf_dir):
    return _summary("market_page", pages.market_profile(inputs.market(spark, sf_dir)))


@register("tenants_page")
def q_tenants_page(spark, sf_dir):
    return _summary("tenants_page", pages.tenants_profile(inputs.tenants(spark, sf_dir)))
