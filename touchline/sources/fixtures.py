"""The four source datasets (event log, campaigns, market, tenants) derived
from the shared test tables, as specified in FIXTURES.md.

All are pure DataFrame transformations of the given tables, so their size
grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.text import epoch_seconds
from touchline.sources.tables import read_table

# Fixed values used to shape the event log (FIXTURES.md §1).
ORDER_DATE_ORIGIN = "2022-10-01"
ORDER_DATE_SPAN_DAYS = 270
REFERRER_GOOGLE = "https://www.google.com/search"
REFERRER_FACEBOOK = "https://l.facebook.com/"
REFERRER_INSTAGRAM = "https://instagram.com/"
REFERRER_OWN_SHOP = "https://shop.example/p"

# Fixed values for the market table (FIXTURES.md §3).
GMV_CLASSES = ("a) < $1M", "b) $1M - $3M", "c) > $3M")
ARR_COLUMN = "POLAR ARR ($)"

# Campaign columns that the export holds twice.
REPEATED_COLUMNS = ("NB_COMPANIES_CLICKED_ICP", "NB_COMPANIES_REPLIED_ICP",
                    "NB_COMPANIES_REPLIED_POSITIVE_ICP")


def pixel_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat typed event log (one row per event, FIXTURES.md §1)."""
    ev = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    secs = epoch_seconds(F.col("ts"), ev.schema["ts"].dataType)
    b = ev.select(
        "event_id", "event_type", "value",
        (F.floor(secs / 3600) * 3600).cast("bigint").alias("t"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("u"),
        F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("shop"),
        F.concat(F.lit("ip"), F.expr("user_id div 7").cast("string")).alias("ip"),
        k.alias("k"),
    )
    purchase = F.col("event_type") == "purchase"
    k = F.col("k")
    referrer = (F.when(k < 30, F.lit(None).cast("string"))
                .when(k < 35, F.lit(""))
                .when(k < 50, F.lit(REFERRER_GOOGLE))
                .when(k < 60, F.lit(REFERRER_FACEBOOK))
                .when(k < 65, F.lit(REFERRER_INSTAGRAM))
                .otherwise(F.concat(F.lit(REFERRER_OWN_SHOP), (k % 7).cast("string"))))
    return b.select(
        "event_id",
        F.col("t").alias("timestamp"),
        F.col("u").alias("userId"),
        F.col("shop").alias("shopifyShopURL"),
        "ip",
        F.when(purchase, F.concat(F.lit("o"), F.expr("event_id div 8").cast("string")))
         .alias("shopifyOrderId"),
        F.when(purchase, F.col("value")).alias("shopifyOrderTotalPrice"),
        F.date_add(F.lit(ORDER_DATE_ORIGIN).cast("date"),
                   (F.col("event_id") % ORDER_DATE_SPAN_DAYS).cast("int"))
         .alias("shopifyOrderProcessedAt"),
        F.when(purchase | ((F.col("event_type") == "view") & (k >= 90)), F.lit("thank_you"))
         .otherwise(F.lit("product")).alias("shopifyPageType"),
        referrer.alias("pageReferrer"),
        F.when(k % 10 == 3, F.lit("attentive")).alias("utmSource"),
        F.when(k % 4 == 0, F.lit("email")).alias("utmMedium"),
        F.when(k % 6 == 0, F.concat(F.lit("c"), (k % 3).cast("string"))).alias("utmCampaign"),
    )


def pixel_log(spark: SparkSession, sf_dir: str, json_col: str = "DATA") -> DataFrame:
    """The event log as the source stores it: one JSON document per row."""
    flat = pixel_flat(spark, sf_dir)
    return flat.select(F.to_json(F.struct(*flat.columns)).alias(json_col))


def outbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign table (FIXTURES.md §2): one row per brand/type group.

    The five distinct counts share one key (the order), so they are taken
    in two plain aggregations -- per (campaign, order), then per campaign --
    instead of five distinct aggregates (which Spark would expand 6x).
    The ICP thresholds are nested, so "some ICP line with qty >= x" is
    "max ICP qty >= x".
    """
    li = read_table(spark, sf_dir, "lineitem")
    part = read_table(spark, sf_dir, "part")
    icp = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)
    j = li.join(part, li.l_partkey == part.p_partkey)
    qty = F.col("l_quantity")
    per_order = (j.groupBy(F.concat(F.col("p_brand"), F.lit("/"), F.col("p_type"))
                           .alias("CAMPAIGN_GROUP"), "l_orderkey")
                 .agg(F.min("l_shipdate").alias("d0"), F.max("l_shipdate").alias("d1"),
                      F.count(F.lit(1)).alias("lines"), F.sum("l_linenumber").alias("mails"),
                      F.count_if(qty >= 25).alias("clicks"),
                      F.count_if(F.col("l_returnflag") == "A").alias("positive"),
                      F.count_if(F.col("l_returnflag") == "N").alias("negative"),
                      F.max(qty).alias("top_qty"), F.max(F.when(icp, qty)).alias("icp_qty"),
                      F.sum(F.floor("l_extendedprice").cast("bigint")).alias("price"),
                      F.sum(F.floor(qty).cast("bigint")).alias("qty")))

    def orders_from(col, least):
        return F.count_if(F.col(col) >= least)

    total = lambda c: F.sum(c).cast("bigint")
    out = (per_order.groupBy("CAMPAIGN_GROUP")
           .agg(F.to_date(F.min("d0")).alias("CAMPAIGN_START_DATE"),
                F.to_date(F.max("d1")).alias("CAMPAIGN_LAST_DATE"),
                total("mails").alias("NB_EMAILS"), total("lines").alias("NB_CONTACTS_TOUCHED"),
                F.count(F.col("l_orderkey")).alias("NB_COMPANIES_TOUCHED"),
                total("clicks").alias("TOTAL_NB_CLICKS"),
                total("positive").alias("TOTAL_NB_POSITIVE_REPLIES_PER_CAMPAIGN"),
                total("negative").alias("TOTAL_NB_NEGATIVE_REPLIES_PER_CAMPAIGN"),
                orders_from("top_qty", 40).alias("NB_COMPANIES_CLICKED"),
                orders_from("top_qty", 50).alias("NB_CUSTOMERS_FROM_OB_ALL_TIME"),
                total("price").alias("PIPELINE_OPP_AMOUNT_FROM_OB_ALL_TIME"),
                (F.floor(F.sum("qty") / F.lit(500.0)) * 500)
                .cast("bigint").alias("NEW_ARR_FROM_OB_ALL_TIME"),
                orders_from("icp_qty", 45).alias("NB_COMPANIES_TOUCHED_ICP"),
                orders_from("icp_qty", 46).alias("NB_COMPANIES_CLICKED_ICP"),
                orders_from("icp_qty", 48).alias("NB_COMPANIES_REPLIED_ICP"),
                orders_from("icp_qty", 49).alias("NB_COMPANIES_REPLIED_POSITIVE_ICP")))
    # The table repeats three columns under a dotted name.
    return out.select("*", *[F.col(c).alias(f"{c}.1") for c in REPEATED_COLUMNS])


def outbound_text(spark: SparkSession, sf_dir: str, dirty: bool = True) -> DataFrame:
    """Some campaign columns as an export holds them (FIXTURES.md §5): money
    with '$' and ',', dates as text in two forms, repeated rows; ``dirty`` adds
    a bad date and bad numbers, which strict cleaning refuses."""
    df = outbound(spark, sf_dir)
    n = F.pmod(F.col("NB_EMAILS"), F.lit(5))
    day = F.date_format("CAMPAIGN_START_DATE", "yyyy-MM-dd")
    start = F.when(n == 1, F.regexp_replace(day, "-", "/")).otherwise(day)
    amount = F.concat(F.lit("$"), F.format_number("PIPELINE_OPP_AMOUNT_FROM_OB_ALL_TIME", 0))
    clicks = F.col("TOTAL_NB_CLICKS").cast("string")
    if dirty:
        start = F.when(n == 2, F.concat(day, F.lit("x"))).otherwise(start)
        amount = F.when(n == 3, F.lit("n/a")).otherwise(amount)
    rows = df.select("CAMPAIGN_GROUP", start.alias("CAMPAIGN_START_DATE"),
                     amount.alias("PIPELINE_OPP_AMOUNT_FROM_OB_ALL_TIME"),
                     clicks.alias("TOTAL_NB_CLICKS"),
                     F.when(n == 4, F.lit(float("nan"))).otherwise(F.col("NB_EMAILS") / 2)
                     .alias("NB_EMAILS"))
    return rows.select("*", F.explode(F.when(_repeats(rows) == 0, F.array(F.lit(1), F.lit(2)))
                                      .otherwise(F.array(F.lit(1)))).alias("_copy")).drop("_copy")


def _repeats(rows: DataFrame):
    """Rows that the text export repeats."""
    return F.pmod(F.length("CAMPAIGN_GROUP"), F.lit(3))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market table (FIXTURES.md §3): one row per customer with orders."""
    cust = read_table(spark, sf_dir, "customer")
    orders = read_table(spark, sf_dir, "orders")
    nation = read_table(spark, sf_dir, "nation")
    per_cust = (orders.groupBy("o_custkey")
                .agg(F.count(F.lit(1)).alias("n"),
                     F.sum(F.floor("o_totalprice").cast("bigint")).cast("double").alias("g")))
    x = cust.join(per_cust, cust.c_custkey == per_cust.o_custkey)
    g = F.col("g")
    cat = (F.when(F.col("c_custkey") % 17 == 0, F.lit(None).cast("string"))
           .when(g < 1000000, F.lit(GMV_CLASSES[0]))
           .when(g < 3000000, F.lit(GMV_CLASSES[1]))
           .otherwise(F.lit(GMV_CLASSES[2])))
    return (x.join(nation, x.c_nationkey == nation.n_nationkey)
            .select(F.when(F.col("c_custkey") % 4 == 0, F.lit("Shopify"))
                    .otherwise(F.col("c_mktsegment")).alias("PLATFORM"),
                    F.col("n_name").alias("COUNTRY"),
                    cat.alias("GMV_CATEGORY"),
                    g.alias("TOTAL_GMV"),
                    (g / F.col("n")).alias("AVG_GMV"),
                    F.col("n").cast("double").alias("NB_DOMAINS"),
                    F.floor("c_acctbal").cast("bigint").alias(ARR_COLUMN)))


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenant -> data source table (FIXTURES.md §4)."""
    cust = read_table(spark, sf_dir, "customer")
    return cust.select(F.col("c_nationkey").alias("TENANT_ID"),
                       F.col("c_custkey").alias("DATASOURCE_ID"))


def store_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenant of each store URL (FIXTURES.md §4): one row per store."""
    cust = read_table(spark, sf_dir, "customer")
    return (cust.groupBy(F.concat(F.lit("s"), (F.col("c_custkey") % 5).cast("string"))
                         .alias("shopify_url"))
            .agg(F.min("c_nationkey").alias("tenant_id")))
