"""A third of all events on one key: results stay exact, and no operator
needs the whole hot group in one task (checked in tools/skew_demo.py)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import attribution as att
from touchline.sources import fixtures

from conftest import SF001, rows


def skewed_events(spark, sf_dir=SF001):
    """Typed events where every third event shares ip, hour, shop and order id."""
    flat = fixtures.pixel_flat(spark, sf_dir)
    hot = F.col("event_id") % 3 == 0
    return flat.select(
        "event_id",
        F.when(hot, F.lit(1704067200)).otherwise(F.col("timestamp")).alias("timestamp"),
        "userId", F.lit(None).cast("string").alias("sessionId"),
        F.when(hot, F.lit("sHOT")).otherwise(F.col("shopifyShopURL")).alias("shopifyShopURL"),
        F.when(hot, F.lit("ipHOT")).otherwise(F.col("ip")).alias("ip"),
        F.when(hot & F.col("shopifyOrderId").isNotNull(), F.lit("oHOT"))
         .otherwise(F.col("shopifyOrderId")).alias("shopifyOrderId"),
        F.col("shopifyOrderProcessedAt").cast("string").alias("shopifyOrderProcessedAt"),
        F.col("shopifyOrderTotalPrice").cast("decimal(18,2)").alias("shopifyOrderTotalPrice"),
        "shopifyPageType", "pageReferrer", "utmSource", "utmMedium", "utmCampaign")


def test_last_touch_exact_under_skew(spark):
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1k")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1")
    try:
        ev = skewed_events(spark)
        fast = att.last_touch(ev, 90).select("shopifyOrderId", "attribution_source",
                                             "pageReferrer", "touchpoint_timestamp")
        j = att.journey(ev, att.KEYS_WITH_SHOP, 90).filter("is_within_lookback = 1")
        w = Window.partitionBy("order_id").orderBy(F.col("t_ts").desc(), "t_event_id", "o_event_id")
        plain = (j.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
                 .select("order_id", "attribution_source", "t_referrer", "t_ts"))
        assert rows(fast) == rows(plain)
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "64m")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "4")


def test_journey_steps_exact_under_skew(spark):
    ev = skewed_events(spark)
    fast = att.touch_journey(ev, ordered=False, n_buckets=6)
    pairs = att.journey(ev, att.KEYS_NO_SHOP)
    w = Window.partitionBy("order_id").orderBy("t_ts", "t_event_id", "o_event_id")
    plain = pairs.select(F.col("order_id").alias("SHOPIFYORDERID"),
                         F.col("o_shop").alias("SHOPIFYSHOPURL"),
                         F.row_number().over(w).cast("bigint").alias("TOUCHPOINT_STEP"),
                         F.col("attribution_source").alias("ATTRIBUTION_SOURCE"))
    got = fast.filter(F.col("SHOPIFYORDERID") == "oHOT").count()
    assert got > 10000  # the hot order really is large
    assert rows(fast) == rows(plain)
