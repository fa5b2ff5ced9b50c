"""Attribution marts: known answers (FIXTURES.md), invariants, and the
aggregate-based last touch against the plain window form."""

import random
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import attribution as att
from touchline.plans import inputs

from conftest import SF01, SF001, rows

KNOWN_ORDERS = {"attentive": 104, "direct": 316, "facebook": 98, "google": 155,
                "instagram": 34, "referral": 344}
KNOWN_REVENUE = {"attentive": 4576.78, "direct": 16146.29, "facebook": 3876.49,
                 "google": 7789.69, "instagram": 1390.46, "referral": 15388.01}
KNOWN_JOURNEY = {"attentive": 352, "direct": 969, "facebook": 311, "google": 466,
                 "instagram": 126, "referral": 1038}


def test_last_touch_known_answers(spark):
    lt = att.last_touch(inputs.events(spark, SF01), days=90)
    got = {r[0]: (r[1], round(float(r[2]), 2)) for r in lt.groupBy("attribution_source").agg(
        F.count("*"), F.sum("shopifyOrderTotalPrice")).collect()}
    assert {k: v[0] for k, v in got.items()} == KNOWN_ORDERS
    assert {k: v[1] for k, v in got.items()} == KNOWN_REVENUE


def test_journey_known_answers(spark):
    cjm = att.touch_journey(inputs.events(spark, SF01), ordered=False)
    got = dict(cjm.groupBy("ATTRIBUTION_SOURCE").count().collect())
    assert got == KNOWN_JOURNEY


def test_journey_steps_are_one_to_n(spark):
    cjm = att.touch_journey(inputs.events(spark, SF01), ordered=False, n_buckets=5)
    bad = (cjm.groupBy("SHOPIFYORDERID")
           .agg(F.count("*").alias("n"), F.min("TOUCHPOINT_STEP").alias("lo"),
                F.max("TOUCHPOINT_STEP").alias("hi"),
                F.count_distinct("TOUCHPOINT_STEP").alias("d"))
           .filter("lo != 1 OR hi != n OR d != n"))
    assert bad.count() == 0


def _plain_last_touch(events, days):
    """The statement as written: full journey + ROW_NUMBER window."""
    j = att.journey(events, att.KEYS_WITH_SHOP, days).filter("is_within_lookback = 1")
    w = Window.partitionBy("order_id").orderBy(F.col("t_ts").desc(), "t_event_id", "o_event_id")
    top = j.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return top.select("order_id", "o_shop", "attribution_source", "t_referrer", "match_type",
                      "t_event_id")


def test_identity_last_touch_without_event_ids(spark):
    """As-of form against the window form; without ids no order is lost."""
    full = inputs.events(spark, SF001)
    for ev in (full, full.withColumn("event_id", F.lit(None).cast("bigint"))):
        for strict, days in ((False, 3), (True, 1), (True, 10)):
            o, t = att.order_events(ev), att.touchpoints(ev)
            late = F.col("t_ts") < F.col("o_ts") if strict else F.col("t_ts") <= F.col("o_ts")
            pairs = (o.join(t, F.col("o_user") == F.col("t_user"))
                     .filter(late & (F.col("t_ts") >= F.col("o_ts") - days * 86400)))
            w = Window.partitionBy("order_id").orderBy(
                F.col("t_ts").desc(), *att._TOUCH_RANK, *att._ORDER_RANK)
            plain = (pairs.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
                     .select("order_id", "attribution_source", "t_referrer", "t_ts", "o_price"))
            fast = att.last_touch(ev, days, att.KEYS_IDENTITY, strict=strict).select(
                "shopifyOrderId", "attribution_source", "pageReferrer", "touchpoint_timestamp",
                "shopifyOrderTotalPrice")
            assert rows(fast) == rows(plain)


def test_window_decides_for_earlier_marketing_touches(spark):
    ev = inputs.events(spark, SF01)
    n = [att.last_touch(ev, d, att.KEYS_IDENTITY, strict=True,
                        touches=F.col("utmSource").isNotNull()).count() for d in (3, 10, 25)]
    assert n[0] < n[1] < n[2]


def test_first_steps_equal_the_cut_journey(spark):
    ev = inputs.events(spark, SF01)
    whole = att.touch_journey(ev, ordered=False)
    for below in (3, 10):
        assert rows(att.first_steps(ev, below)) == rows(whole.filter(F.col("TOUCHPOINT_STEP") < below))


def test_last_touch_equals_window_form(spark):
    ev = inputs.events(spark, SF01)
    fast = att.last_touch(ev, 90).select("shopifyOrderId", "shopifyShopURL", "attribution_source",
                                         "pageReferrer", "match_type")
    plain = _plain_last_touch(ev, 90).drop("t_event_id")
    assert rows(fast) == rows(plain)


def test_report_invariant_orders_sum(spark):
    ev = inputs.events(spark, SF01)
    lt = att.last_touch(ev, 90)
    rep = att.attribution_report(lt, ordered=False)
    total = rep.agg(F.sum("ATTRIBUTED_ORDERS")).first()[0]
    assert total == lt.select("shopifyOrderId").distinct().count() == 1051


def test_order_key_with_shop(spark):
    ev = inputs.events(spark, SF001)
    by_id = att.last_touch(ev, 90).count()
    by_shop = att.last_touch(ev, 90, order_key=("shop", "order_id")).count()
    assert by_shop >= by_id


def test_orders_per_month_store_shape(spark):
    out = att.orders_per_month_store(inputs.events(spark, SF001))
    assert out.columns == ["STORE", "MONTH", "ORDER_COUNT"]
    assert dict(out.dtypes)["MONTH"] == "string"


def test_json_null_missing_and_bad_documents(spark):
    from touchline.sources.events import event_table
    log = spark.createDataFrame([('{"shopifyOrderId":null,"shopifyPageType":"thank_you"}',),
                                 ('{}',), ('{bad',),
                                 ('{"shopifyOrderId":"o1","shopifyPageType":"thank_you"}',)],
                                "DATA string")
    ev = event_table(log)
    assert att.order_events(ev).count() == 1


def test_journey_steps_equal_window_form(spark):
    ev = inputs.events(spark, SF001)
    fast = att.touch_journey(ev, ordered=False, n_buckets=3)
    pairs = att.journey(ev, att.KEYS_NO_SHOP)
    w = Window.partitionBy("order_id").orderBy("t_ts", "t_event_id", "o_event_id")
    plain = pairs.select(F.col("order_id").alias("SHOPIFYORDERID"),
                         F.col("o_shop").alias("SHOPIFYSHOPURL"),
                         F.row_number().over(w).cast("bigint").alias("TOUCHPOINT_STEP"),
                         F.col("attribution_source").alias("ATTRIBUTION_SOURCE"))
    assert rows(fast) == rows(plain)


def test_money_strip_is_noop_on_numbers(spark):
    from touchline.plans import pages
    mk = pages.market_frame(inputs.market(spark, SF001))
    a = mk.select("TOTAL_GMV", "AVG_GMV")
    b = pages.with_money_columns(mk).select("TOTAL_GMV", "AVG_GMV")
    assert rows(a) == rows(b)


def test_source_shares_add_to_100(spark):
    from touchline.operators import reports
    rep = att.attribution_report(att.last_touch(inputs.events(spark, SF001), 90), ordered=False)
    total = reports.source_share(rep).agg(F.sum("PERCENTAGE")).first()[0]
    assert abs(total - 100.0) < 1e-9


def test_epoch_milliseconds_give_same_attribution(spark):
    ev = inputs.events(spark, SF01)
    ms = ev.withColumn("timestamp", F.col("timestamp") * 1000)
    cols = ["shopifyOrderId", "attribution_source", "pageReferrer", "match_type"]
    for keys, days in [(att.KEYS_IDENTITY, 3), (att.KEYS_WITH_SHOP, 90)]:
        a = att.last_touch(ev, days, keys=keys).select(cols)
        b = att.last_touch(ms, days, keys=keys, epoch_unit="ms").select(cols)
        assert rows(a) == rows(b)
    # the range join scales its window with the unit: same pairs in s and ms,
    # and a window read as seconds on millisecond data would be 1000x shorter
    from touchline.operators.joins import lookback_join
    o, t = att.order_events(ms), att.touchpoints(ms)
    on = [("o_user", "t_user")]
    n_ms = lookback_join(o, t, on, "o_ts", "t_ts", 3, units_per_second=1000).count()
    n_s = lookback_join(att.order_events(ev), att.touchpoints(ev), on, "o_ts", "t_ts", 3).count()
    n_wrong = lookback_join(o, t, on, "o_ts", "t_ts", 3).count()
    assert n_ms == n_s > n_wrong


def _tangled_events(spark):
    """Events in which orders return at several times, ips and event pieces,
    with null keys, equal rows and one heavy (ip, time)."""
    r = random.Random(5)
    n = att.PIECE_IDS
    data = []
    for i in range(1500):
        heavy = i % 3 == 0
        data.append((r.choice([i, i + n, i + 3 * n]) if i % 50 else None,
                     None if i % 97 == 0 else 3600 if heavy else r.choice([3600, 7200, 90_000, 400_000]),
                     f"u{r.randrange(4)}", None if i % 89 == 0 else "ip0" if heavy else f"ip{r.randrange(5)}",
                     f"o{r.randrange(25)}" if i % 4 == 0 else None, f"s{i % 3}", r.choice(["x", None])))
    data += data[:40:4]
    flat = spark.createDataFrame(data, "event_id bigint, timestamp bigint, userId string, ip string, "
                                       "shopifyOrderId string, shopifyShopURL string, utmSource string")
    none = F.lit(None).cast("string")
    return flat.select("*", *[none.alias(c) for c in (
        "sessionId", "shopifyOrderProcessedAt", "pageReferrer", "utmMedium", "utmCampaign")],
        F.lit(1).cast("decimal(38,10)").alias("shopifyOrderTotalPrice"), F.lit("product").alias("shopifyPageType"))


def _plain_steps(ev):
    w = Window.partitionBy("order_id").orderBy(*att._STEP_ORDER)
    return att.journey(ev, att.KEYS_NO_SHOP).select(
        "order_id", "t_ip", "attribution_source", F.row_number().over(w).alias("step"))


def test_composed_steps_of_tangled_orders(spark):
    ev = _tangled_events(spark)
    got = att.touch_journey(ev, ordered=False).select(
        "SHOPIFYORDERID", "ATTRIBUTION_SOURCE", F.col("TOUCHPOINT_STEP").cast("int"))
    assert rows(got) == rows(_plain_steps(ev).select("order_id", "attribution_source", "step"))


def test_step_counts_equal_the_journey(spark):
    from touchline.operators import reports
    for ev in (_tangled_events(spark), inputs.events(spark, SF001)):
        cjm = att.touch_journey(ev, ordered=False)
        want = cjm.groupBy("TOUCHPOINT_STEP", "ATTRIBUTION_SOURCE").agg(F.count_distinct("SHOPIFYORDERID"))
        assert rows(att.step_counts(ev)) == rows(want)
        assert rows(att.step_counts(ev, below=4)) == rows(want.filter("TOUCHPOINT_STEP < 4"))
        cols = reports.touch_funnel(cjm).columns
        assert rows(reports.funnel_of_counts(att.step_counts(ev, below=10)).select(cols)) == rows(reports.touch_funnel(cjm))


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_the_log_is_read_once(spark):
    ev = inputs.events(spark, SF001)
    for df in (att.last_touch(ev, 3, keys=att.KEYS_IDENTITY), att.step_counts(ev),
               att.touch_journey(ev, ordered=False)):
        assert _final_plan(df).count("FileScan") == 1


def test_as_of_scan_with_pieces_nulls_and_ties(spark):
    ev = _tangled_events(spark)
    for strict in (False, True):
        for only in (None, F.col("utmSource").isNotNull()):
            o, t = att.order_events(ev), att.touchpoints(ev if only is None else ev.filter(only))
            late = F.col("t_ts") < F.col("o_ts") if strict else F.col("t_ts") <= F.col("o_ts")
            pairs = (o.join(t, F.col("o_user") == F.col("t_user"))
                     .filter(late & (F.col("t_ts") >= F.col("o_ts") - 2 * 86400)))
            w = Window.partitionBy("order_id").orderBy(F.col("t_ts").desc(), *att._TOUCH_RANK, *att._ORDER_RANK)
            plain = (pairs.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
                     .select("order_id", "attribution_source", "t_ts", "o_shop"))
            fast = att.last_touch(ev, 2, att.KEYS_IDENTITY, strict=strict, touches=only).select(
                "shopifyOrderId", "attribution_source", "touchpoint_timestamp", "shopifyShopURL")
            assert rows(fast) == rows(plain)


def _alike_orders(spark, n):
    """``n`` orders that stand alike at two ips of one time, 50 touches each,
    with two order events at one of them, and an order of many ips."""
    base = [(i, 3600, f"ip{i % 2}", None, "x" if i % 3 else "y") for i in range(100)]
    at = 100
    for o in range(n):
        base += [(at, 3600, "ip0", f"a{o}", "x"), (at + 1, 3600, "ip1", f"a{o}", "y"), (at + 2, 3600, "ip1", f"a{o}", "y")]
        at += 3
    base += [(at + i, 3600, f"many{i}", "wide", "x" if i % 2 else "y") for i in range(att.ALIKE_IPS + 2)]
    flat = spark.createDataFrame(base, "event_id bigint, timestamp bigint, ip string, shopifyOrderId string, utmSource string")
    none = F.lit(None).cast("string")
    return flat.select("*", *[none.alias(c) for c in (
        "userId", "sessionId", "shopifyShopURL", "shopifyOrderProcessedAt", "pageReferrer", "utmMedium", "utmCampaign")],
        F.lit(1).cast("decimal(38,10)").alias("shopifyOrderTotalPrice"), F.lit("product").alias("shopifyPageType"))


def _joined_rows(spark, df):
    """The most rows that a join of the finished plan put out."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name.endswith("JoinExec"):
            most = max(most, node.longMetric("numOutputRows").value())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return most


def test_orders_alike_at_several_ips_are_counted_once(spark):
    ev = _alike_orders(spark, 40).cache()
    steps = _plain_steps(ev).groupBy("step", "attribution_source").agg(F.count_distinct("order_id"))
    assert rows(att.step_counts(ev)) == rows(steps)
    assert rows(att.step_counts(ev, below=20)) == rows(steps.filter("step < 20"))
    # 286 events; the pairs of orders and touches are 40 x (90 + 2 x 130) and more
    assert _joined_rows(spark, att.step_counts(ev)) < 2 * ev.count()


def test_step_counts_exchange_only_what_they_count(spark):
    plan = att.step_counts(inputs.events(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    for name in ("t_referrer", "t_campaign", "t_shop", "o_price", "o_shop"):
        assert name not in plan
