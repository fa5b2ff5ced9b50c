from pyspark.sql import functions as F

from touchline.operators import sizing
from touchline.plans import inputs, pages

from conftest import SF01


def test_rollup_total_is_sum_of_leaves(spark):
    mk = inputs.market(spark, SF01)
    r = sizing.tam_rollup(mk)
    total = r.filter("LEVEL = 3").first()["POLAR ARR ($)"]
    leaves = r.filter("LEVEL = 0").agg(F.sum(F.col("`POLAR ARR ($)`"))).first()[0]
    mid = r.filter("LEVEL = 1").agg(F.sum(F.col("`POLAR ARR ($)`"))).first()[0]
    assert total == leaves == mid


def test_funnel_order_and_counts(spark):
    ob = inputs.outbound(spark, SF01)
    f = sizing.outbound_funnel(ob).orderBy("STAGE_ORDER").collect()
    assert [r.STAGE for r in f][0] == "Contacts Touched" and len(f) == 6
    counts = [r.COUNT for r in f]
    assert counts[2] >= counts[3] >= counts[4] >= counts[5]


def test_pareto_summary_consistent(spark):
    ob = inputs.outbound(spark, SF01)
    lab = sizing.pareto(ob)
    s = sizing.pareto_summary(lab).first()
    assert s.NUM_CAMPAIGNS == 150
    assert s.NUM_CAMPAIGNS_TOP == lab.filter(F.col("COLOR_LABEL") == "Top 80%").count()


def test_icp_rates_zero_over_zero_is_null(spark):
    df = spark.createDataFrame([("a", 0, 0, 0, 0), ("b", 4, 2, 1, 0)],
                               "CAMPAIGN_GROUP string, NB_COMPANIES_TOUCHED_ICP long, "
                               "NB_COMPANIES_CLICKED_ICP long, NB_COMPANIES_REPLIED_ICP long, "
                               "NB_COMPANIES_REPLIED_POSITIVE_ICP long")
    r = {x.CAMPAIGN_GROUP: x for x in sizing.icp_rates(df).collect()}
    assert r["a"].ICP_click_through_rate is None and r["b"].ICP_click_through_rate == 0.5
    avg = sizing.icp_avg_rates(df).first()
    assert avg.avg_ICP_click_through_rate == 0.5  # NULL skipped, as pandas mean skips NaN


def test_limitations_message(spark):
    df = spark.createDataFrame([("a", 10, 1, 0, 0, 10)],
                               "CAMPAIGN_GROUP string, NB_COMPANIES_TOUCHED_ICP long, "
                               "NB_COMPANIES_CLICKED_ICP long, NB_COMPANIES_REPLIED_ICP long, "
                               "NB_COMPANIES_REPLIED_POSITIVE_ICP long, NB_COMPANIES_TOUCHED long")
    r = sizing.outbound_limitations(df).first()
    assert r.NUM_LIMITATIONS == 4 == len(r.LIMITATIONS)
    assert "Low click-through rate for ICP contacts. (0.10%)" in r.MESSAGE
    assert r.MESSAGE.startswith("\nOutbound is facing the following limitations:\n")


def test_tam_share_keeps_null_category(spark):
    df = spark.createDataFrame([("Shopify", None, "X", 10), ("Shopify", "a) < $1M", "X", 5),
                                ("Shopify", "b) $1M - $3M", "Y", 30), ("Other", "c) > $3M", "X", 7)],
                               "PLATFORM string, GMV_CATEGORY string, COUNTRY string, `POLAR ARR ($)` long")
    r = sizing.tam_share(df, "X").first()
    assert (r.POTENTIAL_ARR, r.COUNTRY_ARR) == (40, 10) and abs(r.COUNTRY_SHARE - 25.0) < 1e-12


def test_sizing_page_builds(spark):
    res = pages.sizing_page(inputs.outbound(spark, SF01), inputs.market(spark, SF01))
    assert res["tam_contribution"].count() == 1
