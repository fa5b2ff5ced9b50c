"""Every page-level query set builds and runs end to end."""

from touchline.plans import inputs, pages
from touchline.plans.marts import build_marts

from conftest import SF001


def _run_all(res):
    for name, df in res.items():
        assert df.count() >= 0, name


def test_attribution_page(spark):
    marts = build_marts(inputs.events(spark, SF001))
    res = pages.attribution_page(marts, source="direct")
    _run_all(res)
    marts.release()
    assert res["referrer_contribution"].count() <= 10


def test_market_profile(spark):
    res = pages.market_profile(inputs.market(spark, SF001), platform="Shopify", log=True)
    _run_all(res)
    assert res["top_countries"].count() <= 10


def test_tenants_profile(spark):
    res = pages.tenants_profile(inputs.tenants(spark, SF001))
    _run_all(res)
    assert res["preview"].count() == 5


def test_outbound_profile_selected_group(spark):
    ob = inputs.outbound(spark, SF001)
    group = ob.select("CAMPAIGN_GROUP").first()[0]
    res = pages.outbound_profile(ob, group=group)
    assert res["table"].count() == 1


def test_cli_list(capsys):
    from touchline.__main__ import main
    main(["list"])
    assert "attribution_report" in capsys.readouterr().out


def test_market_empty_category_selection_gives_no_rows(spark):
    mk = inputs.market(spark, SF001)
    assert pages.market_frame(mk, categories=[]).count() == 0
    some = pages.market_frame(mk, categories=["b) $1M - $3M"])
    assert some.count() > 0
    assert some.filter("GMV_CATEGORY != 'b) $1M - $3M'").count() == 0
