"""Profile operators against pandas, the library the source pages use."""

import math

import numpy as np
from pyspark.sql import functions as F

from touchline.operators import profile
from touchline.plans import inputs, pages

from conftest import rows, SF01


def _close(a, b):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_describe_matches_pandas(spark):
    df = pages.market_frame(inputs.market(spark, SF01))
    pdf = df.toPandas()
    want = pdf.describe()
    got = {r.COLUMN_NAME: r for r in profile.describe(df).collect()}
    for col in want.columns:
        r = got[col]
        for stat, name in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                           ("25%", "p25"), ("50%", "p50"), ("75%", "p75"), ("max", "max")]:
            assert _close(r[name], float(want.loc[stat, col])), (col, stat)


def test_describe_approx_close(spark):
    df = pages.market_frame(inputs.market(spark, SF01))
    exact = {r.COLUMN_NAME: r.p50 for r in profile.describe(df).collect()}
    approx = {r.COLUMN_NAME: r.p50 for r in profile.describe(df, approx=True).collect()}
    for k in exact:
        assert abs(exact[k] - approx[k]) <= 0.05 * abs(exact[k]) + 1


def test_unique_counts_matches_pandas(spark):
    df = pages.market_frame(inputs.market(spark, SF01))
    want = df.toPandas().nunique()
    got = {r.COLUMN_NAME: r.UNIQUE_VALUES for r in profile.unique_counts(df).collect()}
    assert got == {k: str(v) for k, v in want.items()}


def test_unique_counts_of_wide_tables(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0.0, None, True, "a"), (-0.0, None, False, ""), (nan, None, None, None),
                                (nan, None, True, "a")], "d double, z string, `b.c` boolean, t string")
    df = df.selectExpr("*", "cast(d as float) f", "cast(length(t) as decimal(9,2)) dec", "length(t) i",
                       "date '2024-01-01' day", "timestamp_ntz '2024-01-01 00:00:00' ntz", "now() ts")
    want = rows(profile.unique_counts(df))
    assert ("d", "2") in want and ("z", "0") in want and ("b.c", "2") in want
    assert rows(profile.unique_counts(df, wide=0)) == want
    assert "Expand" not in profile.unique_counts(df, wide=0)._jdf.queryExecution().executedPlan().toString()
    assert {r[1] for r in profile.unique_counts(df.limit(0), wide=0).collect()} == {"0"}
    assert profile.unique_counts(df.selectExpr("array(t) a"), wide=0).first()[1] == "3"    # no cell form
    market = pages.market_frame(inputs.market(spark, SF01))
    assert rows(profile.unique_counts(market, wide=0)) == rows(profile.unique_counts(market))


def test_box_stats_matches_numpy(spark):
    df = pages.market_frame(inputs.market(spark, SF01))
    pdf = df.toPandas()
    got = {r.GMV_CATEGORY: r for r in profile.box_stats(df, "GMV_CATEGORY", "AVG_GMV").collect()}
    for cat, g in pdf.groupby("GMV_CATEGORY"):
        r, want = got[cat], _chart_box(g["AVG_GMV"])
        assert all(_close(r[k], v) for k, v in want.items())


def _chart_box(values):
    """Quartiles at place n p - 0.5 (numpy's Hazen rule), whiskers at the last
    points within 1.5 box lengths, points beyond."""
    v = np.sort(np.asarray(values, float))
    q1, median, q3 = np.percentile(v, [25, 50, 75], method="hazen")
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    return {"min": v[0], "lower_whisker": min(q1, v[v >= lo][0]), "q1": q1, "median": median,
            "q3": q3, "upper_whisker": max(q3, v[v <= hi][-1]), "max": v[-1],
            "outliers": int(((v < lo) | (v > hi)).sum()), "count": len(v)}


def test_box_stats_small_groups_and_outliers(spark):
    groups = {"one": [4.0], "two": [1.0, 5.0], "four": [1.0, 2.0, 3.0, 10.0], "same": [7.0] * 5,
              "far": [1.0, 2.0, 2.5, 3.0, 3.5, 4.0, 90.0, -80.0]}
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "k string, v double")
    for r in profile.box_stats(df, "k", "v").collect():
        assert all(_close(r[k], v) for k, v in _chart_box(groups[r["k"]]).items()), r


def test_dotted_columns(spark):
    df = spark.createDataFrame([(1, 2, "g%s"), (3, None, "h")], "`a.b` int, `c.d.1` int, `e.f` string")
    assert rows(profile.unique_counts(df)) == [("a.b", "2"), ("c.d.1", "1"), ("e.f", "2")]
    got = {r.COLUMN_NAME: r["max"] for r in profile.describe(df).collect()}
    assert got == {"a.b": 3.0, "c.d.1": 2.0}
    assert [r[0] for r in profile.distinct_values(df, "c.d.1").collect()] == [2]


def test_describe_keeps_the_callers_cache(spark):
    df = spark.range(50).selectExpr("cast(id as double) as x").cache()
    df.count()
    profile.describe(df)
    assert df.storageLevel.useMemory
    df.unpersist()


def test_box_stats_log(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", math.e - 1), ("a", -3.0), ("b", None)],
                               "k string, v double")
    got = {r.k: r for r in profile.box_stats(df, "k", "v", log=True).collect()}
    assert set(got) == {"a"} and got["a"]["count"] == 1 and _close(got["a"].median, 1.0)


def test_top_n_ties_keep_smaller_key(spark):
    df = spark.createDataFrame([("b", 5.0), ("a", 5.0), ("c", 1.0), ("c", None), ("d", None)],
                               "k string, v double")
    got = [tuple(r) for r in profile.top_n_by_sum(df, "k", "v", 3).collect()]
    assert got == [("a", 5.0), ("b", 5.0), ("c", 1.0)]
    # an all-null group sums to 0, as pandas does
    assert dict(profile.sum_by(df, "k", "v").collect())["d"] == 0


def test_top_n_distinct(spark):
    t = inputs.tenants(spark, SF01)
    pdf = t.toPandas()
    want = pdf.groupby("TENANT_ID")["DATASOURCE_ID"].nunique()
    got = profile.top_n_distinct(t, "TENANT_ID", "DATASOURCE_ID", 10).collect()
    assert [r.DATASOURCE_ID for r in got] == sorted(want.values, reverse=True)[:10]


def test_metric_by_start_month_drops_null_dates(spark):
    df = spark.createDataFrame([("2022-01-05", 1), (None, 5), ("2021-01-31", 2)], "d string, m long")
    df = df.withColumn("d", F.to_date("d"))
    got = dict(profile.metric_by_start_month(df, "m", "d").collect())
    assert got == {1: 3}


def test_outbound_profile_pipeline(spark):
    res = pages.outbound_profile(inputs.outbound(spark, SF01))
    tbl = res["table"]
    assert tbl.columns[3] == "CAMPAIGN_LENGTH"
    # 17 metrics, group, two dates and the length; the three dotted ones dropped
    assert len(tbl.columns) == 21 - 3 and not [c for c in tbl.columns if "." in c]
    assert res["describe"].count() == 15
    spans = res["campaign_spans"].first()
    assert spans.LABEL.startswith("Start: ") and "<br>End: " in spans.LABEL


def test_box_stats_approx_close(spark):
    df = pages.market_frame(inputs.market(spark, SF01))
    ex = {r.GMV_CATEGORY: r.median for r in profile.box_stats(df, "GMV_CATEGORY", "AVG_GMV").collect()}
    ap = {r.GMV_CATEGORY: r.median for r in
          profile.box_stats(df, "GMV_CATEGORY", "AVG_GMV", approx=True).collect()}
    assert set(ex) == set(ap)
    for k in ex:
        assert abs(ex[k] - ap[k]) <= 0.05 * abs(ex[k]) + 1


def test_ordered_keys_keep_order_and_turn_back(spark):
    import struct
    from touchline.operators.quantiles import ordered_key, value_of
    tiny = 5e-324
    vals = [0.0, -0.0, tiny, -tiny, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 2.0, 0.5, 3.0, -3.5,
            4503599627370497.0, 1.7976931348623157e308, float("inf"), float("-inf"), 0.1, 1 / 3, -1e-300]
    got = spark.createDataFrame([(v,) for v in vals], "v double").select(
        "v", ordered_key(F.col("v")).alias("k")).select("v", "k", value_of(F.col("k")).alias("back")).collect()
    assert all(r.back == r.v for r in got)
    assert [r.v for r in sorted(got, key=lambda r: r.k)] == sorted(vals)
    bits = {r.v: r.k for r in got if r.v > 0}
    assert all(struct.unpack("<q", struct.pack("<d", v))[0] == k for v, k in bits.items())


def test_rank_selection_against_numpy(spark):
    import numpy as np
    from touchline.operators.quantiles import exact_quantiles
    r = np.random.default_rng(4)
    groups = {"a": r.normal(0, 1e6, 900), "b": np.repeat([7.0, 7.5], [500, 1]), "c": np.array([3.0]),
              None: r.integers(-5, 5, 300) / 4, "d": 1e9 + r.random(400) * 1e-3, "e": r.choice([-1e300, 1e-300, 0.0, 2e300], 50)}
    data = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("z", None)]
    df = spark.createDataFrame(data, "g string, v double")
    probs = {f"p{i}": p for i, p in enumerate([0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0])}
    got = {x.g: x for x in exact_quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, p in probs.items():
            assert math.isclose(got[g][name], np.quantile(vs, p), rel_tol=1e-14), (g, p)
    plan = exact_quantiles(df, ["g"], "v", {"m": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan.replace("SortOrder", "") and "LogicalRDD" in plan


def test_box_with_points_at_the_fences(spark):
    # box 0.5 .. 2.5 (by the chart rule), fences at -2.5 and 5.5, values on and beside them
    vals = [0.0, 1.0, 2.0, 3.0, 5.5, 5.500000000000001, -2.5, -2.5000000000000004, 1.5, 1.0, 2.0, 1.5]
    df = spark.createDataFrame([("k", v) for v in vals] + [(None, 1.0)], "k string, v double")
    got = {r.k: r for r in profile.box_stats(df, "k", "v").collect()}
    x = got["k"]
    reach = 1.5 * (x.q3 - x.q1)
    lo, hi = x.q1 - reach, x.q3 + reach
    assert x.lower_whisker == min(v for v in vals if v >= lo) and x.upper_whisker == max(v for v in vals if v <= hi)
    assert x.outliers == sum(v < lo or v > hi for v in vals) and x["count"] == len(vals)
    assert got[None]["count"] == 1 and got[None].lower_whisker == got[None].upper_whisker == 1.0


def test_empty_table_has_no_statistics(spark):
    df = spark.createDataFrame([], "g string, v double")
    for _ in range(3):       # depended on the order in which empty stages ended
        assert profile.describe(df).count() == 0
    assert profile.box_stats(df, "g", "v").count() == 0
