import math

import pytest
from pyspark.sql import functions as F

from touchline.functions.attribution import classify_source, match_type, within_lookback
from touchline.functions.semantics import is_member, not_equal_keep_null, pandas_div
from touchline.functions.text import money, month_start_date, month_start_text, to_day


def test_pandas_division(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 4), (-3, 0)], "n long, d long")
    got = [r[0] for r in df.select(pandas_div("n", "d")).collect()]
    assert got[0] is None
    assert got[1] == math.inf and got[3] == -math.inf
    assert got[2] == 0.5


def test_null_keeping_not_equal_and_membership(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert df.filter(not_equal_keep_null("c", "a")).count() == 2
    assert df.filter(is_member(F.col("c"), [])).count() == 0
    assert df.filter(is_member(F.col("c"), ["a", "b"])).count() == 2


def test_quote_inside_filter_value(spark):
    from touchline.operators.filters import optional_filters
    df = spark.createDataFrame([("Côte d'Ivoire",), ("France",)], "COUNTRY string")
    assert optional_filters(df, eq={"COUNTRY": "Côte d'Ivoire"}).count() == 1
    assert optional_filters(df, eq={"COUNTRY": "All"}).count() == 2


def test_classify_source_order_and_case(spark):
    data = [(None, None, "direct"), (None, "", "direct"), ("", "x", ""),
            (None, "https://www.google.com/search", "google"),
            (None, "https://l.facebook.com/google", "google"),
            (None, "https://GOOGLE.com", "referral"),
            (None, "https://instagram.com/", "instagram"),
            ("attentive", "https://www.google.com/", "attentive")]
    df = spark.createDataFrame(data, "u string, r string, want string")
    got = df.select(classify_source("u", "r").alias("g"), "want").collect()
    assert all(r.g == r.want for r in got)


def test_match_type_null_user_falls_to_ip(spark):
    df = spark.createDataFrame([(None, None, "ip1", "ip1", 5, 5), ("u1", "u1", "a", "b", 1, 2)],
                               "ou string, tu string, oi string, ti string, ot long, tt long")
    got = [r[0] for r in df.select(match_type("ou", "tu", "oi", "ti", "ot", "tt")).collect()]
    assert got == ["ip_match", "userId_match"]


def test_within_lookback_bounds(spark):
    df = spark.createDataFrame([(100, 100), (100 - 86400, 100), (100 - 86401, 100), (101, 100)],
                               "t long, o long")
    got = [r[0] for r in df.select(within_lookback("t", "o", 1)).collect()]
    assert got == [1, 1, 0, 0]


def test_offset_timestamp_month(spark):
    df = spark.createDataFrame([("2022-11-30T23:30:00-05:00",), ("2022-12-01",), ("bad",)], "x string")
    got = df.select(month_start_text("x"), month_start_date("x")).collect()
    assert got[0][0] == "2022-11-01" and str(got[0][1]) == "2022-11-01"
    assert got[1][0] == "2022-12-01"
    assert got[2][0] is None


def test_money_and_dates(spark):
    df = spark.createDataFrame([("$1,234",), ("1234.5",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(money("x", strict=False)).collect()] == [1234.0, 1234.5, None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(money("x")).collect()
    assert [r[0] for r in df.filter("x > '$'").select(money("x")).collect()] == [1234.0, 1234.5]
    good = ["2022-01-05", "2022/01/05", "2022-01-05 23:59", "2022-01-05T10:00:00.5Z", " 2022-01-05 ",
            "2022/01/05 10:00:00+02:00"]
    bad = ["bad", "2022-01-05garbage", "2022-13-01", "2022-01/05", "2022-01-05 25:00", "2022-01", ""]
    d = spark.createDataFrame([(x,) for x in good + bad], "x string")
    got = [r[0] and str(r[0]) for r in d.select(to_day("x")).collect()]
    assert got == ["2022-01-05"] * len(good) + [None] * len(bad)


def test_number_texts_round_like_python(spark):
    from touchline.functions.text import fixed_text, money_text
    vals = [12.5, 13.5, 0.125, 1234567.0, 2.0 / 3.0, 2.675, 1.115, -2.675, -1.115, 0.145, 0.375,
            1.005, 8.345, 1024.125, 99.995, 0.5, 1.5, 2.5, -0.5, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = df.select(fixed_text("x", 0).alias("a"), fixed_text("x", 2).alias("b"),
                    money_text("x").alias("c")).collect()
    for v, r in zip(vals, got):
        assert r.a == f"{v:.0f}" and r.b == f"{v:.2f}"
        assert r.c == f"${v:,.0f}" or v == -0.5       # money has no negative zero
