import pytest

from touchline.operators.cleaning import clean


def test_clean_strict_and_lenient(spark):
    df = spark.createDataFrame(
        [("c1", "2022-01-05", "$1,234", "Shopify", 1),
         ("c2", "2022/01/06", "1234", "Other", 2),
         ("c3", "bad", None, "Shopify", 3)],
        "CAMPAIGN_GROUP string, START string, AMOUNT string, PLATFORM string, N long")
    out = clean(df, strict=True)
    d = dict(out.dtypes)
    assert d["START"] == "date" and d["AMOUNT"] == "bigint" and d["PLATFORM"] == "string"
    got = {r.CAMPAIGN_GROUP: (str(r.START), r.AMOUNT) for r in out.collect()}
    assert got == {"c1": ("2022-01-05", 1234), "c2": ("2022-01-06", 1234), "c3": ("None", None)}


def test_clean_strict_raises_on_bad_number(spark):
    df = spark.createDataFrame([("1234.5",), ("",)], "AMOUNT string")
    with pytest.raises(Exception):
        clean(df, strict=True).collect()
    got = sorted((r.AMOUNT for r in clean(df, strict=False).collect()), key=str)
    assert got == [None]  # both become NULL, then the duplicate row is dropped


def test_clean_dedups_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "CAMPAIGN_GROUP string, N long")
    assert clean(df).count() == 2


def test_clean_all_protected_text_keeps_duplicates(spark):
    df = spark.createDataFrame([("x",), ("x",)], "PLATFORM string")
    assert clean(df).count() == 2


def test_clean_maps_nan_to_null(spark):
    from touchline.operators.profile import sum_by, top_n_by_sum
    df = spark.createDataFrame([("a", float("nan")), ("a", 2.0), ("b", 1.0)], "PLATFORM string, v double")
    out = clean(df)
    assert out.filter("v IS NULL").count() == 1
    assert dict(sum_by(out, "PLATFORM", "v").collect()) == {"a": 2.0, "b": 1.0}
    assert [r[0] for r in top_n_by_sum(out, "PLATFORM", "v", 2).collect()] == ["a", "b"]


def test_clean_of_a_staged_table(spark):
    import tempfile

    from conftest import SF001, rows
    from touchline.plans import inputs
    from touchline.sources.profiled import clean_staged, stage_profiled, staged_profile
    from pyspark.sql import functions as F

    source = inputs.outbound_text(spark, SF001)
    runs = spark.sparkContext.accumulator(0)
    path = tempfile.mkdtemp(prefix="tl-profiled-", dir="/tmp") + "/t"

    @F.udf("string")
    def counted(v):                # how often the input is computed
        runs.add(1)
        return v

    n = source.count()
    stage_profiled(source.withColumn("CAMPAIGN_GROUP", counted.asNondeterministic()("CAMPAIGN_GROUP")), path)
    got = clean_staged(spark, path, strict=False)
    assert rows(got) == rows(clean(source, strict=False))
    assert runs.value == n
    profile = {r.column_name: r for r in staged_profile(spark, path).collect()}
    assert [c for c, r in profile.items() if r.date_like] == ["CAMPAIGN_START_DATE"]
    assert profile["TOTAL_NB_CLICKS"].filled == source.filter("TOTAL_NB_CLICKS is not null").count()


def test_clean_of_a_staged_table_without_rows(spark):
    import tempfile

    from touchline.sources.profiled import clean_staged, stage_profiled, staged_profile
    path = tempfile.mkdtemp(prefix="tl-profiled-", dir="/tmp") + "/t"
    stage_profiled(spark.createDataFrame([], "`a.b` string, N long"), path)
    out = clean_staged(spark, path)
    assert out.count() == 0 and dict(out.dtypes) == {"a.b": "bigint", "N": "bigint"}
    assert staged_profile(spark, path).first().filled == 0
    stage_profiled(spark.createDataFrame([], "N long"), path + "2")
    assert clean_staged(spark, path + "2").count() == 0
