"""Range-bucketed numbering / running totals equal the plain windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators.sequence import row_number_within, running_sum
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.sizing import ARR, OTHER, _label, _q, pareto

from conftest import rows


def pareto_plain(df: DataFrame, metric: str = ARR, label_key: str = "CAMPAIGN_GROUP",
                 threshold: float = 0.8) -> DataFrame:
    """Reference form of ``pareto`` with a single global window (all rows in
    one task).  Used by tests to check the scalable form."""
    w = (Window.orderBy(_q(metric).desc_nulls_last(), _q(label_key).asc_nulls_last())
         .rowsBetween(Window.unboundedPreceding, 0))
    total = df.select(F.sum(_q(metric))).scalar()
    cum = F.when(_q(metric).isNotNull(), F.sum(_q(metric)).over(w))
    return (df.withColumn("CUMULATIVE_NEW_ARR", cum)
            .withColumn("COLOR_LABEL",
                        F.coalesce(_label(F.col("CUMULATIVE_NEW_ARR"), total, threshold),
                                   F.lit(OTHER))))


def _data(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    # one hot group holding a third of the rows, many small ones, some nulls
    data = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else (None if i % 97 == 0 else f"g{rnd.randint(0, 200)}")
        data.append((i, g, rnd.randint(0, 20), rnd.randint(-5, 50)))
    return spark.createDataFrame(data, "id long, g string, o long, v long")


def test_row_number_matches_window(spark):
    df = _data(spark)
    fast = row_number_within(df, ["g"], ["o", "id"], out="rn", n_buckets=7)
    w = Window.partitionBy("g").orderBy("o", "id")
    plain = df.withColumn("rn", F.row_number().over(w))
    assert rows(fast.select("id", "rn")) == rows(plain.select("id", "rn"))


def test_running_sum_matches_window(spark):
    df = _data(spark, seed=11)
    fast = running_sum(df, ["g"], [F.col("o").desc(), "id"], value="v", out="cs", n_buckets=5)
    w = (Window.partitionBy("g").orderBy(F.col("o").desc(), "id")
         .rowsBetween(Window.unboundedPreceding, 0))
    plain = df.withColumn("cs", F.sum("v").over(w))
    assert rows(fast.select("id", "cs")) == rows(plain.select("id", "cs"))


def test_global_running_sum(spark):
    df = _data(spark, seed=3)
    fast = running_sum(df, [], ["o", "id"], value="v", out="cs", n_buckets=9)
    w = Window.orderBy("o", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("cs", F.sum("v").over(w))
    assert rows(fast.select("id", "cs")) == rows(plain.select("id", "cs"))


def test_pareto_ties_are_rows_not_range(spark):
    df = spark.createDataFrame([("a", 5), ("b", 1), ("c", 1)], "CAMPAIGN_GROUP string, NEW_ARR_FROM_OB_ALL_TIME long")
    got = [(r.CAMPAIGN_GROUP, r.CUMULATIVE_NEW_ARR) for r in pareto(df).orderBy("CUMULATIVE_NEW_ARR").collect()]
    assert got == [("a", 5), ("b", 6), ("c", 7)]


def test_pareto_scalable_equals_plain(spark):
    from touchline.operators.cleaning import clean
    from touchline.plans import inputs
    ob = clean(inputs.outbound(spark, "/root/testdata/sf0.01"))
    cols = ["CAMPAIGN_GROUP", "CUMULATIVE_NEW_ARR", "COLOR_LABEL"]
    assert rows(pareto(ob, n_buckets=6).select(cols)) == rows(pareto_plain(ob).select(cols))


def test_empty_inputs(spark):
    from touchline.operators.quantiles import exact_quantiles
    empty = spark.createDataFrame([], "id long, g string, o long, v long")
    assert running_sum(empty, ["g"], ["o", "id"], value="v", out="cs").count() == 0
    assert row_number_within(empty, [], ["id"], out="rn").count() == 0
    assert exact_quantiles(empty, ["g"], "v", {"p50": 0.5}).count() == 0
    ob = spark.createDataFrame([], "CAMPAIGN_GROUP string, NEW_ARR_FROM_OB_ALL_TIME long")
    assert pareto(ob).count() == 0


def test_single_value_quantiles(spark):
    from touchline.operators.quantiles import exact_quantiles
    df = spark.createDataFrame([("a", 7.0)], "g string, v double")
    r = exact_quantiles(df, ["g"], "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75}).first()
    assert (r.p25, r.p50, r.p75) == (7.0, 7.0, 7.0)


def test_running_by_pieces_matches_window(spark):
    from touchline.operators.sequence import running_by_pieces
    df = _data(spark).withColumn("v", F.col("id") % 7).filter("g is not null")
    w = Window.partitionBy("g").orderBy("o", "id")
    plain = df.select("*", F.row_number().over(w).alias("rn"), F.sum("v").over(
        w.rowsBetween(Window.unboundedPreceding, 0)).alias("cs"), F.count("*").over(Window.partitionBy("g")).alias("n"))
    piece = F.floor(F.col("o") / 2)
    a = running_by_pieces(df, ["g"], ["o", "id"], piece, "rn", total_out="n")
    b = running_by_pieces(df, ["g"], ["o", "id"], piece, "cs", value="v")
    assert rows(a.select("g", "id", "rn", "n")) == rows(plain.select("g", "id", "rn", "n"))
    assert rows(b.select("g", "id", "cs")) == rows(plain.select("g", "id", "cs"))


def _many_ties(spark):
    """A third of all rows share the leading value; nulls on both columns."""
    rnd = random.Random(5)
    data = [(i, 7 if i % 3 == 0 else None if i % 50 == 1 else rnd.randint(-40, 40),
             None if i % 61 == 0 else f"n{rnd.randint(0, 10**6):06d}", rnd.randint(-5, 50)) for i in range(4000)]
    return spark.createDataFrame(data, "id long, m long, name string, v long")


def test_running_in_order_matches_window(spark):
    from touchline.operators.sequence import running_in_order
    df = _many_ties(spark)
    w = Window.orderBy(F.col("m").desc_nulls_last(), F.col("name").asc_nulls_last(), "id")
    plain = df.select("*", F.row_number().over(w).alias("rn"), F.sum("v").over(
        w.rowsBetween(Window.unboundedPreceding, 0)).alias("cs"), F.sum("v").over(Window.partitionBy()).alias("tot"))
    order = [("m", "desc"), ("name", "asc_nulls_last"), "id"]
    for pieces in (None, 1, 40):
        a = running_in_order(df, order, "rn", pieces=pieces)
        b = running_in_order(df, order, "cs", value="v", total_out="tot", pieces=pieces)
        assert a.columns == [*df.columns, "rn"]
        assert rows(a.select("id", "rn")) == rows(plain.select("id", "rn"))
        assert rows(b.select("id", "cs", "tot")) == rows(plain.select("id", "cs", "tot"))


def test_descending_numbers_of_each_type(spark):
    from touchline.operators.sequence import running_in_order
    values = ["-9223372036854775808", "9223372036854775807", "0", "-1", "5", None]
    for kind in ("long", "decimal(38,10)", "double"):
        more = ["nan", "-0.0", "inf", "-inf"] if kind == "double" else []
        df = spark.createDataFrame([(i, x) for i, x in enumerate([*values, *more])], "id long, t string") \
            .withColumn("x", F.expr(f"try_cast(t as {kind})"))
        want = df.withColumn("rn", F.row_number().over(Window.orderBy(F.col("x").desc_nulls_last(), "id")))
        assert rows(running_in_order(df, [("x", "desc"), "id"], "rn").select("id", "rn")) == rows(want.select("id", "rn"))


def test_running_in_order_cuts_shared_values(spark):
    """No piece holds much more than its share, though a third of the rows share a value."""
    from touchline.operators import sequence as S
    df = _many_ties(spark).withColumnRenamed("id", "a.b")
    sizes = []
    inner = S.running_by_pieces

    def spy(placed, *args, **kw):
        sizes.extend(r["count"] for r in placed.groupBy("_at").count().collect())
        return inner(placed, *args, **kw)

    S.running_by_pieces = spy
    try:
        got = S.running_in_order(df, [("m", "desc"), "name", "a.b"], "rn", pieces=20)
    finally:
        S.running_by_pieces = inner
    assert got.count() == 4000 and got.columns[0] == "a.b"
    assert len(sizes) >= 15 and max(sizes) < 3 * 4000 / 20


def test_numbering_runs_nothing_while_planned_and_shares_one_exchange(spark, tmp_path):
    from touchline.operators.sequence import running_in_order
    _many_ties(spark).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    sc = spark.sparkContext
    sc.setJobGroup("planning", "")
    try:
        out = running_in_order(df, [("m", "desc"), "name", "id"], "cs", value="v", total_out="tot")
        pareto(df.selectExpr("name CAMPAIGN_GROUP", f"m {ARR}"))
        assert list(sc.statusTracker().getJobIdsForGroup("planning")) == []
    finally:
        sc._jsc.clearJobGroup()
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    # count, sample and rows all come from the one exchange of the rows
    assert plan.count("ReusedExchange [_k__deal") >= 2 and "Checkpoint" not in plan
    empty = running_in_order(df.limit(0), ["id"], "rn")
    assert empty.count() == 0
