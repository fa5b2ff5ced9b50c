"""Property checks of the custom scale operators against their plain forms."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators.joins import lookback_join
from touchline.operators.sequence import running

from conftest import rows

SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

events = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 20 * 86400)), min_size=1, max_size=60)


@SETTINGS
@given(orders=events, touches=events, days=st.sampled_from([0.5, 1, 3, 7]))
def test_lookback_join_property(spark, orders, touches, days):
    o = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(orders)], "oid long, u long, ots long")
    t = spark.createDataFrame([(i, u, s) for i, (u, s) in enumerate(touches)], "tid long, tu long, tts long")
    w = int(round(days * 86400))
    fast = lookback_join(o, t, [("u", "tu")], "ots", "tts", days).select("oid", "tid")
    brute = o.join(t, (o.u == t.tu) & (t.tts <= o.ots) & (t.tts >= o.ots - w)).select("oid", "tid")
    assert rows(fast) == rows(brute)


@SETTINGS
@given(data=st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 5),
                               st.integers(-9, 9)), min_size=1, max_size=80),
       buckets=st.integers(1, 9))
def test_running_sum_property(spark, data, buckets):
    df = spark.createDataFrame([(i, g, o, v) for i, (g, o, v) in enumerate(data)],
                               "id long, g string, o long, v long")
    fast = running(df, ["g"], ["o", "id"], out="cs", value="v", n_buckets=buckets, total_out="tot")
    w = Window.partitionBy("g").orderBy("o", "id")
    plain = (df.withColumn("cs", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("tot", F.sum("v").over(Window.partitionBy("g"))))
    assert rows(fast.select("id", "cs", "tot")) == rows(plain.select("id", "cs", "tot"))
