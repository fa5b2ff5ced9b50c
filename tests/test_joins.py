import random

from pyspark.sql import functions as F

from touchline.operators.joins import lookback_join, with_brand

from conftest import rows


def test_lookback_join_equals_brute_force(spark):
    rnd = random.Random(5)
    o = spark.createDataFrame([(i, rnd.randint(0, 3), rnd.randint(0, 40 * 86400)) for i in range(150)],
                              "oid long, u long, ots long")
    t = spark.createDataFrame([(i, rnd.randint(0, 3), rnd.randint(0, 40 * 86400)) for i in range(600)],
                              "tid long, tu long, tts long")
    fast = lookback_join(o, t, [("u", "tu")], "ots", "tts", 3).select("oid", "tid")
    brute = o.join(t, (o.u == t.tu) & (t.tts <= o.ots) & (t.tts >= o.ots - 3 * 86400)).select("oid", "tid")
    assert rows(fast) == rows(brute)
    assert fast.count() > 0


def test_lookback_join_timestamps(spark):
    o = spark.createDataFrame([(1, 7, "2024-01-04 00:00:00")], "oid long, u long, ots string") \
        .withColumn("ots", F.col("ots").cast("timestamp_ntz"))
    t = spark.createDataFrame([(1, 7, "2024-01-01 00:00:00"), (2, 7, "2023-12-31 23:59:59"),
                               (3, 7, "2024-01-04 00:00:01")], "tid long, tu long, tts string") \
        .withColumn("tts", F.col("tts").cast("timestamp_ntz"))
    got = [r.tid for r in lookback_join(o, t, [("u", "tu")], "ots", "tts", 3).collect()]
    assert got == [1]


def test_with_brand(spark):
    rep = spark.createDataFrame([("s1", 3), ("s2", 4), ("s9", 1)], "STORE string, n long")
    ten = spark.createDataFrame([("s1", 10), ("s2", 20)], "shopify_url string, tenant_id long")
    got = sorted(tuple(r) for r in with_brand(rep, ten).collect())
    assert got == [("s1", 3, 10), ("s2", 4, 20)]
