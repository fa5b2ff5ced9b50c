import os
import tempfile

from touchline.operators import attribution as att
from touchline.plans import inputs
from touchline.plans.marts import build_marts, write_marts
from touchline.sources import load_tables, read_events
from touchline.sources.events import event_table

from conftest import SF001, rows


def test_load_tables_lists_store(spark):
    tables = load_tables(spark, SF001)
    assert {"events", "lineitem", "customer"} <= set(tables)
    assert tables["nation"].count() == 25


def test_read_events_from_json_lines(spark):
    d = tempfile.mkdtemp(prefix="tl-test-", dir="/tmp")
    path = os.path.join(d, "log")
    inputs.event_log(spark, SF001).write.text(path)
    ev = event_table(read_events(spark, path, fmt="text"))
    a = att.orders_per_month_store(ev, ordered=False)
    b = att.orders_per_month_store(inputs.events(spark, SF001), ordered=False)
    assert rows(a) == rows(b)


def test_build_and_write_marts(spark):
    marts = build_marts(inputs.events(spark, SF001))
    assert set(marts) == {"orders_month_store", "attribution_model_90",
                          "attribution_model_180", "attribution_cjm"}
    d = tempfile.mkdtemp(prefix="tl-marts-", dir="/tmp")
    paths = write_marts(marts, d)
    back = spark.read.parquet(paths["attribution_model_90"])
    assert back.count() == marts["attribution_model_90"].count()
    assert set(back.columns) == set(marts["attribution_model_90"].columns)


def test_marts_from_staged_events(spark):
    d = tempfile.mkdtemp(prefix="tl-stage-", dir="/tmp")
    staged = build_marts(inputs.events(spark, SF001), (90,), stage_dir=os.path.join(d, "ev"))
    plain = build_marts(inputs.events(spark, SF001), (90,))
    for name in staged:
        assert rows(staged[name]) == rows(plain[name]), name
    plain.release()


def test_streaming_orders_equals_batch(spark):
    from touchline.streaming import start_orders_per_month_store
    d = tempfile.mkdtemp(prefix="tl-stream-", dir="/tmp")
    inputs.event_log(spark, SF001).write.text(os.path.join(d, "log"))
    q = start_orders_per_month_store(spark, os.path.join(d, "log"), name="oms_test",
                                     checkpoint=os.path.join(d, "ck"))
    q.awaitTermination(300)
    got = spark.table("oms_test")
    want = att.orders_per_month_store(inputs.events(spark, SF001), ordered=False)
    assert rows(got) == rows(want)


def test_read_events_from_json_array_file(spark):
    import json
    d = tempfile.mkdtemp(prefix="tl-jsonarr-", dir="/tmp")
    docs = [json.loads(r.DATA) for r in inputs.event_log(spark, SF001).collect()]
    with open(os.path.join(d, "pixel.json"), "w") as fh:
        json.dump(docs, fh)
    ev = event_table(read_events(spark, d, fmt="json", multi_line=True))
    a = att.orders_per_month_store(ev, ordered=False)
    b = att.orders_per_month_store(inputs.events(spark, SF001), ordered=False)
    assert rows(a) == rows(b)


def test_streaming_resumes_from_checkpoint(spark):
    from pyspark.sql import functions as F
    from touchline.streaming import start_orders_per_month_store
    d = tempfile.mkdtemp(prefix="tl-stream2-", dir="/tmp")
    log = inputs.event_log(spark, SF001)
    with_id = log.withColumn("_id", F.get_json_object("DATA", "$.event_id").cast("bigint"))
    with_id.filter("_id % 2 = 0").select("DATA").write.text(os.path.join(d, "log", "part1"))
    q = start_orders_per_month_store(spark, os.path.join(d, "log", "*"), name="oms_resume",
                                     checkpoint=os.path.join(d, "ck"))
    q.awaitTermination(300)
    with_id.filter("_id % 2 = 1").select("DATA").write.text(os.path.join(d, "log", "part2"))
    q = start_orders_per_month_store(spark, os.path.join(d, "log", "*"), name="oms_resume",
                                     checkpoint=os.path.join(d, "ck"))
    q.awaitTermination(300)
    got = spark.table("oms_resume")
    want = att.orders_per_month_store(inputs.events(spark, SF001), ordered=False)
    assert rows(got) == rows(want)


def test_read_events_from_parquet_variant(spark):
    from touchline.functions.json_paths import parse_json_column
    d = tempfile.mkdtemp(prefix="tl-variant-", dir="/tmp")
    path = os.path.join(d, "log")
    parse_json_column(inputs.event_log(spark, SF001)).write.parquet(path)  # VARIANT column
    log = read_events(spark, path, fmt="parquet")
    assert dict(log.dtypes)["DATA"] == "variant"
    a = att.orders_per_month_store(event_table(log), ordered=False)
    b = att.orders_per_month_store(inputs.events(spark, SF001), ordered=False)
    assert rows(a) == rows(b)
