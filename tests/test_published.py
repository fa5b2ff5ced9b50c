"""Published tables and the mart that is maintained from new log parts."""

import tempfile

import pytest
from pyspark.sql import functions as F

from touchline.operators import attribution as att
from touchline.plans import inputs
from touchline.plans.marts import MaintainedModel
from touchline.sources import published as P

from conftest import SF001, rows


def _folder():
    return tempfile.mkdtemp(prefix="tl-pub-", dir="/tmp") + "/t"


def test_publish_replace_append_and_versions(spark):
    path = _folder()
    with pytest.raises(FileNotFoundError):
        P.read_published(spark, path)
    assert P.publish(spark.range(3), path) == 1
    assert P.publish(spark.range(3, 5), path, append=True) == 2
    assert P.publish(spark.range(9, 10), path) == 3
    assert rows(P.read_published(spark, path)) == [(9,)]
    assert rows(P.read_published(spark, path, 2)) == [(i,) for i in range(5)]
    assert P.expire(spark, path, keep=1) == 2
    assert rows(P.read_published(spark, path)) == [(9,)] and P.published_version(spark, path) == 3


def test_a_stop_between_the_steps_leaves_the_table_whole(spark, monkeypatch):
    path = _folder()
    P.publish(spark.range(3), path)

    def stop(*args):
        raise RuntimeError("stopped")

    monkeypatch.setattr(P, "_name", stop)
    with pytest.raises(RuntimeError):
        P.publish(spark.range(100), path)
    monkeypatch.undo()
    assert rows(P.read_published(spark, path)) == [(i,) for i in range(3)]
    # A manifest that is still being written is passed over.
    for text in (b"", b"data-x\n", b"data-x\nfolders 1"):
        with open(f"{path}/{P.PREFIX}{2:08d}", "wb") as fh:
            fh.write(text)
        assert P.published_version(spark, path) == 1
    assert P.expire(spark, path) == 1


def test_the_second_writer_of_a_version_fails(spark):
    path = _folder()
    P.publish(spark.range(1), path)
    P._name(spark, path, 2, ["data-a"])
    with pytest.raises(Exception, match="exist"):
        P._name(spark, path, 2, ["data-b"])


def test_a_job_that_fails_publishes_nothing(spark):
    path = _folder()
    P.publish(spark.range(2), path)
    bad = spark.range(2).select(F.raise_error(F.lit("no")).cast("bigint").alias("id"))
    with pytest.raises(Exception):
        P.publish(bad, path)
    assert rows(P.read_published(spark, path)) == [(0,), (1,)]


def test_maintained_model_equals_the_full_build(spark):
    ev = inputs.events(spark, SF001)
    mart = MaintainedModel(spark, _folder())
    parts = [ev.filter(F.col("event_id") % 3 == k) for k in range(3)]
    mart.add(parts[0])
    assert rows(mart.last_touch()) == rows(att.last_touch(parts[0], 90))
    mart.add(parts[1])
    mart.add(parts[2])
    mart.add(parts[1])          # a part that comes twice
    want = rows(att.attribution_report(att.last_touch(ev, 90), ordered=False))
    assert rows(mart.refresh()) == want
    mart.compact(keep=1)
    assert rows(mart.refresh()) == want
