import json
import os
import random
import tempfile

import pytest

from touchline.operators import attribution as att
from touchline.plans import inputs
from touchline.sources.events import event_table, read_events
from touchline.sources.json_arrays import read_documents

from conftest import SF001, rows


@pytest.fixture
def small_pieces(spark):
    """Pieces of 4 KB, so that a file is cut at hundreds of places."""
    keys = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1k"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def folder():
    return tempfile.mkdtemp(prefix="tl-arrays-", dir="/tmp")


def documents(n, seed=0):
    r = random.Random(seed)
    nasty = ['}', '{', '"', '\\', '\\"', '[{"a":1}]', 'é}ß', '\n', ',', "plain", ""]

    def value(depth):
        k = r.random()
        if k < 0.25 and depth < 3:
            return {r.choice(nasty) + str(i): value(depth + 1) for i in range(r.randrange(3))}
        if k < 0.4 and depth < 3:
            return [value(depth + 1) for _ in range(r.randrange(3))]
        return "".join(r.choice(nasty) for _ in range(r.randrange(6))) if k < 0.8 else r.randrange(100)

    return [{"id": i, "v": value(0), "w": "}{" * r.randrange(3)} for i in range(n)]


def read(spark, path):
    return sorted((json.loads(r.DATA) for r in read_documents(spark, path).collect()), key=lambda d: d["id"])


def test_borders_wherever_a_file_is_cut(spark, small_pieces):
    docs = documents(1500)
    docs[700]["long"] = 'a "quoted" } text { ' * 3000          # one document over many pieces
    d = folder()
    with open(os.path.join(d, "one.json"), "w") as f:
        json.dump(docs[:1000], f, ensure_ascii=False)
    with open(os.path.join(d, "two.json"), "w") as f:
        json.dump([None, *docs[1000:]], f, indent=2)           # null is no document; spread over lines
    with open(os.path.join(d, "none.json"), "w") as f:
        f.write("[]\n")
    open(os.path.join(d, "empty.json"), "w").close()
    assert read_documents(spark, d).inputFiles()
    raw = spark.read.option("lineSep", "}").text(d)
    assert raw.rdd.getNumPartitions() > 20
    assert read(spark, d) == docs


def test_broken_end_and_plain_lines(spark, small_pieces):
    d = folder()
    with open(os.path.join(d, "cut.json"), "w") as f:
        f.write('[{"id": 1}, {"id": 2, "x": {"y": "}"}}, {"id": 3, "x": "never clo')
    with open(os.path.join(d, "lines.json"), "w") as f:
        f.write('{"id": 4}\n{"id": 5}\n')
    got = sorted(r.DATA for r in read_documents(spark, d).collect())
    assert got == ['{"id": 1}', '{"id": 2, "x": {"y": "}"}}', '{"id": 3, "x": "never clo', '{"id": 4}', '{"id": 5}']
    log = read_events(spark, d, fmt="array")
    assert log.filter("DATA is null").count() == 1 and log.count() == 5


def test_array_file_equals_the_line_form(spark, small_pieces):
    d = folder()
    with open(os.path.join(d, "log.json"), "w") as f:
        json.dump([json.loads(r.DATA) for r in inputs.event_log(spark, SF001).collect()], f)
    got = att.orders_per_month_store(event_table(read_events(spark, d, fmt="array")), ordered=False)
    want = att.orders_per_month_store(inputs.events(spark, SF001), ordered=False)
    assert rows(got) == rows(want)
