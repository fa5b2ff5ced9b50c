import gzip
import hashlib

import pytest
from common import table
from pyspark.sql import functions as F

from touchline.llm import warc as W

BIG = "<p>" + "x" * 150 + "</p>"
PAGES = [
    (1, "http://a/", "short"), (2, "http://a/", "short"), (3, "http://b/", BIG), (9, "http://c/", BIG),
    (5, "http://d/\r\nX: y", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9),
    (6, None, None), (7, "", ""), (8, "http://é/", "日本" * 60), (10, "u", "日本" * 60),
    (10, "u", "日本" * 60), (None, "n", BIG), (11, "l", "<html>" * 60_000),
    (12, "e", "y" * 99), (13, "e", "y" * 99), (14, "e", "y" * 100), (15, "e", "y" * 100),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns(
        {"payload": F.lit(1), "digest": F.lit("x")}).repartition(3)


def truth(rows):
    full = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, b in full:
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, b in full:
        again = i is not None and b in first and i > first[b]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(),
                    "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    caps = W.archive(frame(spark), str(tmp_path / "w"), payloads=True)
    r = F.col("response")
    got = caps.select(r["page_id"].alias("a"), r["payload_bytes"].alias("b"), r["digest"].alias("c"),
                      r["type"].alias("d"), r["refers_to_page"].alias("e"))
    assert table(got) == truth(PAGES)
    # One request and one metadata record each, joined by concurrent-to.
    assert caps.filter("request is null or metadata is null").count() == 0
    assert caps.filter("request.record_id = metadata.record_id").count() == 0
    ids = [x[0] for x in caps.select("capture_id").collect()]
    assert len(set(ids)) == len(ids) == len(PAGES)
    # Payloads come back byte by byte; revisits point at a response's record.
    want = {i: (h or "").encode() for i, _, h in PAGES}
    for row in caps.filter("response.type = 'response'").select("response.*").collect():
        if row["page_id"] is not None:
            assert bytes(row["payload"]) == want[row["page_id"]]
    refs = {x[0] for x in caps.filter("response.type = 'revisit'").select("response.refers_to").collect()}
    assert refs <= set(ids)


def test_orphans_stay(spark, tmp_path):
    caps = W.archive(frame(spark, PAGES[:3]), str(tmp_path / "w"))
    records = W.read_warc(spark, str(tmp_path / "w"))
    assert records.count() == 9 and caps.count() == 3
    part = W.assemble(records.filter("type = 'request'"))
    assert part.filter("response is null and request is not null").count() == 3


def test_reader_goes_by_length():
    def rec(block, extra=b""):
        return (b"WARC/1.1\r\nWARC-Type: resource\r\n" + extra + b"Content-Length: %d\r\n\r\n" % len(block)
                + block + b"\r\n\r\n")
    blocks = [b"", b"\r\n\r\nWARC/1.1\r\n", b"z" * (5 << 20), b"end"]
    raw = b"".join(map(rec, blocks))
    for content in (raw, gzip.compress(raw), b"".join(gzip.compress(rec(b)) for b in blocks)):
        assert [b for _, b in W.parse_records(content)] == blocks
    assert list(W.parse_records(b"")) == []
    for bad in (raw[:-9], b"nonsense\r\n\r\n", raw[:20]):
        with pytest.raises(ValueError):
            list(W.parse_records(bad))


def test_empty_table(spark, tmp_path):
    assert W.archive(frame(spark).limit(0), str(tmp_path / "w")).count() == 0


def test_several_records_and_links_of_a_capture(spark, tmp_path):
    def rec(kind, rid, *to):
        head = "".join(f"WARC-Concurrent-To: <{t}>\r\n" for t in to)
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{rid}>\r\n{head}Content-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc").write_bytes("".join([
        rec("revisit", "r1"), rec("revisit", "r2"), rec("request", "q2", "r1"), rec("request", "q1", "r1"),
        rec("metadata", "m1", "r1", "r2", "r1"), rec("metadata", "m2", "r1"), rec("metadata", "m3")]).encode())
    got = W.assemble(W.read_warc(spark, str(tmp_path))).select(
        "capture_id", "response.record_id", "request.record_id", "metadata.record_id").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {
        "<r1>": ("<r1>", ["<q1>", "<q2>"], ["<m1>", "<m2>"]), "<r2>": ("<r2>", None, ["<m1>"]),
        "<m3>": (None, None, ["<m3>"])}
