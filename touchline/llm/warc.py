"""WARC archives: write captures, read them back, assemble transactions.

Writing is a Spark text sink whose line separator is the blank line that ends
every WARC record, so archives go to any store that Spark writes to.  Reading
goes by Content-Length, never by separators.  Records of one capture carry
``WARC-Concurrent-To`` and are joined by it into one nested row.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.session import ensure_checkpoint_dir

EOL = "\r\n"
REVISIT_FROM = 100      # smaller payloads are always stored in full
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
ARCHIVE_ROWS = 10_000   # captures per archive file at most

RECORD_SCHEMA = ("type string, record_id string, concurrent_to array<string>, refers_to string, "
                 "uri string, page_id bigint, refers_to_page bigint, header_digest string, "
                 "digest string, payload_bytes bigint, payload binary")


def capture_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  body_col: str = "html") -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: which captures revisit.

    Of records with equal payloads of at least ``REVISIT_FROM`` bytes that
    with the smallest id is the response and the others revisit it; smaller
    payloads are all responses.  A null body is empty.  Rows with a null id
    are responses; rows that repeat the smallest id are responses too.

    Only digests and ids meet by payload, so a payload held by a third of all
    pages costs one small row per page; bodies are joined by row id.
    """
    src = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(body_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    keyed = (src.filter(F.col("page_id").isNotNull()
                        & (F.octet_length("payload") >= REVISIT_FROM))
             .select("page_id", F.sha2("payload", 256).alias("digest")))
    first = (keyed.groupBy("digest").agg(F.min("page_id").alias("first"),
                                         F.max("page_id").alias("last"))
             .filter(F.col("first") < F.col("last")))
    # A page may hold several rows of one id with different bodies.
    revisits = (keyed.join(first, "digest").filter(F.col("page_id") > F.col("first"))
                .select("page_id", "digest", F.col("first").alias("refers_to"))
                .groupBy("page_id", "digest").agg(F.min("refers_to").alias("refers_to"))
                .withColumnsRenamed({"page_id": "r_id", "digest": "r_digest"}))
    src = src.withColumn("digest", F.sha2("payload", 256))
    return (src.join(revisits, (F.col("page_id") == F.col("r_id"))
                     & (F.col("digest") == F.col("r_digest")), "left")
            .select("page_id", "url", "payload", "digest", "refers_to"))


def _urn(tag: str, *parts: Column) -> Column:
    """Name-based record id: the same row gives the same id on every run."""
    h = F.md5(F.concat_ws("|", F.lit(tag), *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cut)),
                    F.lit(">"))


def _one_line(c: Column) -> Column:
    """Header values cannot hold line breaks."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")


def _record(kind: str, rid: Column, fields: list, block: Column) -> Column:
    """Bytes of one record but its closing blank line."""
    lines: list = [F.lit(f"WARC/1.1{EOL}WARC-Type: {kind}{EOL}WARC-Date: {DATE}{EOL}WARC-Record-ID: "),
                   rid, F.lit(EOL)]
    for name, value in fields:
        lines.append(F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(EOL)), F.lit("")))
    lines += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(EOL + EOL)]
    return F.concat(F.encode(F.concat(*lines), "UTF-8"), block)


def write_warc(captures: DataFrame, path: str) -> None:
    """Write request, response or revisit, and metadata record of every row
    of ``capture_roles`` as gzip-compressed archives in folder ``path``.

    ``page_id`` and the digest name the records; a null url is written as an
    empty target.
    """
    # Rows that agree in id and body are told apart by their number, so ids are unique.
    rows = Window.partitionBy("page_id", "digest").orderBy("refers_to")
    c = captures.withColumn("nth", F.row_number().over(rows))
    rid = _urn("capture", F.col("page_id"), F.col("digest"), F.col("nth"))
    uri = _one_line(F.col("url"))
    revisit = F.col("refers_to").isNotNull()
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    http_ok = F.encode(F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
        F.octet_length("payload").cast("string"), F.lit(EOL + EOL)), "UTF-8")
    shared = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest)]
    page = ("X-Page-Id", F.col("page_id").cast("string"))
    http = F.lit("application/http; msgtype=response")
    full = _record("response", rid, [*shared, page, ("Content-Type", http)],
                   F.concat(http_ok, F.col("payload")))
    again = _record("revisit", rid, [
        *shared, page, ("WARC-Refers-To", _urn("capture", F.col("refers_to"), F.col("digest"), F.lit(1))),
        ("X-Refers-To-Page", F.col("refers_to").cast("string")),
        ("WARC-Profile", F.lit(PROFILE)), ("Content-Type", http)], http_ok)
    request = _record("request", _urn("request", rid),
                      [("WARC-Target-URI", uri), ("WARC-Concurrent-To", rid),
                       ("Content-Type", F.lit("application/http; msgtype=request"))],
                      F.encode(F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{EOL}{EOL}")), "UTF-8"))
    meta = _record("metadata", _urn("metadata", rid),
                   [("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/warc-fields"))],
                   F.encode(F.concat(F.lit("via: "), uri, F.lit(EOL)), "UTF-8"))
    end = F.encode(F.lit(EOL + EOL), "UTF-8")
    body = F.concat(request, end, F.when(revisit, again).otherwise(full), end, meta)
    # The text sink takes strings; these bytes pass through it unchanged.
    (c.select(body.cast("string").alias("value")).write
      .option("lineSep", EOL + EOL).option("compression", "gzip")
      .option("maxRecordsPerFile", ARCHIVE_ROWS).text(path))


# ------------------------------------------------------------------ reading

def _plain(content: bytes) -> Iterator[bytes]:
    """Bytes of an archive in pieces; any number of gzip members, or none."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    rest = memoryview(content)
    while len(rest):
        unzip = zlib.decompressobj(31)
        while len(rest):
            piece, rest = rest[:1 << 20], rest[1 << 20:]
            yield unzip.decompress(piece)
            if unzip.eof:
                rest = memoryview(unzip.unused_data + bytes(rest))
                break


def parse_records(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields (names in lower case, all values of each in order) and
    block of every record."""
    pieces, buf, at = _plain(content), bytearray(), 0

    def fill(upto: int) -> bool:
        while len(buf) < upto:
            piece = next(pieces, None)
            if piece is None:
                return False
            buf.extend(piece)
        return True

    while True:
        if at > 1 << 22:
            del buf[:at]
            at = 0
        if not fill(at + 1):
            return
        seen = at
        while (cut := buf.find(b"\r\n\r\n", max(at, seen - 3))) < 0:
            seen = len(buf)
            if not fill(seen + 1):
                raise ValueError("archive ends inside a header")
        head = buf[at:cut].decode("utf-8", "replace").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError("not a record: " + head[0][:40])
        fields: dict[str, list[str]] = {}
        for line in head[1:]:
            name, _, value = line.partition(":")
            fields.setdefault(name.strip().lower(), []).append(value.strip())
        begin, n = cut + 4, int(fields["content-length"][-1])
        if not fill(begin + n + 4):
            raise ValueError("archive ends inside a record")
        yield fields, bytes(buf[begin:begin + n])
        at = begin + n + 4


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record of the archives in ``path`` (``RECORD_SCHEMA``).

    For a response, size and SHA-256 are computed from the stored payload and
    must agree with its header; a revisit's come from its headers.  Payload
    bytes are returned only with ``payloads``.  A damaged archive raises.
    """
    from pyspark.sql.types import _parse_datatype_string  # only for the Arrow schema
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(_parse_datatype_string(RECORD_SCHEMA))
    names = schema.names

    def row(fields: dict, block: bytes) -> dict:
        f = {name: values[-1] for name, values in fields.items()}
        kind = f.get("warc-type")
        out = dict.fromkeys(names)
        out.update(type=kind, record_id=f.get("warc-record-id"), uri=f.get("warc-target-uri"),
                   concurrent_to=fields.get("warc-concurrent-to"), refers_to=f.get("warc-refers-to"),
                   page_id=int(f["x-page-id"]) if "x-page-id" in f else None,
                   refers_to_page=int(f["x-refers-to-page"]) if "x-refers-to-page" in f else None)
        out["header_digest"] = (f.get("warc-payload-digest") or "").removeprefix("sha256:") or None
        if kind in ("response", "revisit"):
            head, _, body = block.partition(b"\r\n\r\n")
            sizes = [int(x.split(b":")[1]) for x in head.split(b"\r\n")
                     if x.lower().startswith(b"content-length:")]
            out["payload_bytes"] = sizes[0] if sizes else len(body)
            out["digest"] = out["header_digest"]
            if kind == "response":
                out["digest"] = hashlib.sha256(body).hexdigest()
                if out["payload_bytes"] != len(body) or out["digest"] != out["header_digest"]:
                    raise ValueError("payload differs from its header: " + str(out["record_id"]))
                out["payload"] = body if payloads else None
        return out

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                held = 0
                for fields, block in parse_records(content.as_py()):
                    rows.append(row(fields, block))
                    held += len(rows[-1]["payload"] or b"")
                    if len(rows) >= 4096 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, response, request, metadata``.

    Records meet by ``WARC-Concurrent-To`` (a response or revisit stands for
    itself); a record that names several captures is part of each.  Requests
    and metadata are arrays of all such records in order of record id, as a
    capture may have several.  A part that is missing is null, so a request
    without a response still gives a row.  If several responses name one
    capture, that with the smallest record id is nested.
    """
    part = F.struct("record_id", *(c for c in records.columns
                                   if c not in ("record_id", "concurrent_to")))

    def every(kind: str) -> Column:
        found = F.sort_array(F.collect_list(F.when(F.col("type") == kind, part)))
        return F.when(F.size(found) > 0, found)

    captures = F.when(F.size("concurrent_to") > 0, F.array_distinct("concurrent_to")).otherwise(
        F.array("record_id"))
    return (records.withColumn("capture_id", F.explode(captures)).groupBy("capture_id")
            .agg(F.min(F.when(F.col("type").isin("response", "revisit"), part)).alias("response"),
                 every("request").alias("request"), every("metadata").alias("metadata")))


def archive(pages: DataFrame, path: str | None = None, payloads: bool = False) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as archives and read them back
    as assembled captures.  Without ``path`` a new folder in the shared
    checkpoint folder is taken; it must outlive the returned frame.

    An empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(capture_roles(pages), path)
    return assemble(read_warc(spark, path, payloads))
