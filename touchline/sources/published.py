"""Published tables: data folders that are never changed, and a manifest that
names those which make up the table.

    <path>/data-<id>/            one per write, complete before it is named
    <path>/_manifest-00000007    the folders of version 7, one per line

A version is published by creating the next manifest, a small file that must not
exist yet: readers see the old version or the new one, never a mixture and
never a missing table, on any store that Hadoop reaches.  Of two writers of one
version the second fails and may try again.  A manifest ends with a line that
counts its folders, so one that is still being written is passed over.
"""

from __future__ import annotations

import uuid
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession

from touchline.sources.tables import _file_system

PREFIX = "_manifest-"


def _versions(spark: SparkSession, path: str) -> list[tuple[int, list[str]]]:
    """Complete versions (number, folders), oldest first."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at(path)):
        return []
    out = []
    for f in fs.listStatus(at(path)):
        name = f.getPath().getName()
        if not name.startswith(PREFIX):
            continue
        stream = fs.open(f.getPath())
        try:
            lines = bytes(stream.readAllBytes()).decode().split("\n")
        finally:
            stream.close()
        if len(lines) >= 2 and lines[-1] == "" and lines[-2] == f"folders {len(lines) - 2}":
            out.append((int(name[len(PREFIX):]), lines[:-2]))
    return sorted(out)


def published_version(spark: SparkSession, path: str) -> int | None:
    found = _versions(spark, path)
    return found[-1][0] if found else None


def publish(df: DataFrame, path: str, append: bool = False,
            partition_by: Iterable[str] | None = None) -> int:
    """Write ``df`` to a folder of its own and make it the table (``append``:
    a further part of it).  Gives the version's number.  A failure before the
    last step leaves the table as it was."""
    spark = df.sparkSession
    found = _versions(spark, path)
    number, folders = found[-1] if found else (0, [])
    name = f"data-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/{name}")
    _name(spark, path, number + 1, [*folders, name] if append else [name])
    return number + 1


def _name(spark: SparkSession, path: str, number: int, folders: list[str]) -> None:
    fs, at = _file_system(spark, path)
    text = "".join(f"{x}\n" for x in [*folders, f"folders {len(folders)}"])
    stream = fs.create(at(f"{path}/{PREFIX}{number:08d}"), False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of its last version, or of ``version``."""
    found = dict(_versions(spark, path))
    if not found:
        raise FileNotFoundError(f"nothing is published at {path}")
    folders = found[max(found) if version is None else version]
    out = None
    for x in folders:
        part = spark.read.parquet(f"{path}/{x}")
        out = part if out is None else out.unionByName(part)
    return out


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete versions before the last ``keep`` and folders that no remaining
    manifest names.  Not for times when another writer is at work: its folder
    has no manifest yet.  Gives the number of folders deleted."""
    fs, at = _file_system(spark, path)
    found = _versions(spark, path)
    held = {x for _, folders in found[-keep:] for x in folders}
    for number, _ in found[:-keep]:
        fs.delete(at(f"{path}/{PREFIX}{number:08d}"), False)
    gone = 0
    for f in fs.listStatus(at(path)) if found else []:
        name = f.getPath().getName()
        if name.startswith("data-") and name not in held:
            fs.delete(f.getPath(), True)
            gone += 1
    return gone
