"""Table-set loading (every table of a store into a name -> DataFrame map),
reuse between queries and result output."""

from __future__ import annotations

import os
import uuid
from typing import Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, base: str, name: str, schema=None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(os.path.join(base, f"{name}.parquet"))


def load_tables(spark: SparkSession, base: str | None = None,
                names: Iterable[str] | None = None,
                database: str | None = None) -> dict[str, DataFrame]:
    """Every table of a store, lazily (``SELECT *`` with the stored schema).

    ``base`` is a folder of ``<name>.parquet`` datasets; with ``database``
    the catalog is listed instead.  Nothing is read until a query runs, and
    column pruning / filter pushdown still reach each scan.
    """
    if database is not None:
        tables = [t.name for t in spark.catalog.listTables(database)]
        wanted = set(names) if names else None
        return {t: spark.table(f"{database}.{t}") for t in tables
                if wanted is None or t in wanted}
    if base is None:
        raise ValueError("give base or database")
    if names is None:
        fs, at = _file_system(spark, base)
        found = [f.getPath().getName() for f in fs.listStatus(at(base))]
        names = sorted(e[:-len(".parquet")] for e in found if e.endswith(".parquet"))
    return {n: read_table(spark, base, n) for n in names}


def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Keep a dataset that several queries read.  Lazy; lost blocks are
    recomputed from lineage, so losing an executor costs time, not rows."""
    return df.persist(level)


def write_result(df: DataFrame, path: str, mode: str = "overwrite",
                 partition_by: Iterable[str] | None = None,
                 sort_within: Iterable[str] | None = None) -> None:
    """Write a result as parquet.

    An overwrite goes to a new folder beside ``path`` first; only when that
    job has committed do two renames put it in place, so a failed job leaves
    the old result as it was.  Between the renames ``path`` is missing for a
    moment, as stores without an atomic folder exchange allow no better.
    """
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)

    def write(to: str, how: str) -> None:
        writer = df.write.mode(how)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(to)

    if mode != "overwrite":
        return write(path, mode)
    tag = uuid.uuid4().hex
    fresh, old = f"{path}.new-{tag}", f"{path}.old-{tag}"
    write(fresh, "error")
    fs, at = _file_system(df.sparkSession, path)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    if not fs.rename(at(fresh), at(path)):
        raise OSError(f"could not put {fresh} in place of {path}")
    fs.delete(at(old), True)


def _file_system(spark: SparkSession, path: str):
    """Hadoop file system of a path (any store Spark knows) and its paths."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(conf), at
