"""Intermediate tables on shared storage, and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import ensure_checkpoint_dir


ROWS_A_FILE = 200_000         # of narrow tables whose size is known


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it
    back: the lineage ends there, and a lost executor loses no finished work.
    With a bound of its ``rows``, a narrow table is written by as few tasks as
    its size asks for."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_A_FILE)
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``): the smallest node
    of its component.

    Each round takes the smallest label among neighbours and then follows it
    (pointer jumping); rounds end when no label changes.  Labels and edges
    stay distributed, each round is written to shared storage, and a node with
    very many neighbours is aggregated before the shuffle.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
                  .filter("a <> b").distinct(), "cc-edges", 2 * edges.count())
    rows = both.count()               # nodes are as many at most
    labels = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root"))
                    .withColumnRenamed("a", "node"), "cc-labels", rows)
    while True:
        near = (both.join(labels, both["b"] == labels["node"])
                .groupBy("a").agg(F.min("root").alias("near")))
        step = (labels.join(near, labels["node"] == near["a"])
                .select("node", "root", F.least("root", "near").alias("new")))
        target = labels.select(F.col("node").alias("t"), F.col("root").alias("t_root"))
        moved = staged(step.join(target, step["new"] == target["t"])
                       .select("node", "root", F.least("new", "t_root").alias("new")), "cc-labels", rows)
        changed = moved.filter("new <> root").limit(1).count()
        labels = moved.select("node", F.col("new").alias("root"))
        if not changed:
            return labels
