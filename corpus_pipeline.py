"""Corpus pipeline: stages over ``documents``, each written and read again."""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline.session import ensure_checkpoint_dir

# Least length of a passage that the dedup stage takes for a repeat: 51 words of
# 5.5 bytes each, separators included.
PASSAGE_BYTES = 280

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from ``labels``."""
    from touchline.llm import toxicity as op
    return op.remove_toxic(docs, op.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    from touchline.llm.jaccard_join import keep_one
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of ``PASSAGE_BYTES`` or more are cut out of the texts;
    all documents stay."""
    from touchline.llm.suffix_dedup import remove_repeats
    return remove_repeats(docs, span=PASSAGE_BYTES)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    from touchline.llm.decontaminate import remove_contaminated
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by target weight: a row per copy taken."""
    from touchline.llm.mixing import mix, mixed_rows
    return mixed_rows(mix(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

# The label model and the hashed cuts of the mix have no SQL form; tests hold
# the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; every stage's result is written
    as Parquet in the shared checkpoint folder and read again by the next, so
    a lost executor costs one stage's tasks at most."""
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
