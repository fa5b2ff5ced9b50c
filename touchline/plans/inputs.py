"""Input relations of the end-to-end jobs, built from the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.sources import fixtures
from touchline.sources.events import event_table


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON event log (column DATA)."""
    return fixtures.pixel_log(spark, sf_dir)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed events: the log parsed once, fields read by JSON path."""
    return event_table(event_log(spark, sf_dir))


def outbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.outbound(spark, sf_dir)


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.market(spark, sf_dir)


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.tenants(spark, sf_dir)


def outbound_text(spark: SparkSession, sf_dir: str, dirty: bool = True) -> DataFrame:
    return fixtures.outbound_text(spark, sf_dir, dirty)


def store_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.store_tenants(spark, sf_dir)
