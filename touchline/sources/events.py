"""The web event log: one JSON document per event in column ``DATA``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.json_paths import extract_fields, field, parse_json_column
from touchline.sources.json_arrays import read_documents

# Fields of one event and their SQL types (fixed values: the field names
# the log carries).
EVENT_FIELDS = {
    "event_id": "bigint",
    "timestamp": "bigint",
    "userId": "string",
    "sessionId": "string",
    "shopifyShopURL": "string",
    "ip": "string",
    "shopifyOrderId": "string",
    "shopifyOrderProcessedAt": "string",
    "shopifyOrderTotalPrice": "decimal(38,10)",
    "shopifyPageType": "string",
    "pageReferrer": "string",
    "utmSource": "string",
    "utmMedium": "string",
    "utmCampaign": "string",
}


def read_events(spark: SparkSession, path: str, fmt: str = "text",
                json_col: str = "DATA", multi_line: bool = False,
                schema=None) -> DataFrame:
    """Read an event log into a one-column DataFrame of VARIANT.

    ``fmt='text'``: JSON lines (one document per line, split across tasks
    by the file source) -- the form to use for large logs.
    ``fmt='json'``: JSON files read by Spark's JSON source (``multi_line``
    for files holding one array of documents; give ``schema`` to skip the
    inference pass), each document turned into a VARIANT object.
    ``fmt='array'``: files that hold one JSON array of documents each, any
    size: many tasks read a file (``json_arrays``).
    ``fmt='parquet'``: a dataset whose ``json_col`` holds JSON text or
    VARIANT.  Malformed documents become NULL.
    """
    if fmt == "text":
        df = spark.read.text(path).select(F.col("value").alias(json_col))
    elif fmt == "json":
        reader = spark.read.option("multiLine", multi_line).option("mode", "PERMISSIVE")
        if schema is not None:
            reader = reader.schema(schema)
        raw = reader.json(path)
        fields = [c for c in raw.columns if c != "_corrupt_record"]
        return raw.select(F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in fields]))
                          .alias(json_col))
    elif fmt == "array":
        df = read_documents(spark, path, json_col)
    elif fmt == "parquet":
        df = spark.read.parquet(path).select(json_col)
    else:
        raise ValueError(f"unknown format {fmt}")
    return parse_json_column(df, json_col)


def unread_values(log: DataFrame, json_col: str = "DATA",
                  fields: dict | None = None) -> DataFrame:
    """Per field, how many documents hold a value that does not fit its type
    (``event_table`` reads those as NULL): one row of counts."""
    log = parse_json_column(log, json_col)
    return log.agg(*[
        F.count_if(field(json_col, name).isNotNull() & field(json_col, name, t).isNull()).alias(name)
        for name, t in (fields or EVENT_FIELDS).items()])


def event_table(log: DataFrame, json_col: str = "DATA",
                fields: dict | None = None) -> DataFrame:
    """Typed flat projection of the log, parsed once."""
    return extract_fields(log, json_col, fields or EVENT_FIELDS)
