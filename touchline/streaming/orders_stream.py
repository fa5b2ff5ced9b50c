"""Orders per (store, month) kept up to date from an append-only JSON log.

Streaming aggregations cannot count distinct values, so the distinct count
is rebuilt from its parts: a streaming de-duplication on (store, month,
order) -- its state holds each key once, partitioned across executors and
saved in the query checkpoint -- followed by a streaming count per
(store, month).  The result equals the batch ``orders_per_month_store`` on
the same files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from touchline.functions.json_paths import parse_json_column
from touchline.functions.text import month_start_text
from touchline.session import ensure_checkpoint_dir
from touchline.sources.events import event_table

FIELDS = {"shopifyShopURL": "string", "shopifyOrderId": "string",
          "shopifyOrderProcessedAt": "string", "shopifyPageType": "string"}


def orders_per_month_store_stream(spark: SparkSession, log_dir: str,
                                  max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    log = parse_json_column(reader.load(log_dir).select(F.col("value").alias("DATA")))
    ev = event_table(log, fields=FIELDS)
    keys = (ev.filter(F.col("shopifyPageType") == "thank_you")
            .select(F.col("shopifyShopURL").alias("STORE"),
                    month_start_text(F.col("shopifyOrderProcessedAt")).alias("MONTH"),
                    F.col("shopifyOrderId").alias("ORDER_ID"))
            .dropDuplicates(["STORE", "MONTH", "ORDER_ID"]))
    return keys.groupBy("STORE", "MONTH").agg(F.count("ORDER_ID").alias("ORDER_COUNT"))


def start_orders_per_month_store(spark: SparkSession, log_dir: str, sink: str = "memory",
                                 name: str = "orders_month_store",
                                 checkpoint: str | None = None,
                                 available_now: bool = True) -> StreamingQuery:
    """Start the query.  The checkpoint goes under the cluster's shared
    checkpoint folder unless given.  ``sink='memory'`` exposes the table as
    a temp view named ``name`` (tests); otherwise ``sink`` is a parquet
    folder rewritten from each micro-batch's complete result."""
    base = ensure_checkpoint_dir(spark)
    checkpoint = checkpoint or os.path.join(base, "streams", name)
    df = orders_per_month_store_stream(spark, log_dir)
    w = df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    if sink == "memory":
        return w.format("memory").queryName(name).start()

    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    return w.foreachBatch(write).start()
