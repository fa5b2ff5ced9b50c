"""The four attribution marts, built from one parse of the event log."""

from __future__ import annotations

import os
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import attribution as att
from touchline.sources.published import expire, publish, published_version, read_published
from touchline.sources.tables import cached, write_result


FILES_PER_MONTH = 8


class Marts(dict):
    """name -> mart DataFrame; ``release()`` drops the persisted event table
    once the marts have been written."""

    def __init__(self, *args, cached_input: DataFrame | None = None, **kw):
        super().__init__(*args, **kw)
        self._cached_input = cached_input

    def release(self) -> None:
        if self._cached_input is not None:
            self._cached_input.unpersist()
            self._cached_input = None


def build_marts(events: DataFrame, lookbacks: Iterable[int] = (90, 180),
                stage_dir: str | None = None) -> Marts:
    """orders_month_store, attribution_model_<days> per lookback and
    attribution_cjm.

    Every mart reads the typed event table twice (order side and touch
    side), so the JSON is parsed once and the typed table reused: written
    as parquet to ``stage_dir`` (shared storage -- survives executor loss
    and suits very large logs) or, without one, persisted on the executors.
    """
    if stage_dir:
        events.write.mode("overwrite").parquet(stage_dir)
        ev, held = events.sparkSession.read.parquet(stage_dir), None
    else:
        ev = held = cached(events)
    marts = Marts(cached_input=held)
    marts["orders_month_store"] = att.orders_per_month_store(ev)
    for days in lookbacks:
        marts[f"attribution_model_{days}"] = att.attribution_report(
            att.last_touch(ev, days=days), ordered=False)
    marts["attribution_cjm"] = att.touch_journey(ev, ordered=False)
    return marts


def write_marts(marts: dict[str, DataFrame], base: str) -> dict[str, str]:
    """Write each mart as parquet under ``base`` (shared storage); the
    model marts are partitioned by month.  Rows meet by month and store before
    the write, so a month has a few files and a large one several."""
    paths = {}
    for name, df in marts.items():
        path = os.path.join(base, name)
        part = ["MONTH"] if name.startswith("attribution_model_") else None
        if part:
            df = df.repartition("MONTH", F.pmod(F.xxhash64("STORE"), F.lit(FILES_PER_MONTH)))
        write_result(df, path, partition_by=part)
        paths[name] = path
    if isinstance(marts, Marts):
        marts.release()
    return paths


class MaintainedModel:
    """The attribution model kept current from new parts of the log.

    ``base/state`` holds last-touch states, a published part for each log part;
    ``base/model`` is the mart.  ``add`` reads only the new log, ``refresh``
    merges the states and publishes the mart, ``compact`` makes one state of
    all.  Adding a part twice changes nothing, so a job that failed after its
    publish can simply be run again.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.state, self.model = f"{self.base}/state", f"{self.base}/model"

    def add(self, events: DataFrame) -> int:
        return publish(att.last_touch_state(events), self.state, append=True)

    def last_touch(self) -> DataFrame:
        return att.last_touch_of_state(att.merged_state(read_published(self.spark, self.state)))

    def refresh(self) -> DataFrame:
        """Publish the mart of all parts added so far and read it back."""
        report = att.attribution_report(self.last_touch(), ordered=False)
        report = report.repartition("MONTH", F.pmod(F.xxhash64("STORE"), F.lit(FILES_PER_MONTH)))
        publish(report, self.model, partition_by=["MONTH"])
        return self.read()

    def read(self) -> DataFrame:
        report = read_published(self.spark, self.model)
        first = ["STORE", "MONTH"]
        return report.select(*first, *[c for c in report.columns if c not in first])

    def compact(self, keep: int = 2) -> None:
        publish(att.merged_state(read_published(self.spark, self.state)), self.state)
        expire(self.spark, self.state, keep)
        if published_version(self.spark, self.model) is not None:
            expire(self.spark, self.model, keep)
