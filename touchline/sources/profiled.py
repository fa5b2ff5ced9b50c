"""Tables staged with a profile of their text columns.

``clean`` chooses types by content, so it has to know which text columns hold
dates before it can plan.  Here that is found by the pass that stages the rows
(metrics observed while they are written) and stored beside them; cleaning then
reads the staged rows and the profile.  The input is computed once, and a table
that is staged already is cleaned without any look at its content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from touchline.functions.text import DATE_LIKE
from touchline.operators.cleaning import FREE_TEXT, clean

ROWS, PROFILE = "rows", "profile"


def stage_profiled(df: DataFrame, path: str) -> None:
    """Write ``df`` to ``path``/rows and, from the same pass, one row per text
    column (``column_name, date_like, filled, longest``) to ``path``/profile.

    The profile is written last: a folder without it is not complete.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(text):
        v = F.col(f"`{c}`")
        metrics += [F.max(v.rlike(DATE_LIKE)).alias(f"d{i}"), F.count(v).alias(f"f{i}"),
                    F.max(F.length(v)).alias(f"l{i}")]
    df.observe(seen, *metrics).write.parquet(f"{path}/{ROWS}")
    found = seen.get
    rows = [(c, bool(found[f"d{i}"]), found[f"f{i}"], found[f"l{i}"] or 0) for i, c in enumerate(text)]
    df.sparkSession.createDataFrame(
        rows, "column_name string, date_like boolean, filled bigint, longest int"
    ).coalesce(1).write.parquet(f"{path}/{PROFILE}")


def staged_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{ROWS}")


def staged_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{PROFILE}")


def clean_staged(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``clean`` of a table staged by ``stage_profiled``; only the profile (a
    row per text column) is read while the plan is built."""
    dates = [r.column_name for r in staged_profile(spark, path).filter("date_like").collect()
             if r.column_name not in FREE_TEXT]
    return clean(staged_rows(spark, path), strict=strict, date_columns=dates)
