"""Small helpers of the operator tests."""

import random
import re

import pandas as pd
import pyarrow as pa

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_frame(spark, rows, parts=3):
    """Documents with clashing extra columns from (id, text) pairs."""
    data = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 1, "x", 2.0) for i, t in rows]
    return spark.createDataFrame(
        data, DOCS + ", n_tokens int, row string, score double").repartition(parts)


def table(df):
    """Rows as a sorted list of tuples with missing values as None."""
    pdf = df.toPandas()
    rows = [tuple(None if not isinstance(x, (list, tuple)) and pd.isna(x) else
                  (int(x) if isinstance(x, float) and x == int(x) else x) for x in r)
            for r in pdf.itertuples(index=False)]
    return sorted(rows, key=str)


def slices_of(texts):
    from touchline.llm import textops as T
    return T.slices([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])], "t")


def rng(seed):
    return random.Random(seed)
