"""JSON files that hold one array of documents, each file read by many tasks.

The JSON source reads such a file in one task.  Here the text source cuts it at
every ``}``, which it can do from any byte range, and a document's border is a
``}`` outside strings at which as many objects have closed as have opened.

1. Every fragment tells what it does to the state: how many quotes it holds,
   and how many objects it opens if it begins outside or inside a string.
   Escapes never cross a fragment (``\\}`` is no JSON).
2. Inside a piece (a file's byte range that one task read) windows add that up
   for both states the piece may begin in.
3. One row per piece carries the true state from piece to piece, over a window
   of a file's pieces.
4. A second such table counts the borders before each piece, so a document has
   one number wherever it is cut; fragments of a number are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators.sequence import dealt_once, unpacked

PIECE = ["file", "block"]


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _opened(text: Column) -> Column:
    """Objects opened in ``text``, which begins outside a string."""
    return _count(F.regexp_replace(text, '"[^"]*("|$)', ""), "{")


def _before(w) -> Column:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _sum_before(c: str, w) -> Column:
    return F.coalesce(F.sum(c).over(_before(w)), F.lit(0)).cast("bigint")


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    return (raw.withColumn("at", F.monotonically_increasing_id())
            .withColumn("quotes", _count(bare, '"').cast("bigint"))
            .withColumn("open_0", _opened(bare).cast("bigint"))
            .withColumn("open_1", _opened(F.concat(F.lit('"'), bare)).cast("bigint")))


def read_documents(spark: SparkSession, path: str, out: str = "DATA") -> DataFrame:
    """One row per object of the arrays in ``path``: its text in ``out``.

    A file may hold one array of objects, several, or objects that follow each
    other; null and other plain elements are no documents.  What follows the
    last border of a broken file comes as one text if it opens an object.
    Nothing runs while the plan is built, and no file is bound to one task; a
    piece is as large as ``spark.sql.files.maxPartitionBytes``, and a document
    must fit a row.
    """
    local = Window.partitionBy(*PIECE).orderBy("at")
    rows = unpacked(dealt_once(_fragments(spark, path), PIECE)).select(*PIECE, "at", "value", "quotes", "open_0", "open_1")
    rows = rows.withColumn("seen", _sum_before("quotes", local))
    for s in (0, 1):            # the piece begins outside (0) or inside (1) a string
        inside = (F.col("seen") + s) % 2 == 1
        closes = (F.col("seen") + F.col("quotes") + s) % 2 == 0
        rows = (rows.withColumn(f"closes_{s}", closes)
                .withColumn(f"step_{s}", F.when(inside, F.col("open_1")).otherwise(F.col("open_0"))
                            - closes.cast("bigint")))
    whole = local.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*PIECE, "at", "value", "quotes", "closes_0", "closes_1", "step_0", "step_1",
                       F.sum("step_0").over(whole).alias("depth_0"), F.sum("step_1").over(whole).alias("depth_1"))

    by_file = Window.partitionBy("file").orderBy("block")
    pieces = (rows.groupBy(*PIECE).agg(F.sum("quotes").alias("quotes"), F.sum("step_0").alias("step_0"),
                                       F.sum("step_1").alias("step_1"))
              .withColumn("inside", _sum_before("quotes", by_file) % 2 == 1)
              .withColumn("step", F.when(F.col("inside"), F.col("step_1")).otherwise(F.col("step_0")))
              .select(F.col("file").alias("p_file"), F.col("block").alias("p_block"), "inside",
                      _sum_before("step", by_file).alias("depth")))
    rows = rows.join(pieces, (rows["file"] == pieces["p_file"]) & (rows["block"] == pieces["p_block"]))
    depth = F.col("depth") + F.when(F.col("inside"), F.col("depth_1")).otherwise(F.col("depth_0"))
    closes = F.when(F.col("inside"), F.col("closes_1")).otherwise(F.col("closes_0"))
    rows = rows.select(*PIECE, "at", "value", closes.alias("closes"),
                       (closes & (depth == 0)).cast("bigint").alias("border"))

    numbers = (rows.groupBy(*PIECE).agg(F.sum("border").alias("borders"))
               .select(F.col("file").alias("n_file"), F.col("block").alias("n_block"),
                       _sum_before("borders", by_file).alias("first")))
    rows = rows.join(numbers, (rows["file"] == numbers["n_file"]) & (rows["block"] == numbers["n_block"]))
    rows = rows.withColumn("number", F.col("first") + _sum_before("border", local))
    docs = rows.groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("parts"), F.max("border").alias("whole"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"),
                    F.when(F.col("whole") == 1, F.lit("}")).otherwise(F.lit("")))
    return (docs.select(text.alias("text")).filter(F.instr("text", "{") > 0)
            .select(F.expr("substring(text, instr(text, '{'))").alias(out)))
