"""URL verdicts: rules first, gradient-boosted trees for the rest.

Native: DataFrame functions and the JVM machine-learning library only; no
Python runs in tasks.  The trees see lexical features (length, depth, digit
ratio, entropy, parameter counts, suffix statistics) and are trained from
labelled URLs, here those that a rule decides.
"""

from __future__ import annotations

from typing import NamedTuple, Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.tables import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    host: str
    path: str
    action: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or no ``://``."""
    text = F.coalesce(url, F.lit(""))
    return (F.translate(F.regexp_extract(text, PARTS, 1), UPPER, LOWER),
            F.regexp_extract(text, PARTS, 2))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits, else nulls.

    A rule fits its host and all subdomains if the path starts with the
    rule's.  Of equally long rules the one with the longer host wins.
    """
    text: Column = F.lit(None).cast("string")
    action: Column = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = ((host == F.lit(r.host)) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, F.lit(r.text)).otherwise(text)
        action = F.when(fits, F.lit(r.action)).otherwise(action)
    return text, action


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.aggregate(letters, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    n = F.length(text)
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    double = lambda c: c.cast("double")
    return {
        "f_length": double(n),
        "f_host_length": double(F.length(host)),
        "f_path_length": double(F.length(path)),
        "f_labels": double(_count(host, ".")),
        "f_depth": double(_count(path, "/")),
        "f_digits": F.coalesce(_count(text, "0123456789") / F.nullif(n, F.lit(0)), F.lit(0.0)),
        "f_hyphens": double(_count(text, "-_")),
        "f_entropy": F.when(n > 0, _entropy(text)).otherwise(0.0),
        "f_params": double(_count(query, "=")),
        "f_query_length": double(F.length(query)),
        "f_secure": double(text.startswith("https")),
        "f_fragment": double(F.contains(text, F.lit("#"))),
        "f_first_segment": double(F.length(F.regexp_extract(path, r"^/([^/]*)", 1))),
    }


def _with_parts(urls: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    return (urls.withColumn("host", host).withColumn("path", path)
            .withColumn("suffix", F.substring_index("host", ".", -1))
            .withColumn("segment", F.regexp_extract("path", r"^/([^/]*)/", 1)))


def _first_by_hash(urls: DataFrame, n: int, of: int) -> DataFrame:
    """The ``n`` urls of ``of`` distinct ones with the smallest hash.

    Hashes above the place of the n-th, by far more than chance moves it, are
    cut first, so the task that ends the sort gets about ``n`` rows.
    """
    share = (n + 8 * n ** 0.5 + 64) / of
    h = F.xxhash64("url")
    if share < 1:
        urls = urls.filter(h < F.lit(int(share * 2 ** 64) - 2 ** 63))
    return urls.orderBy(h, "url").limit(n)


def filter_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id",
                url_col: str = "url", max_train: int = 8192, trees: int = 12,
                depth: int = 4, prior: float = 8.0) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row.

    The verdict is the rule's if one fits, else ``block`` where the trees'
    probability of block (``score``) is 0.5 or more.  The trees are fitted on
    at most ``max_train`` distinct rule-decided urls, of each class those with
    the smallest hash, half of the places each and more where the other class
    has fewer (a documented bound: the labelled rows grow with the table, what
    a small model needs does not).  A url weighs as many rows as it has, scaled
    so that each class weighs what it does among all labelled rows; which
    classes there are and their rows are counted over all of them.  Suffix
    statistics are the smoothed block rate and weight of the host's last label
    and of the first path segment over all rule-decided rows.  ``prior`` is
    the weight of the overall rate in them.

    A null url has empty host and path and no rule; its verdict is the
    trees'.  Without labelled rows every verdict is ``allow``; with one class
    only, that class.  Repeated rows stay repeated; other columns are not read.
    """
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    parsed = _with_parts(src)
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("action", action)

    urls = staged(parsed.filter(F.col("action").isNotNull()).groupBy("url", "action")
                  .agg(F.count("*").alias("n")), "url-labels")
    # At most two rows come to the driver.
    classes = {r["action"]: r for r in urls.groupBy("action").agg(
        F.sum("n").alias("n"), F.count("*").alias("urls")).collect()}
    out = ["page_id", "host", "path", "rule"]
    if len(classes) < 2:
        only = next(iter(classes), "allow")
        return parsed.select(*out, F.coalesce("action", F.lit(only)).alias("verdict"),
                             F.lit(float(only == "block")).alias("score"))
    rate = classes["block"]["n"] / sum(c["n"] for c in classes.values())

    def share(action: str, other: str) -> DataFrame:
        places = max(max_train // 2, max_train - classes[other]["urls"])
        return _first_by_hash(urls.filter(F.col("action") == action), places, classes[action]["urls"])

    sample = staged(share("block", "allow").union(share("allow", "block")), "url-sample")
    taken = {r["action"]: r["n"] for r in
             sample.groupBy("action").agg(F.sum("n").alias("n")).collect()}
    scale = F.when(F.col("action") == "block", classes["block"]["n"] / taken["block"]).otherwise(
        classes["allow"]["n"] / taken["allow"])
    labelled = (_with_parts(sample).withColumn("label", (F.col("action") == "block").cast("double"))
                .withColumn("weight", F.col("n") * scale))

    counted = _with_parts(urls).withColumn(
        "blocked", F.when(F.col("action") == "block", F.col("n")).otherwise(0))

    def statistics(key: str) -> DataFrame:
        return counted.groupBy(key).agg(
            ((F.sum("blocked") + prior * rate) / (F.sum("n") + prior)).alias(f"f_{key}_rate"),
            F.log1p(F.sum("n")).alias(f"f_{key}_weight"))

    def with_features(df: DataFrame) -> DataFrame:
        feats = lexical_features(F.col("url"), F.col("host"), F.col("path"))
        df = df.withColumns(feats)
        names = list(feats)
        # A row per suffix or segment on the right; Spark broadcasts by measured size.
        for key in ("suffix", "segment"):
            df = df.join(statistics(key), key, "left").fillna(
                {f"f_{key}_rate": rate, f"f_{key}_weight": 0.0})
            names += [f"f_{key}_rate", f"f_{key}_weight"]
        return VectorAssembler(inputCols=names, outputCol="features").transform(df)

    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=11,
                          checkpointInterval=-1, weightCol="weight").fit(
        with_features(labelled).select("features", "label", "weight"))
    scored = model.transform(with_features(parsed))
    p = vector_to_array("probability")[1]
    return scored.select(*out, F.coalesce(
        F.col("action"), F.when(p >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        p.alias("score"))
