"""Mixing sources to target weights with a hypergeometric splitting tree.

Every source is cut by a hash into ``BLOCKS`` permuted blocks.  A source's
target gives a number of whole passes over it and one partial pass, which
ends at a cut in hash order found by radix selection (three histograms of
1,024 bins, so a cut is exact to 2**-30 of a source).  The drawn blocks of
all sources form a vector of quotas; a binary tree splits that vector among
the output shards by multivariate-hypergeometric draws, so the leaves' quotas
add up to the sources' exactly.  Each source's permuted blocks are dealt to
the leaves by quota (disjoint), and rows are shuffled inside their shard.

The driver holds one row per source and the deal of 1,024 blocks per source
and pass; documents stay distributed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import reliable_checkpoint

BITS = 10
BLOCKS = 1 << BITS
LEVELS = 3
RUNS = 3             # runs of the partial pass, each nearer to the target
NO_LIMIT = (1 << 63) - 1
CAP = 3.0            # a source is taken this many times at most
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("bigint")


def source_targets(sizes: dict, cap: float = CAP, cycle: tuple = (1, 2, 3)) -> dict:
    """Words to take from each source.

    Sources by code point (null last) weigh 1, 2, 3, repeating, and share the
    sum of all sizes; a target above ``cap`` times its source's size stops
    there and the excess is shared again by weight, until none is above.
    """
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    target, free, rest = {}, list(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > cap * sizes[s]]
        if not over:
            target.update({s: rest * weight[s] / total for s in free})
            break
        for s in over:
            target[s] = cap * sizes[s]
            rest -= target[s]
        free = [s for s in free if s not in target]
    return target


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Exact quotas per shard and source: ``[shards, sources]``.

    Each node draws, without replacement, its left half's share of blocks
    from its own vector; the right half keeps the rest.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        lo, hi, q = todo.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        n = int(q.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = (rng.multivariate_hypergeometric(q, n, method="marginals") if len(q) and n
                else np.zeros_like(q))
        todo += [(lo, mid, left), (mid, hi, q - left)]
    return out


@dataclass
class SourcePlan:
    size: int
    target: float
    passes: int = 0                              # whole passes
    rest: float = 0.0                            # words still to take
    # Of the partial pass: documents with lo <= hash <= hi and size <= most.
    runs: list = field(default_factory=list)


def _keyed(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Rows as one struct, with size, 63-bit hash and block beside it."""
    return docs.select(
        F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 1).alias("u"),
    ).withColumn("block", F.shiftright("u", 63 - BITS).cast("int"))


def _plans(base: DataFrame) -> dict:
    """One plan per source; each level reads the checkpointed small table.

    A run of documents in hash order ends before the one that would pass the
    target; the next run goes on from there with documents that still fit.
    """
    sizes = {r["source"]: int(r["n"] or 0) for r in
             base.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    targets = source_targets(sizes)
    plans = {}
    for s, size in sizes.items():
        p = plans[s] = SourcePlan(size, targets[s])
        if size:
            p.passes = int(p.target / size + 1e-12)
            p.rest = max(0.0, p.target - p.passes * size)
    for last in [False] * (RUNS - 1) + [True]:
        _extend(base, {s: p for s, p in plans.items()
                       if p.rest > 0 and (not p.runs or p.runs[-1][1] < NO_LIMIT)}, last)
    return plans


def _extend(base: DataFrame, plans: dict, last: bool) -> None:
    """Add one run to each plan, by radix selection of its end."""
    at = {s: [p.runs[-1][1] + 1 if p.runs else 0, max(1, int(p.rest)) if p.runs else NO_LIMIT]
          for s, p in plans.items()}
    digits: dict = {s: [] for s in plans}
    for level in range(LEVELS):
        shift = 63 - BITS * (level + 1)
        rows = [(s, _prefix(digits[s]), at[s][0], at[s][1], plans[s].rest) for s in digits]
        if not rows:
            return
        cuts = base.sparkSession.createDataFrame(
            rows, "s string, prefix bigint, lo bigint, most bigint, rest double")
        # At most 1,024 bins of one source meet in a task.
        found = (base.join(cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("u") >= F.col("lo"))
                           & (F.col("size") <= F.col("most"))
                           & (F.shiftright("u", shift + BITS) == F.col("prefix")))
                 .withColumn("digit", F.shiftright("u", shift).bitwiseAND(BLOCKS - 1))
                 .groupBy("source", "rest", "digit").agg(F.sum("size").alias("n"))
                 .groupBy("source", "rest")
                 .agg(F.array_sort(F.collect_list(F.struct("digit", "n"))).alias("bins"))
                 .select("source", F.aggregate("bins", _state(0, -1, 0, 0), _step).alias("hit"))
                 .select("source", "hit.*").collect())
        for r in found:
            s, p = r["source"], plans[r["source"]]
            if r["digit"] < 0:          # all that is left here fits
                p.runs.append((at[s][0], ((_prefix(digits[s]) + 1) << (shift + BITS)) - 1, at[s][1]))
                p.rest -= r["sum"]
                del digits[s]
                continue
            digits[s].append(int(r["digit"]))
            p.rest -= r["before"]
            if level == LEVELS - 1:
                end = _prefix(digits.pop(s)) << shift
                if last and r["n"] - p.rest < p.rest:
                    end += 1 << shift   # nearer with the last bin than without
                p.runs.append((at[s][0], end - 1, at[s][1]))
        seen = {r["source"] for r in found}
        for s in [s for s in digits if s not in seen]:
            del digits[s]               # nothing there


def _state(total, digit, before, n) -> Column:
    return F.struct(*(F.lit(x).cast("bigint").alias(k) if not isinstance(x, Column) else
                      x.cast("bigint").alias(k) for k, x in
                      (("sum", total), ("digit", digit), ("before", before), ("n", n))))


def _step(a: Column, b: Column) -> Column:
    """First bin whose sum with all before it passes ``rest``."""
    return (F.when(a["digit"] >= 0, a)
            .when(a["sum"] + b["n"] > F.col("rest"), _state(a["sum"], b["digit"], a["sum"], b["n"]))
            .otherwise(_state(a["sum"] + b["n"], a["digit"], a["before"], a["n"])))


def _prefix(digits: list) -> int:
    out = 0
    for d in digits:
        out = (out << BITS) | d
    return out


def _deal(spark: SparkSession, plans: dict, shards: int, seed: int) -> DataFrame:
    """Shard of every drawn block and pass: one row per source and block."""
    names = sorted((s for s in plans if s is not None)) + ([None] if None in plans else [])
    units = []
    for s in names:      # whole passes, and the blocks that the partial pass reaches
        end = max((hi for _, hi, _ in plans[s].runs), default=-1)
        units.append(plans[s].passes * BLOCKS + (0 if end < 0 else (end >> (63 - BITS)) + 1))
    leaves = splitting_tree(np.array(units, np.int64), shards, seed)
    rows = []
    for i, s in enumerate(names):
        p = plans[s]
        owner = np.empty(units[i], np.int64)
        owner[np.random.default_rng([seed, 7919, i]).permutation(units[i])] = np.repeat(
            np.arange(shards), leaves[:, i])
        for b in range(BLOCKS):
            rows.append((s, b, p.size, float(p.target), p.passes, p.runs,
                         [int(x) for x in owner[b::BLOCKS]]))
    return spark.createDataFrame(
        rows, "s string, b int, source_size bigint, target double, passes int, "
        "runs array<struct<lo:bigint,hi:bigint,most:bigint>>, owners array<int>")


def mix(docs: DataFrame, shards: int = 64, seed: int = 17, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source",
        keep_rows: bool = True) -> DataFrame:
    """One row per document: ``doc_id, size, source, source_size, target,
    taken, shards`` (and the whole input row as ``row``).

    ``shards`` lists the output shard of each copy the mix takes; ``taken``
    is ``size`` times their number.  The size of a null text is 0 and a null
    source is a source of its own (last in order).  Rows that agree in id and
    text stand or fall together; reruns agree, whatever the partitioning.
    A source whose size is 0 has target 0.  An empty table gives no rows.
    The number of sources must fit the driver (1,024 small rows each).
    """
    keyed = _keyed(docs, seed, id_col, text_col, source_col)
    base = reliable_checkpoint(keyed.drop("row"))
    deal = _deal(docs.sparkSession, _plans(base), shards, seed)
    left = keyed if keep_rows else base
    out = left.join(deal, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    partial = F.exists("runs", lambda r: F.col("u").between(r["lo"], r["hi"])
                       & (F.col("size") <= r["most"]))
    copies = F.col("passes") + partial.cast("int")
    return out.withColumn("shards", F.slice("owners", F.lit(1), copies)).select(
        *(["row"] if keep_rows else []), "doc_id", "size", "source", "source_size", "target",
        (F.col("size") * copies).alias("taken"), "shards", "u")


def mixed_rows(mixed: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: the input's columns once per copy, laid out by shard and
    shuffled inside it.  Shard and order are the layout only."""
    copies = mixed.select("row", "u", F.posexplode("shards").alias("copy", "shard"))
    order = F.xxhash64(F.lit(seed + 1), "u", "copy", "shard")
    return (copies.repartition("shard").sortWithinPartitions("shard", order)
            .select("row.*"))
