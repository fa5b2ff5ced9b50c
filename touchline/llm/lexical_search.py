"""Ranked lexical search by dual trees, exact.

Items and batches of documents are vectors over the items' terms: an item
holds term weight times repeats, a document its term impacts.  Both are
arranged in binary trees (median splits along the widest folded coordinate)
whose nodes hold the maximum of every coordinate below.  The product of two
nodes bounds every score between them; a pair of nodes whose bound is under
the weakest k-th score of its items goes, whole batches at the root.  Leaves
are single rows, where the bound is the score itself.

Passes: one over the texts writes each slice's sparse vectors, document
frequencies and sizes; a sixteenth of the slices is searched first and its
k-th scores start the search of the rest.  Scores of any documents bound the
final k-th score from below, so nothing that belongs in the answer is cut.

Items come in blocks of ``BLOCK_BYTES`` of text, one pass over the texts per
block, so the driver and the tasks hold one block's terms.  Terms are told
apart by a 64-bit hash.

Null texts have no terms.  Items without terms and documents without a
common term are in no answer.  Repeated document rows each take a rank; an
item id with several texts is asked with the smallest.  A null doc_id comes
last among equal scores.  Other columns are not read.
"""

from __future__ import annotations

import math
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.packing import arrow_schema
from touchline.llm.tables import staged
from touchline.llm.textops import byte_table, class_of, slices, span_hashes, word_spans

BLOCK_BYTES = 2 << 20     # item texts whose terms one pass looks for
ITEMS = 256               # items of one tree
CELLS = 1 << 22           # coordinates of a batch of documents
FOLD = 16                 # folded coordinates that the trees split along
FIRST = 16                # one slice in so many is searched first
SALTS = 32

TERM = class_of([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
TABLE = byte_table(TERM, fold_case=True)
VECTORS = ("n_docs bigint, n_terms bigint, doc array<bigint>, size array<bigint>, nnz array<int>, "
           "term array<int>, tf array<int>, df_term array<int>, df array<bigint>")


def terms_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every term of a slice."""
    starts, _, row = word_spans(data, offs, TERM)
    return span_hashes(data, starts, TABLE), row


def _lists(values: np.ndarray, kind: pa.DataType, mask: np.ndarray | None = None) -> pa.Array:
    flat = pa.array(values, kind, mask=mask)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """A row per slice of texts: sparse vectors over ``vocabulary`` (sorted
    hashes) of the documents that hold any, sizes, document frequencies."""
    schema = arrow_schema(VECTORS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches, "text"):
            h, row = terms_of(data, offs)
            size = np.bincount(row, minlength=rows.num_rows)
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            known = vocabulary[at] == h
            cell, tf = np.unique(row[known] * len(vocabulary) + at[known], return_counts=True)
            row, term = cell // len(vocabulary), cell % len(vocabulary)
            nnz = np.bincount(row, minlength=rows.num_rows)
            held = np.flatnonzero(nnz)
            ids = rows.column(0).take(pa.array(held))
            df = np.bincount(term, minlength=len(vocabulary))
            seen = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([
                pa.array([int((size > 0).sum())], pa.int64()), pa.array([int(size.sum())], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                _lists(size[held], pa.int64()), _lists(nnz[held], pa.int32()),
                _lists(term, pa.int32()), _lists(tf, pa.int32()),
                _lists(seen, pa.int32()), _lists(df[seen], pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, VECTORS)


def median_order(points: np.ndarray) -> np.ndarray:
    """Order of a power of two of rows in which every aligned run of a power
    of two is a node: each node is halved along its widest folded coordinate."""
    n, width = points.shape
    folds = np.zeros((n, FOLD))
    for f in range(min(FOLD, width)):
        folds[:, f] = points[:, f::FOLD].sum(axis=1)
    order = np.arange(n)[None, :]
    while order.shape[1] > 1:
        here = folds[order]
        widest = here.var(axis=1).argmax(axis=1)
        key = np.take_along_axis(here, widest[:, None, None], axis=2)[:, :, 0]
        order = np.take_along_axis(order, np.argsort(key, axis=1, kind="stable"), axis=1)
        order = order.reshape(order.shape[0] * 2, -1)
    return order.ravel()


def maxima(points: np.ndarray) -> list[np.ndarray]:
    """Coordinate maxima of the nodes, root level first."""
    levels = [points]
    while len(levels[0]) > 1:
        levels.insert(0, levels[0].reshape(-1, 2, points.shape[1]).max(axis=1))
    return levels


def power_of_two(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


class ItemTree:
    """Items of one tree: numbers, term coordinates, coordinate maxima."""

    def __init__(self, numbers: list[int], rows: list[dict[int, int]]):
        self.terms = np.array(sorted({t for r in rows for t in r}), np.int64)
        full = power_of_two(len(numbers))
        points = np.zeros((full, len(self.terms)))
        for i, r in enumerate(rows):
            ts = np.array(sorted(r), np.int64)
            points[i, np.searchsorted(self.terms, ts)] = [r[int(t)] for t in ts]
        order = median_order(points)
        self.numbers = np.array(numbers + [-1] * (full - len(numbers)), np.int64)[order]
        self.levels = maxima(points[order])
        # Impacts are at most a million: products are whole doubles below 2**53.
        self.exact = points.sum(axis=1).max(initial=0) * 1e6 < 2.0 ** 53


def impacts(tf: np.ndarray, size: np.ndarray, n: int, total: int) -> np.ndarray:
    """Impact of a term occurring ``tf`` times in a document of ``size`` terms."""
    if len(size) and 25 * int(size.max()) * n >= 1 << 63:
        share = np.array([25 * int(s) * n // total for s in size], np.int64)
    else:
        share = 25 * size * n // total
    return (1_000_000_000 * tf) // (1000 * tf + 12 * (100 - 25 + share))


def pairs_above(tree: ItemTree, points: np.ndarray, floor: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item place, document place, score) of all pairs whose score reaches
    their item's floor, by descending both trees at once."""
    docs = maxima(points)
    floors = [floor]
    while len(floors[0]) > 1:
        floors.insert(0, floors[0].reshape(-1, 2).min(axis=1))
    slack = 1.0 if tree.exact else 1.0 + 1e-9
    a = b = np.zeros(1, np.int64)
    top = max(len(tree.levels), len(docs))
    for level in range(top):
        i, d = min(level, len(tree.levels) - 1), min(level, len(docs) - 1)
        if level:
            if level < len(tree.levels):
                a, b = np.concatenate([2 * a, 2 * a + 1]), np.concatenate([b, b])
            if level < len(docs):
                a, b = np.concatenate([a, a]), np.concatenate([2 * b, 2 * b + 1])
        ua, ia = np.unique(a, return_inverse=True)
        ub, ib = np.unique(b, return_inverse=True)
        bound = (tree.levels[i][ua] @ docs[d][ub].T)[ia, ib] * slack
        keep = (bound >= floors[i][a]) & (bound > 0)
        a, b, bound = a[keep], b[keep], bound[keep]
        if not len(a):
            break
    if tree.exact or not len(a):
        return a, b, bound.astype(np.int64)
    score = np.array([int((tree.levels[-1][x].astype(np.int64) * docs[-1][y].astype(np.int64)).sum())
                      for x, y in zip(a, b)], np.int64)
    keep = score >= floor[a]
    return a[keep], b[keep], score[keep]


class Best:
    """The k best documents of each item so far: score, then smaller id."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.start = k, floors
        self.item = np.zeros(0, np.int64)
        self.doc, self.score = self.item, self.item
        self.null = np.zeros(0, bool)
        self.floors = floors.copy()

    def add(self, item, doc, null, score) -> None:
        item, doc = np.concatenate([self.item, item]), np.concatenate([self.doc, doc])
        null, score = np.concatenate([self.null, null]), np.concatenate([self.score, score])
        o = np.lexsort((doc, null, -score, item))
        first = np.searchsorted(item[o], item[o], side="left")
        rank = np.arange(len(o)) - first
        last = o[rank == self.k - 1]
        o = o[rank < self.k]
        self.item, self.doc, self.null, self.score = item[o], doc[o], null[o], score[o]
        self.floors = self.start.copy()
        np.maximum.at(self.floors, item[last], score[last])


def search(rows: DataFrame, trees: list[ItemTree], floors: np.ndarray, k: int, n: int,
           total: int, n_vocabulary: int) -> DataFrame:
    """Each task's k best documents per item (``item, doc_id, score``)."""
    widest = max(len(t.terms) for t in trees)
    batch = max(32, min(512, power_of_two(max(1, CELLS // max(1, widest)) // 2 + 1)))
    schema = arrow_schema("item int, doc_id bigint, score bigint")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(floors, k)
        held: list[tuple] = []
        n_held = 0

        def flush() -> None:
            nonlocal held, n_held
            if not n_held:
                return
            doc, null, nnz, term, impact = (np.concatenate(x) for x in zip(*held))
            held, n_held = [], 0
            for lo in range(0, len(doc), batch):
                hi = min(len(doc), lo + batch)
                ends = np.concatenate([[0], np.cumsum(nnz)])
                part = slice(int(ends[lo]), int(ends[hi]))
                row = np.repeat(np.arange(hi - lo), nnz[lo:hi])
                for tree in trees:
                    column = np.full(n_vocabulary, -1, np.int64)
                    column[tree.terms] = np.arange(len(tree.terms))
                    at = column[term[part]]
                    points = np.zeros((power_of_two(hi - lo), len(tree.terms)))
                    points[row[at >= 0], at[at >= 0]] = impact[part][at >= 0]
                    order = median_order(points)
                    floor = np.where(tree.numbers >= 0, best.floors[tree.numbers], np.inf)
                    a, b, score = pairs_above(tree, points[order], floor)
                    if len(a):
                        place = lo + order[b]
                        best.add(tree.numbers[a], doc[place], null[place], score)

        for b in batches:
            for i in range(b.num_rows):
                cells = [b.column(c)[i].values for c in range(5)]
                doc, size, nnz, term, tf = cells
                null = np.asarray(doc.is_null().to_numpy(zero_copy_only=False), bool)
                size, nnz, tf = (x.to_numpy().astype(np.int64) for x in (size, nnz, tf))
                if not len(nnz):
                    continue
                impact = impacts(tf, np.repeat(size, nnz), n, total)
                held.append((doc.fill_null(0).to_numpy(), null, nnz, term.to_numpy(), impact))
                n_held += len(nnz)
                if n_held >= batch:
                    flush()
        flush()
        if len(best.item):
            yield pa.RecordBatch.from_arrays([
                pa.array(best.item, pa.int32()), pa.array(best.doc, pa.int64(), mask=best.null),
                pa.array(best.score, pa.int64())], schema=schema)

    return rows.select("doc", "size", "nnz", "term", "tf").mapInArrow(run, "item int, doc_id bigint, score bigint")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best rows per item, first within salts, so that no item's rows of
    all tasks meet in one task."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = hits.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = (salted.withColumn("_r", F.row_number().over(Window.partitionBy("item", "_s").orderBy(*order)))
            .filter(F.col("_r") <= k).drop("_s", "_r"))
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
            .filter(F.col("rank") <= k))


def _block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """Answers of one block of items (``item`` is the place in ``rows``)."""
    texts = [r["text"].encode() for r in rows]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    h, row = terms_of(data, offs)
    vocabulary = np.unique(h)
    if not len(vocabulary):
        return docs.sparkSession.createDataFrame([], "item int, doc_id bigint, score bigint, rank int")
    sparse = staged(vectors(docs, vocabulary), "search-vectors")
    n, total = sparse.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    df = np.zeros(len(vocabulary), np.int64)
    counts = (sparse.select(F.explode(F.arrays_zip("df_term", "df")).alias("x"))
              .groupBy("x.df_term").agg(F.sum("x.df").alias("df")).toPandas())
    df[counts["df_term"].to_numpy(np.int64)] = counts["df"].to_numpy(np.int64)
    if not n:
        return docs.sparkSession.createDataFrame([], "item int, doc_id bigint, score bigint, rank int")
    weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df]

    at = np.searchsorted(vocabulary, h)
    items: dict[int, dict[int, int]] = {}
    for r, t in zip(row.tolist(), at.tolist()):
        items.setdefault(r, {}).setdefault(t, 0)
        items[r][t] += weight[t]
    numbers = sorted(items)
    trees = [ItemTree(numbers[i:i + ITEMS], [items[j] for j in numbers[i:i + ITEMS]])
             for i in range(0, len(numbers), ITEMS)]
    share = F.pmod(F.xxhash64("doc", "size", "nnz"), F.lit(FIRST))
    floors = np.ones(len(rows))
    first = staged(_ranked(search(sparse.filter(share == 0), trees, floors, k, n, total, len(vocabulary)), k)
                   .drop("rank"), "search-first")
    for r in first.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") == k).collect():
        floors[r["item"]] = r["s"]
    rest = search(sparse.filter(share != 0), trees, floors, k, n, total, len(vocabulary))
    return staged(_ranked(first.union(rest), k), "search-best")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every item."""
    asked = (items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
             .groupBy("item_id").agg(F.min("text").alias("text")))
    n_bytes = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(n_bytes // BLOCK_BYTES) + 1
    asked = staged(asked.withColumn("block", F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks))), "search-items")
    out = None
    for b in range(blocks):
        rows = asked.filter(F.col("block") == b).orderBy("item_id").collect()
        if not rows:
            continue
        hits = _block(docs, rows, k)
        names = asked.sparkSession.createDataFrame(
            [(i, r["item_id"]) for i, r in enumerate(rows)],
            f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        part = hits.join(names, "item")
        out = part if out is None else out.unionByName(part)
    kind = items.schema["item_id"].dataType.simpleString()
    if out is None:
        out = docs.sparkSession.createDataFrame(
            [], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
