"""Toxicity by weak supervision.

1. Lexicon induction: terms (words and word beginnings) that mark the toxic
   class in a bounded sample of labelled rows are dealt into many lexicon
   voters; pattern voters look at densities and at letter case.
2. Label model: a generative model of the voters' votes, fitted by
   expectation maximisation, estimates each voter's accuracy and abstention
   by class, and the voters' correlations given the class; correlated voters
   share their evidence.
3. A linear classifier is trained on the posterior labels and scores texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import textops as T

LETTERS = T.class_of([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
TABLE = T.byte_table(LETTERS, fold_case=True, seed=31)
PREFIXES = (4, 5, 6)            # word beginnings, in bytes
PURITY = 0.95                   # least share of toxic rows among a mark's rows
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def term_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word and of its beginnings (longer words only)."""
    starts, ends, row = T.word_spans(data, offs, LETTERS)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p, inv = T.powers(len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(TABLE[data] * p[:len(data)])))
    hashes, rows = [T.mix64((total[ends] - total[starts]) * inv[starts])], [row]
    for k in PREFIXES:
        long = ends - starts > k
        s = starts[long]
        hashes.append(T.mix64((total[s + k] - total[s]) * inv[s] + np.uint64(k)))
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows)


def patterns(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per row: share of capitals, of exclamation marks and of digits."""
    n = np.maximum(np.diff(offs), 1)
    cols = []
    for mask in ((data >= 0x41) & (data <= 0x5A), data == 0x21, (data >= 0x30) & (data <= 0x39)):
        c = np.concatenate(([0], np.cumsum(mask)))
        cols.append((c[offs[1:]] - c[offs[:-1]]) / n)
    return np.stack(cols, axis=1)


@dataclass
class LabelModel:
    """P(vote | class) of every voter, votes in {-1, 0 (abstain), 1}, and the
    voters' correlations given the class."""
    table: np.ndarray        # [voter, class, vote + 1]
    prior: np.ndarray
    share: np.ndarray        # weight of each voter's evidence, 1 if uncorrelated

    @classmethod
    def fit(cls, votes: np.ndarray, start: np.ndarray, rounds: int = 25,
            pseudo: float = 2.0) -> "LabelModel":
        """``start``: what is known of P(class 1) by row, 0.5 for nothing: the
        first guess, and evidence beside the votes in every round."""
        post = start.astype(float)
        known = np.log(post) - np.log1p(-post)
        share = np.ones(votes.shape[1])
        onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
        for _ in range(rounds):
            w = np.stack((1 - post, post))
            table = np.einsum("cn,nvk->vck", w, onehot) + pseudo / 3
            table /= table.sum(axis=2, keepdims=True)
            prior = (w.sum(axis=1) + 1) / (len(post) + 2)
            # Correlations of what the class does not explain.
            mean = table[:, :, 2] - table[:, :, 0]
            left = votes - (mean[:, 0][None, :] * w[0][:, None] + mean[:, 1][None, :] * w[1][:, None])
            cov = left.T @ left / max(len(post), 1) + 1e-9 * np.eye(votes.shape[1])
            scale = np.sqrt(np.diag(cov))
            corr = np.abs(cov / np.outer(scale, scale))
            np.fill_diagonal(corr, 0)
            share = 1 / (1 + np.where(corr > 0.1, corr, 0).sum(axis=1))
            model = cls(table, prior, share)
            post = model.posterior(votes, known)
        return model

    def posterior(self, votes: np.ndarray, known: np.ndarray | float = 0.0) -> np.ndarray:
        log = np.log(self.prior)[None, :].repeat(len(votes), axis=0)
        for v in range(votes.shape[1]):
            log += self.share[v] * np.log(self.table[v][:, votes[:, v] + 1]).T
        return 1 / (1 + np.exp(-np.clip(log[:, 1] - log[:, 0] + known, -30, 30)))

    def accuracies(self) -> np.ndarray:
        """P(vote is right | voted) of every voter."""
        p = self.table * self.prior[None, :, None]
        return (p[:, 0, 0] + p[:, 1, 2]) / np.maximum(p[:, :, [0, 2]].sum(axis=(1, 2)), 1e-12)


@dataclass
class Scorer:
    terms: np.ndarray        # sorted hashes
    weights: np.ndarray      # of log1p(count)
    pattern: np.ndarray
    bias: float
    label_model: LabelModel | None = None

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        z = np.full(n, self.bias) + patterns(data, offs) @ self.pattern
        at, row, count = _counts(data, offs, self.terms)
        z += np.bincount(row, weights=self.weights[at] * np.log1p(count), minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _counts(data, offs, terms):
    """Known terms by row: (term, row, count)."""
    h, row = term_hashes(data, offs)
    if not len(h) or not len(terms):
        z = np.zeros(0, np.int64)
        return z, z, z
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    hit = terms[at] == h
    key, count = np.unique(row[hit] * len(terms) + at[hit], return_counts=True)
    return key % len(terms), key // len(terms), count


def train(texts: list, labels: np.ndarray, lexicon: int = 96, voters: int = 24,
          vocabulary: int = 4000, steps: int = 500,
          price: float = 0.3) -> Scorer:
    """Label model and linear classifier from a sample of labelled texts."""
    y = labels.astype(float)
    n = len(texts)
    if n == 0 or y.min() == y.max():
        return Scorer(np.zeros(0, np.uint64), np.zeros(0), np.zeros(3),
                      -4.0 if n == 0 or y.max() < 1 else 4.0)
    hs, rs, pats, base = [], [], [], 0
    for rows, data, offs in T.slices([pa.RecordBatch.from_arrays(
            [pa.array([t or "" for t in texts], pa.large_string())], names=["t"])], "t"):
        h, r = term_hashes(data, offs)
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(first)
        hs.append((h[at], np.diff(np.append(at, len(h))).astype(np.int32)))
        rs.append((r[at] + base).astype(np.int32))
        pats.append(patterns(data, offs))
        base += len(offs) - 1
    h, count = (np.concatenate([x[i] for x in hs]) for i in (0, 1))
    row, pat = np.concatenate(rs), np.concatenate(pats)
    words = np.maximum(np.bincount(row, weights=count, minlength=n), 1)
    # Terms of one or two rows say nothing about a class.
    terms, df = np.unique(h, return_counts=True)
    terms = terms[df >= 3]
    if not len(terms):
        terms = np.unique(h)
    back = np.minimum(np.searchsorted(terms, h), len(terms) - 1).astype(np.int32)
    known = terms[back] == h
    back, row, count = back[known], row[known], count[known]
    del h, hs, rs, known

    def association(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smoothed log odds of each term by class, and its z value."""
        pos = np.bincount(back, weights=target[row], minlength=len(terms))
        neg = np.bincount(back, minlength=len(terms)) - pos
        a, b = pos + 0.5, neg + 0.5
        odds = np.log(a / (target.sum() + 1)) - np.log(b / (n - target.sum() + 1))
        return odds, odds / np.sqrt(1 / a + 1 / b)

    odds, z = association(y)
    # Terms that (nearly) only toxic rows hold, strongest first, dealt in turn
    # to the lexicon voters.
    df = np.bincount(back, minlength=len(terms))
    pure = np.bincount(back, weights=y[row], minlength=len(terms)) / df >= PURITY
    marks = np.argsort(-np.where(pure, z, -np.inf))[:lexicon]
    marks = marks[pure[marks] & (z[marks] > 2.5)]
    of = np.full(len(terms), -1)
    of[marks] = np.arange(len(marks)) % voters
    hit = of[back] >= 0
    votes = np.zeros((n, voters + 5), np.int8)
    votes[row[hit], of[back[hit]]] = 1
    hits = np.bincount(row[hit], weights=count[hit], minlength=n)
    # Pattern voters: no mark, two marks, dense marks, many capitals or exclamations.
    votes[:, voters] = np.where(hits == 0, -1, 0)
    votes[:, voters + 1] = np.where(hits >= 4, 1, np.where(hits < 2, -1, 0))
    votes[:, voters + 2] = np.where(hits / words > 0.004, 1, np.where(hits == 0, -1, 0))
    for j in (0, 1):
        votes[:, voters + 3 + j] = (pat[:, j] > np.quantile(pat[:, j], 0.97)).astype(np.int8)
    # A row's own label is one more witness, right nineteen times in twenty.
    start = 0.05 + 0.9 * y
    model = LabelModel.fit(votes, start)
    post = np.clip(model.posterior(votes, np.log(start / (1 - start))), 1e-6, 1 - 1e-6)

    # Linear classifier on the posterior labels.
    _, z = association(post)
    # Only terms that speak for the class: common words of clean rows would
    # let a long text outvote its own marks.
    keep = np.sort(np.argsort(-z)[:vocabulary])
    keep = keep[z[keep] > 2]
    slot = np.full(len(terms), -1)
    slot[keep] = np.arange(len(keep))
    use = slot[back] >= 0
    r, c, x = row[use], slot[back[use]], np.log1p(count[use])
    k = len(keep)
    pat = pat * 10                      # shares are small; let them learn at the terms' pace
    forward = lambda w, v, b: (b + pat @ v
                               + np.bincount(r, weights=x * w[c], minlength=n))
    backward = lambda d: (np.bincount(c, weights=x * d[r], minlength=k), pat.T @ d, d.sum())
    # Largest curvature of the loss, by power iteration.
    u = (np.ones(k), np.zeros(pat.shape[1]), 1.0)
    for _ in range(20):
        u = backward(forward(*u) / (4 * n))
        norm = np.sqrt(sum(float(np.sum(np.square(t))) for t in u))
        u = tuple(t / norm for t in u)
    # Both classes weigh alike, however rare one is.
    balance = 0.5 * (post / post.mean() + (1 - post) / (1 - post.mean()))
    rate = 1 / (1.1 * norm * balance.max())
    # Accelerated proximal steps: weights stay at or above zero, and terms
    # pay a price, so terms that only a few toxic rows share drop out.
    w = (np.zeros(k), np.zeros(pat.shape[1]), float(np.log(post.mean() / (1 - post.mean()))))
    look, t = w, 1.0
    for _ in range(steps):
        d = (1 / (1 + np.exp(-np.clip(forward(*look), -50, 50))) - post) * balance / n
        g = backward(d)
        new = (np.maximum(0, look[0] - rate * (g[0] + price / n)),
               np.maximum(0, look[1] - rate * (g[1] + 1e-3 * look[1])), look[2] - rate * g[2])
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = tuple(a + (t - 1) / t_new * (a - old) for a, old in zip(new, w))
        w, t = new, t_new
    w, v, b = w[0], w[1] * 10, w[2]
    return Scorer(terms[keep], w, v, float(b), model)


def _fold(id_col: str, folds: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", folds: int = 5, held: int = 0,
        max_labelled: int = 5000) -> Scorer:
    """Train on at most ``max_labelled`` labelled rows outside the held-out
    fold, those with the smallest hash of their id (a documented bound).  A
    document with several labels counts as toxic if any says so; rows with a
    null label or id are not learned from."""
    ids = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
                         & (_fold(id_col, folds) != held))
           .groupBy(F.col(id_col).cast("bigint").alias("doc_id"))
           .agg(F.max(F.col(label_col).cast("int")).alias("y"))
           .orderBy(F.xxhash64(F.lit(41), "doc_id"), "doc_id").limit(max_labelled).collect())
    if not ids:
        return train([], np.zeros(0))
    small = docs.sparkSession.createDataFrame(
        [(r["doc_id"], r["y"]) for r in ids], "l_id bigint, y int")
    rows = (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
            .join(F.broadcast(small), F.col("doc_id") == F.col("l_id"))
            .dropDuplicates(["doc_id"]).select("doc_id", "text", "y").collect())
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], np.array([r["y"] for r in rows]))


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text",
          folds: int = 5, held: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Null and empty texts get the score of a text without terms.  A null id is
    not held out.  Repeated rows stay repeated; other columns are not read.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
                      F.coalesce(_fold(id_col, folds) == held, F.lit(False)).alias("held_out"))

    def run(batches):
        for rows, data, offs in T.slices(batches, "text"):
            p = scorer.scores(data, offs)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return src.mapInArrow(run, SCHEMA)


def remove_toxic(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under 0.5, all columns unchanged."""
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches):
        for batch in batches:
            batch = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for rows, data, offs in T.slices([batch], f"c{at}"):
                yield rows.filter(pa.array(scorer.scores(data, offs) < 0.5)
                                  ).rename_columns(schema.names)

    return docs.mapInArrow(run, schema)
