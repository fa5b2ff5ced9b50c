"""Language of whole texts by a bidirectional gated recurrent network.

The network reads bytes, letter run by letter run, in both directions, and
gives a language distribution at every position; a document's probabilities
pool the log-probabilities of all its positions.  It is written in numpy and
trained by backpropagation through time on a bounded sample of labelled rows.

The state starts anew at each run of letters (runs are cut at ``RUN_BYTES``),
so equal runs have equal positions: a task labels each distinct run of a
slice once and weighs it by its number of occurrences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import textops as T

RUN_BYTES = 24
MEMO = 400_000            # remembered runs per worker, then forgotten
LETTERS = T.class_of([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
TABLE = T.byte_table(LETTERS, fold_case=True)
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class BiGRU:
    """Two gated recurrent layers over bytes (one per direction) and a softmax
    at every position.  Arrays are ``[time, batch, units]``."""

    def __init__(self, langs: int, units: int = 24, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        h = units
        self.h = h
        # Byte tables take the place of one-hot inputs; gates: update, reset, candidate.
        self.p = {}
        for d in "fb":
            self.p[d + "x"] = rng.normal(0, 0.3, (256, 3 * h))
            self.p[d + "u"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))
        self.p["o"] = rng.normal(0, 1 / np.sqrt(h), (2 * h, langs))
        self.p["c"] = np.zeros(langs)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _layer(self, x: np.ndarray, d: str, keep: bool):
        t, b = x.shape
        h, u = self.h, self.p[d + "u"]
        state = np.zeros((b, h), np.float32)
        out = np.empty((t, b, h), np.float32)
        tape = []
        gates = self.p[d + "x"][x]
        for i in range(t):
            prod = state @ u
            zr = _sigmoid(gates[i, :, :2 * h] + prod[:, :2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(gates[i, :, 2 * h:] + r * prod[:, 2 * h:])
            if keep:
                tape.append((state, z, r, n, prod[:, 2 * h:]))
            state = n + z * (state - n)
            out[i] = state
        return out, tape

    def _unroll(self, x, d, tape, dout, grads):
        """Gradient of one layer, last step first."""
        h, u = self.h, self.p[d + "u"]
        back = np.zeros_like(dout[0])
        gx, gu = grads[d + "x"], grads[d + "u"]
        for i in range(len(tape) - 1, -1, -1):
            state, z, r, n, un = tape[i]
            g = dout[i] + back
            dn = g * (1 - z) * (1 - n * n)
            dz = g * (state - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            gate = np.concatenate((dz, dr, dn), axis=1)
            rec = np.concatenate((dz, dr, dn * r), axis=1)
            np.add.at(gx, x[i], gate)
            gu += state.T @ rec
            back = g * z + rec @ u.T
        return grads

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """``[time, batch, langs]`` log-probabilities of every position."""
        f, _ = self._layer(x, "f", False)
        b, _ = self._layer(x[::-1], "b", False)
        s = np.concatenate((f, b[::-1]), axis=2) @ self.p["o"] + self.p["c"]
        s -= s.max(axis=2, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=2, keepdims=True))

    def step(self, x: np.ndarray, y: np.ndarray) -> dict:
        """Gradients of the mean cross-entropy over all positions."""
        t, b = x.shape
        f, tf = self._layer(x, "f", True)
        r, tb = self._layer(x[::-1], "b", True)
        both = np.concatenate((f, r[::-1]), axis=2)
        s = both @ self.p["o"] + self.p["c"]
        s = np.exp(s - s.max(axis=2, keepdims=True))
        s /= s.sum(axis=2, keepdims=True)
        s[:, np.arange(b), y] -= 1
        s /= t * b
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["o"] = np.einsum("tbi,tbj->ij", both, s, optimize=True)
        grads["c"] = s.sum(axis=(0, 1))
        dboth = s @ self.p["o"].T
        self._unroll(x, "f", tf, dboth[:, :, :self.h], grads)
        self._unroll(x[::-1], "b", tb, dboth[::-1, :, self.h:], grads)
        return grads

    def train(self, runs: dict[int, tuple[np.ndarray, np.ndarray]], steps: int, batch: int = 256,
              rate: float = 6e-3, seed: int = 3) -> None:
        """Adam over batches of runs of one length; ``runs``: length -> (bytes, label)."""
        rng = np.random.default_rng(seed)
        lengths = np.array(sorted(runs))
        weight = np.array([len(runs[n][1]) * n for n in lengths], float)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for i in range(1, steps + 1):
            data, label = runs[int(rng.choice(lengths, p=weight / weight.sum()))]
            pick = rng.integers(0, len(label), batch)
            grads = self.step(data[pick].T, label[pick])
            lr = rate * min(1.0, 2.0 * (1 - (i - 1) / steps))
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= (lr * (m[k] / (1 - 0.9 ** i))
                              / (np.sqrt(v[k] / (1 - 0.99 ** i)) + 1e-8)).astype(np.float32)


def _runs(data: np.ndarray, offs: np.ndarray):
    """Letter runs of at most ``RUN_BYTES`` bytes: start, length, row."""
    starts, ends, row = T.word_spans(data, offs, LETTERS)
    size = ends - starts
    if (size > RUN_BYTES).any():
        pieces = -(-size // RUN_BYTES)
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(starts, pieces) + k * RUN_BYTES
        size = np.minimum(np.repeat(ends, pieces) - begin, RUN_BYTES)
        starts, row = begin, np.repeat(row, pieces)
    return starts, size, row


def _fold(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table[data]


class Labeler:
    """Labels every position of whole texts; remembers distinct runs."""

    def __init__(self, net: BiGRU, langs: list[str]) -> None:
        self.net, self.langs = net, langs
        self.hash = np.zeros(0, np.uint64)
        self.logs = np.zeros((0, len(langs)), np.float32)

    def _label(self, data, starts, size) -> np.ndarray:
        """Sum of log-probabilities over the positions of each run."""
        out = np.empty((len(starts), len(self.langs)), np.float32)
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            for lo in range(0, len(at), 4096):
                part = at[lo:lo + 4096]
                x = data[starts[part][None, :] + np.arange(n)[:, None]]
                out[part] = self.net.log_probs(x).sum(axis=0)
        return out

    def rows(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row: pooled log-probabilities, and number of positions."""
        n = len(offs) - 1
        pooled = np.zeros((n, len(self.langs)))
        data = _fold(data)
        starts, size, row = _runs(data, offs)
        if not len(starts):
            return pooled, np.zeros(n)
        p, inv = T.powers(len(data))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(TABLE[data] * p[:len(data)])))
        h = T.mix64((total[starts + size] - total[starts]) * inv[starts])
        uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
        logs = np.empty((len(uniq), len(self.langs)), np.float32)
        at = np.minimum(np.searchsorted(self.hash, uniq), max(len(self.hash) - 1, 0))
        known = self.hash[at] == uniq if len(self.hash) else np.zeros(len(uniq), bool)
        logs[known] = self.logs[at[known]] if len(self.hash) else 0
        fresh = first[~known]
        if len(fresh):
            logs[~known] = self._label(data, starts[fresh], size[fresh])
            if len(self.hash) + len(fresh) > MEMO:
                self.hash, self.logs = uniq, logs
            else:
                merged = np.concatenate((self.hash, uniq[~known]))
                order = np.argsort(merged)
                self.hash = merged[order]
                self.logs = np.concatenate((self.logs, logs[~known]))[order]
        for j in range(len(self.langs)):
            pooled[:, j] = np.bincount(row, weights=logs[back, j], minlength=n)
        return pooled, np.bincount(row, weights=size, minlength=n)


def _has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows with an ASCII letter, or another character that is a letter."""
    n = len(offs) - 1
    ascii_letter = LETTERS[data] & (data < 0x80)
    total = np.concatenate(([0], np.cumsum(ascii_letter)))
    has = total[offs[1:]] > total[offs[:-1]]
    for i in np.flatnonzero(~has & (offs[1:] > offs[:-1])):
        text = data[offs[i]:offs[i + 1]].tobytes().decode("utf-8", "replace")
        has[i] = any(c.isalpha() for c in text)
    return has


def labelled_sample(docs: DataFrame, per_lang: int) -> list:
    """About ``per_lang`` labelled rows of every language, chosen by hash."""
    h = F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1 << 20))
    rows = docs.filter(F.col("learn") & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for k, n in counts.items()
                           for x in (k, min(1 << 20, int((1 << 20) * 1.2 * per_lang / n) + 1))))
    picked = (rows.filter(h < share[F.col("lang")]).select("lang", "text", "doc_id").collect())
    by: dict = {}
    for r in sorted(picked, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
        if len(by.setdefault(r["lang"], [])) < per_lang:
            by[r["lang"]].append(r["text"])
    return sorted(by.items())


def fit(sample: list, steps: int, units: int) -> tuple[BiGRU | None, list[str]]:
    langs = [k for k, _ in sample]
    if not langs:
        return None, []
    parts: dict[int, list] = {}
    for y, (_, texts) in enumerate(sample):
        arr = pa.array([t or "" for t in texts], pa.large_string())
        data, offs = T.text_bytes(arr)
        data = _fold(data)
        starts, size, _ = _runs(data, offs)
        for n in np.unique(size):
            at = starts[size == n]
            parts.setdefault(int(n), []).append(
                (data[at[:, None] + np.arange(n)], np.full(len(at), y)))
    runs = {n: (np.concatenate([a for a, _ in v]), np.concatenate([b for _, b in v]))
            for n, v in parts.items()}
    net = BiGRU(len(langs), units)
    if len(langs) > 1 and runs:
        net.train(runs, steps)
    return net, langs


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", folds: int = 4, held: int = 2, per_lang: int = 300,
             steps: int = 1500, units: int = 24) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row.

    Learns from text and non-null language of rows whose ``crc32`` of the id
    as text is not ``held`` modulo ``folds``, about ``per_lang`` whole texts a
    language (a documented bound of the training sample).  ``lang_pred`` is
    ``und`` with score 0 if the text is null or has no letter, or if there is
    nothing to learn from.  The score is the predicted language's share of
    the pooled probabilities (geometric mean over positions).  A null id is
    in no fold: not held out, and not learned from.
    """
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
    held_out = F.coalesce(fold == held, F.lit(False))
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
                      held_out.alias("held_out"))
    learn = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
                        F.col(lang_col).cast("string").alias("lang"),
                        F.coalesce(fold != held, F.lit(False)).alias("learn"))
    net, langs = fit(labelled_sample(learn, per_lang), steps, units)

    def run(batches):
        labeler = Labeler(net, langs) if langs else None
        for rows, data, offs in T.slices(batches, "text"):
            n = rows.num_rows
            pred, score = np.full(n, "und", object), np.zeros(n)
            if langs:
                pooled, positions = labeler.rows(data, offs)
                mean = pooled / np.maximum(positions, 1)[:, None]
                mean = np.exp(mean - mean.max(axis=1, keepdims=True))
                share = mean / mean.sum(axis=1, keepdims=True)
                best = pooled.argmax(axis=1)
                ok = _has_letter(data, offs)
                pred[ok] = np.array(langs, object)[best[ok]]
                score[ok] = share[np.arange(n), best][ok]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.array(pred.tolist(), pa.string()), pa.array(score)],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return src.mapInArrow(run, SCHEMA)
