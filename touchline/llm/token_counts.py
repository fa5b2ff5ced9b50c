"""Token counts with a piece-merge (BPE) model, without the tokenizer library.

Method: rank-synchronous array merging.  The distinct pre-tokens of a slice
of documents are held as one ragged numpy array of symbols.  In each round
every sequence applies its lowest-rank pair, all sequences at once, until no
pair is left; the surviving symbols are counted.

Pre-tokens are cut where no piece of the model can reach across: a piece
holds the word mark only at its start, so text is cut before each run of
spaces (``PieceModel`` checks this and refuses other models).
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import textops as T

MARK = "▁"
# Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NONE = np.int32(2**31 - 1)
MEMO = 1_000_000   # remembered pre-token counts per worker, then forgotten

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def _fields(buf: bytes) -> Iterator[tuple[int, int, object]]:
    """Fields of one protocol-buffer message: (number, wire type, value)."""
    i = 0

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = buf[i]
            i += 1
            out |= (b & 127) << shift
            if b < 128:
                return out, i
            shift += 7

    while i < len(buf):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = buf[i:i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = buf[i:i + n], i + n
        yield tag >> 3, kind, value


class PieceModel:
    """Pieces, scores and pair table of a model file.

    Merging goes by the joined string: two neighbours merge if their joined
    text is a piece; the higher score first, then the leftmost.
    """

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            raw = f.read()
        pieces: list[tuple[str, float, int]] = []
        self.dummy_prefix, squeeze, escape, charsmap, kind, fallback = True, True, True, b"", 1, False
        for number, _, value in _fields(raw):
            if number == 1:
                text, score, typ = "", 0.0, NORMAL
                for n, _, v in _fields(value):
                    if n == 1:
                        text = v.decode("utf-8")
                    elif n == 2:
                        score = float(np.frombuffer(v, np.float32)[0])
                    elif n == 3:
                        typ = v
                pieces.append((text, score, typ))
            elif number == 2:
                for n, _, v in _fields(value):
                    kind = v if n == 3 else kind
                    fallback = bool(v) if n == 35 else fallback
            elif number == 3:
                for n, _, v in _fields(value):
                    charsmap = v if n == 2 else charsmap
                    self.dummy_prefix = bool(v) if n == 3 else self.dummy_prefix
                    squeeze = bool(v) if n == 4 else squeeze
                    escape = bool(v) if n == 5 else escape
        if kind != 2 or charsmap or squeeze or not escape:
            raise ValueError("only merge models with the identity normaliser are supported")
        if any(t in (USER, UNUSED) for _, _, t in pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        vocab = {s: v for s, v, t in pieces if t == NORMAL}
        if any(MARK in s.lstrip(MARK) for s in vocab):
            raise ValueError("a piece holds the word mark inside")
        self._build(vocab, fallback)

    def _build(self, vocab: dict[str, float], fallback: bool) -> None:
        chars = {c for s in vocab for c in s}
        ids = {s: i for i, s in enumerate(sorted(set(vocab) | chars))}
        order = {v: r for r, v in enumerate(sorted(set(vocab.values()), reverse=True))}
        shared: dict[float, int] = {}
        for v in vocab.values():
            shared[v] = shared.get(v, 0) + 1
        self.stride = np.int64(len(ids) + 1)
        pairs: dict[int, tuple[int, int]] = {}
        lowest = {}
        for s, v in vocab.items():
            for cut in range(1, len(s)):
                a, b = ids.get(s[:cut]), ids.get(s[cut:])
                if a is None or b is None:
                    continue
                rank = order[v]
                pairs[a * int(self.stride) + b] = (ids[s], rank)
                for part in (a, b):
                    lowest[part] = min(lowest.get(part, int(NONE)), rank)
        keys = np.array(sorted(pairs), np.int64)
        self.keys = keys
        self.joined = np.array([pairs[int(k)][0] for k in keys], np.int32)
        self.rank = np.array([pairs[int(k)][1] for k in keys], np.int32)
        # A rank may be applied everywhere at once if only one piece has it
        # and no pair made with that piece ranks as low.
        once = np.zeros(len(order) + 1, bool)
        for s, v in vocab.items():
            once[order[v]] = shared[v] == 1 and lowest.get(ids[s], int(NONE)) > order[v]
        self.once = once
        # Symbol of each code point, and the tokens that it counts as alone.
        self.symbol = np.full(0x110000, -1, np.int32)
        cp = np.arange(0x110000)
        width = np.where(cp < 0x80, 1, np.where(cp < 0x800, 2, np.where(cp < 0x10000, 3, 4)))
        self.alone = (width if fallback else np.ones_like(width)).astype(np.int32)
        for c in chars:
            self.symbol[ord(c)] = ids[c]
        for c in vocab:
            if len(c) == 1:
                self.alone[ord(c)] = 1
        self.symbol[0x20], self.alone[0x20] = self.symbol[ord(MARK)], self.alone[ord(MARK)]
        self.width = width.astype(np.int32)
        beside = {(s[i], s[i + 1]) for s in vocab for i in range(len(s) - 1)}
        self.beside = np.array(sorted(ids[a] * int(self.stride) + ids[b] for a, b in beside), np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) * self.stride + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank[at], NONE), self.joined[at]

    def count(self, cps: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each sequence of code points (``offs`` as in Arrow)."""
        n_seq = len(offs) - 1
        sym = self.symbol[cps]
        total = np.zeros(n_seq, np.int64)
        if not len(cps):
            return total
        seq = np.repeat(np.arange(n_seq), np.diff(offs))
        # Unmergeable symbols count as they are; every merge takes one away.
        np.add.at(total, seq, self.alone[cps])
        # Cut sequences further wherever two neighbours are in no piece.
        key = sym[:-1].astype(np.int64) * self.stride + sym[1:]
        at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        tied = (self.beside[at] == key) & (sym[:-1] >= 0) & (sym[1:] >= 0) & (seq[:-1] == seq[1:])
        part = np.concatenate(([0], np.cumsum(~tied)))
        own = self.alone[cps].astype(np.int64)   # tokens of a symbol while it is one code point
        rank = np.full(len(sym), NONE, np.int32)
        join = np.zeros(len(sym), np.int32)
        rank[:-1], join[:-1] = self._ranks(sym[:-1], sym[1:])
        rank[:-1][part[:-1] != part[1:]] = NONE
        while True:
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            best = np.minimum.reduceat(rank, starts)
            live = best < NONE
            if not live.any():
                return total
            length = np.diff(np.append(starts, len(part)))
            keep = np.repeat(live, length)
            if not live.all():
                sym, part, seq, own, rank, join = (x[keep] for x in (sym, part, seq, own, rank, join))
                best, length = best[live], length[live]
                starts = np.concatenate(([0], np.cumsum(length)[:-1]))
            hit = rank == np.repeat(best, length)
            where = np.flatnonzero(hit)
            # Runs of neighbouring hits overlap: take every second from the left.
            run = np.concatenate(([0], np.cumsum(np.diff(where) != 1)))
            first = where[np.concatenate(([True], np.diff(run) != 0))]
            where = where[(where - first[run]) % 2 == 0]
            # Ranks that are not safe together: only the leftmost.
            p = part[where]
            leftmost = np.concatenate(([True], p[1:] != p[:-1]))
            where = where[leftmost | self.once[rank[where]]]
            np.add.at(total, seq[where], 1 - own[where] - own[where + 1])
            sym[where] = join[where]
            own[where] = 1
            stay = np.ones(len(sym), bool)
            stay[where + 1] = False
            touched = np.zeros(len(sym), bool)
            touched[where] = True
            touched[np.maximum(where - 1, 0)] = True
            # A left neighbour that has itself just been taken in moves on.
            back = np.maximum(where - 2, 0)
            touched[back] = True
            sym, part, seq, own, rank, join, touched = (
                x[stay] for x in (sym, part, seq, own, rank, join, touched))
            i = np.flatnonzero(touched)
            last = i == len(sym) - 1
            j = np.minimum(i + 1, len(sym) - 1)
            r, s = self._ranks(sym[i], sym[j])
            r[last | (part[i] != part[j])] = NONE
            rank[i], join[i] = r, s


class _Counter:
    """Counts whole texts; remembers counts of pre-tokens by hash."""

    def __init__(self, path: str) -> None:
        self.model = PieceModel(path)
        self.table = T.byte_table(np.ones(256, bool), fold_case=False)
        self.hash, self.tokens = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def counts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        if not len(data):
            return np.zeros(n, np.int64)
        space = data == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        edge = offs[:-1][offs[:-1] < offs[1:]]
        start[edge] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(data))
        row = np.searchsorted(offs, starts, side="right") - 1
        h = T.span_hashes(data, starts, self.table)
        first = np.zeros(len(starts), bool)
        if self.model.dummy_prefix:
            first[np.searchsorted(starts, edge)] = True
        h = np.where(first, T.mix64(h + np.uint64(1)), h)
        uniq, back = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash, uniq), max(len(self.hash) - 1, 0))
        known = self.hash[at] == uniq if len(self.hash) else np.zeros(len(uniq), bool)
        tokens = np.zeros(len(uniq), np.int64)
        if known.any():
            tokens[known] = self.tokens[at[known]]
        if not known.all():
            rep = np.zeros(len(uniq), np.int64)
            rep[back] = np.arange(len(h))
            rep = rep[~known]
            tokens[~known] = self._count_spans(data, starts[rep], ends[rep], first[rep])
            if len(self.hash) + len(rep) > MEMO:
                self.hash, self.tokens = uniq, tokens
            else:
                merged = np.concatenate((self.hash, uniq[~known]))
                order = np.argsort(merged)
                self.hash = merged[order]
                self.tokens = np.concatenate((self.tokens, tokens[~known]))[order]
        return np.bincount(row, weights=tokens[back], minlength=n).astype(np.int64)

    def _count_spans(self, data, starts, ends, first) -> np.ndarray:
        length = ends - starts + first
        offs = np.concatenate(([0], np.cumsum(length)))
        flat = np.arange(offs[-1]) - np.repeat(offs[:-1] + first, length) + np.repeat(starts, length)
        raw = data[np.maximum(flat, 0)]
        raw[offs[:-1][first]] = 0x20
        text = raw.tobytes().decode("utf-8", errors="replace")
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begin = (raw & 0xC0) != 0x80
        per = np.add.reduceat(begin.astype(np.int64), offs[:-1])
        return self.model.count(cps, np.concatenate(([0], np.cumsum(per))))


def _marks_as_spaces(column: pa.Array) -> pa.Array:
    return pc.replace_substring(column, MARK, " ")


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text.

    One row per input row (repeated ids stay repeated, a null id stays null):
    ``doc_id, n_bytes, n_tokens, over_limit``.  A null or empty text has 0
    bytes and 0 tokens.  Other columns of ``docs`` are not read.  The model
    file must be readable at ``model_path`` on every executor.
    """

    def run(batches):
        counter = _Counter(model_path)
        mark = MARK.encode()
        for rows, data, offs in T.slices(batches, "text"):
            n_bytes = np.diff(offs)
            if mark in data.tobytes():
                data, offs = T.text_bytes(_marks_as_spaces(rows.column(1).fill_null("")))
            n = counter.counts(data, offs)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n_bytes), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
