"""Removal of long repeated byte strings by column-wise BWT construction.

A byte goes if a ``SPAN``-byte string that covers it also starts anywhere
else.  Strings are found in three steps, none of which gathers the corpus:

1. *Anchors.*  Every ``SPAN``-byte window names as its anchor the leftmost of
   its ``GRAM``-byte grams with the smallest hash.  Equal windows have equal
   anchors at equal offsets.  Gram hashes meet in hash-range buckets as packed
   blobs; only anchors that occur twice go on.  Anchors that meet twice in a
   task are answered there and cost their bucket one marker.
2. *Columns.*  The surroundings of equal anchors (at most ``2 * SPAN`` bytes)
   are short documents, aligned at the anchor.  Their collection is sorted
   column by column from the right: each round inserts one symbol per
   document in front of its suffix, which gives the round's column of the
   Burrows-Wheeler transform, the new order (stable by symbol) and the new
   longest common prefixes (one more than the minimum over the old range).
   Columns are read one after the other from a sequential file on local
   scratch.  In the round of a window, it is repeated exactly if the common
   prefix with a neighbour in order has ``SPAN`` bytes or more.  Equal
   surroundings are merged before the shuffle and count as repeated.
3. *Removal.*  Runs of repeated window starts go back to their documents.

An anchor with more than ``hot`` occurrences is split into blocks; windows
that a block cannot settle meet those of the other blocks by hash.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import textops as T
from touchline.llm.packing import arrow_schema, pack, unpack
from touchline.llm.tables import staged

SPAN = 400                    # bytes of a repeated string, unless given
GRAM = 32
MARKER = 0xFFFF
BUCKET_TEXT = 64 << 20
FLUSH_ANCHORS = 400_000
FLUSH_ROWS = 60_000
BLOCK_BYTES = 4 << 20         # surroundings that are sorted together
MIN_HOT = 200_000             # occurrences of an anchor that one task sorts at least
HOT_KEYS = 100_000            # most anchors that can be above the limit
LOW48 = np.uint64((1 << 48) - 1)

ALL = T.byte_table(np.ones(256, bool), fold_case=False, seed=77)
PACKED = "dest int, blob binary"
ANSWER = "kind int, doc_id bigint, rk bigint, keys binary"
MEMBER = ("kind int, key bigint, salt int, ctx binary, right int, doc_id bigint, rk bigint, "
          "lo int, hi int, several boolean")
FOUND = "kind int, doc_id bigint, rk bigint, lo int, hi int, key bigint, whash bigint, settled boolean"
RESULT = ("doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
          "spans array<struct<lo:int,hi:int>>")


# ------------------------------------------------------------------- anchors

def prefix_hash(data: np.ndarray) -> np.ndarray:
    p, _ = T.powers(len(data))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(ALL[data] * p[:len(data)])))


def anchors(data: np.ndarray, offs: np.ndarray, total: np.ndarray, span: int = SPAN):
    """Anchors of all windows: row, first and last window start, place of the
    gram, hash of the gram (places count from the slice's start)."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    if len(data) < span:
        return none
    _, inv = T.powers(len(data))
    n = len(data) - GRAM + 1
    h = T.mix64((total[GRAM:] - total[:-GRAM]) * inv[:n])
    # High half: hash; low half: place.  The smallest is the leftmost of equals.
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    wide, reach = span - GRAM + 1, 1
    while reach * 2 <= wide:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    starts = len(data) - span + 1
    low = np.minimum(low[:starts], low[wide - reach:wide - reach + starts])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    step = np.zeros(len(data) + 1, np.int32)
    long = np.flatnonzero(np.diff(offs) >= span)
    np.add.at(step, offs[long], 1)
    np.add.at(step, offs[long + 1] - span + 1, -1)
    valid = np.cumsum(step[:starts]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (place[1:] != place[:-1])
    lo, hi = np.flatnonzero(new), np.flatnonzero(last)
    row = np.searchsorted(offs, lo, side="right") - 1
    return row, lo, hi, place[lo], h[place[lo]]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _key(h: np.ndarray, buckets: int) -> np.ndarray:
    """Name of an anchor: low 48 bits and bucket."""
    return (h & LOW48) | (_bucket(h, buckets) & np.uint64(0xFFFF)) << np.uint64(48)


def _batch(dest, blobs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(dest, pa.int32()), pa.array(blobs, pa.binary())],
                                      names=["dest", "blob"])


def _to_shards(ids, rk, null, key, at, buckets, shards):
    shard = (rk.view(np.uint64) % np.uint64(shards)).astype(np.int64)[at]
    order = np.argsort(shard, kind="stable")
    key, at = key[order], at[order]
    edge = np.searchsorted(shard[order], np.arange(shards + 1))
    dest, blobs = [], []
    for s in np.flatnonzero(np.diff(edge)):
        a, b = edge[s], edge[s + 1]
        used, local = np.unique(at[a:b], return_inverse=True)
        dest.append(buckets + int(s))
        blobs.append(pack(ids[used], rk[used], null[used], key[a:b], local.astype(np.int32)))
    return dest, blobs


def _send(ids, rk, null, h, at, buckets, shards):
    """Pack the anchors of a batch of rows by bucket."""
    order = np.argsort(h)
    h, at = h[order], at[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(h)))
    bucket = _bucket(h, buckets)
    known = np.repeat(length > 1, length)
    dest, blobs = _to_shards(ids, rk, null, _key(h[known], buckets), at[known], buckets, shards)
    one, many = start[length == 1], start[length > 1]
    edges = [np.searchsorted(bucket[x], np.arange(buckets + 1).astype(np.uint64)) for x in (one, many)]
    counts = length[length > 1].astype(np.int32)
    for b in range(buckets):
        i, j = one[edges[0][b]:edges[0][b + 1]], many[edges[1][b]:edges[1][b + 1]]
        if not len(i) and not len(j):
            continue
        used, local = np.unique(at[i], return_inverse=True)
        entry = (h[i] & LOW48) << np.uint64(16) | local.astype(np.uint64)
        dest.append(b)
        blobs.append(pack(ids[used], rk[used], null[used], entry, h[j] & LOW48,
                          counts[edges[1][b]:edges[1][b + 1]]))
    return dest, blobs


def _answer(bucket: int, table: pa.Table, buckets: int, shards: int, hot: int):
    """Anchors of the bucket that occur twice; those above the hot limit."""
    parts = [unpack(b.as_py(), np.int64, np.int64, np.int8, np.uint64, np.uint64, np.int32)
             for b in table.column("blob")]
    ids, rk, null = (np.concatenate([p[i] for p in parts]) for i in range(3))
    base = np.cumsum([0] + [len(p[0]) for p in parts])
    key = np.concatenate([p[3] >> np.uint64(16) for p in parts] + [p[4] for p in parts])
    at = np.concatenate([(p[3] & np.uint64(MARKER)).astype(np.int64) + b for p, b in zip(parts, base)]
                        + [np.full(len(p[4]), -1) for p in parts])
    count = np.concatenate([np.ones(len(p[3]), np.int64) for p in parts]
                           + [p[5].astype(np.int64) for p in parts])
    if not len(key):
        return [], []
    order = np.argsort(key, kind="stable")
    key, at, count = key[order], at[order], count[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    length = np.diff(np.append(start, len(key)))
    total = np.add.reduceat(count, start)
    tag = np.uint64(bucket & 0xFFFF) << np.uint64(48)
    twice = np.repeat(total > 1, length) & (at >= 0)
    dest, blobs = _to_shards(ids, rk, null, key[twice] | tag, at[twice], buckets, shards)
    over = total > hot
    if over.any():
        dest.append(buckets + bucket % shards)
        blobs.append(pack((key[start[over]] | tag), total[over]))
    return dest, blobs


def _gather(table: pa.Table, schema: pa.Schema):
    """Repeated anchors of every row of a shard, and hot anchors."""
    parts, hot = [], []
    for b in table.column("blob"):
        raw = b.as_py()
        if np.frombuffer(raw, np.int32, 1)[0] == 2:
            hot.append(unpack(raw, np.uint64, np.int64))
        else:
            parts.append(unpack(raw, np.int64, np.int64, np.int8, np.uint64, np.int32))
    out = []
    for key, total in hot:
        out.append(pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(key), np.int32)), pa.array(key.view(np.int64)), pa.array(total),
             pa.nulls(len(key), pa.binary())], schema=schema))
    if parts:
        ids, rk, null, key = (np.concatenate([p[i] for p in parts]) for i in range(4))
        base = np.cumsum([0] + [len(p[0]) for p in parts])
        at = np.concatenate([p[4] + b for p, b in zip(parts, base)])
        # A row may come in several parts.
        order = np.lexsort((null, ids, rk))
        new = np.ones(len(order), bool)
        new[1:] = ((rk[order][1:] != rk[order][:-1]) | (ids[order][1:] != ids[order][:-1])
                   | (null[order][1:] != null[order][:-1]))
        name = np.empty(len(order), np.int64)
        name[order] = np.cumsum(new) - 1
        first = order[new]
        at = name[at]
        order = np.lexsort((key, at))
        key, at = key[order], at[order]
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
        key, at = key[keep], at[keep]
        edge = T.row_starts(at, len(first))
        for lo in range(0, len(first), 5000):
            f = first[lo:lo + 5000]
            blobs = [key[edge[lo + i]:edge[lo + i + 1]].tobytes() for i in range(len(f))]
            out.append(pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(f), np.int32)), pa.array(ids[f], mask=null[f].astype(bool)),
                 pa.array(rk[f]), pa.array(blobs, pa.binary())], schema=schema))
    return pa.Table.from_batches(out, schema=schema)


def repeated_anchors(src: DataFrame, buckets: int, hot: int, span: int) -> DataFrame:
    """Staged table (``ANSWER``): kind 0, the repeated anchors of each row that
    has any; kind 1, hot anchors (``doc_id``: key, ``rk``: occurrences)."""
    schema, shards = arrow_schema(ANSWER), buckets

    def read(batches):
        held = []

        def flush():
            ids, rk, null, h = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2, 4))
            base = np.cumsum([0] + [len(x[0]) for x in held])
            at = np.concatenate([x[3] + b for x, b in zip(held, base)])
            held.clear()
            for lo in range(0, len(ids), FLUSH_ROWS):
                m = (at >= lo) & (at < lo + FLUSH_ROWS)
                if m.any():
                    hi = min(len(ids), lo + FLUSH_ROWS)
                    yield _batch(*_send(ids[lo:hi], rk[lo:hi], null[lo:hi], h[m], at[m] - lo,
                                        buckets, shards))

        for rows, data, offs in T.slices(batches, "text"):
            row, _, _, _, h = anchors(data, offs, prefix_hash(data), span)
            ids = rows.column(0)
            held.append((ids.fill_null(0).to_numpy(), rows.column(1).to_numpy(),
                         np.array(ids.is_null()).astype(np.int8), row, h))
            if sum(len(x[4]) for x in held) >= FLUSH_ANCHORS or sum(len(x[0]) for x in held) >= FLUSH_ROWS:
                yield from flush()
        if held:
            yield from flush()

    def answer(key, table):
        if key[0].as_py() >= buckets:
            return table
        return pa.Table.from_batches([_batch(*_answer(key[0].as_py(), table, buckets, shards, hot))])

    answers = src.mapInArrow(read, PACKED).groupBy("dest").applyInArrow(answer, PACKED)
    return staged(answers.groupBy("dest").applyInArrow(lambda k, t: _gather(t, schema), ANSWER), "anchors")


# ------------------------------------------------------------------- columns

class ColumnFile:
    """Symbols of aligned short documents by column: one sequential file on
    local scratch, written in blocks of rows and read column by column."""

    def __init__(self, texts: list[np.ndarray], right: np.ndarray) -> None:
        self.n = len(texts)
        size = np.array([len(t) for t in texts])
        # Column c holds the symbol c places right of the anchor; from..to per row.
        self.to = right
        self.start = right - size
        self.first, self.end = int(self.start.min()), int(self.to.max())
        self.file = tempfile.TemporaryFile()
        self.data = np.memmap(self.file, np.uint8, "w+", shape=(self.end - self.first, self.n))
        for lo in range(0, self.n, 2048):
            part = np.zeros((min(2048, self.n - lo), self.end - self.first), np.uint8)
            for i, t in enumerate(texts[lo:lo + 2048]):
                a = self.start[lo + i] - self.first
                part[i, a:a + len(t)] = t
            self.data[:, lo:lo + 2048] = part.T

    def column(self, c: int) -> np.ndarray:
        return np.asarray(self.data[c - self.first])

    def close(self) -> None:
        del self.data
        self.file.close()


def sort_columns(texts: list[np.ndarray], right: np.ndarray, group: np.ndarray,
                 near: np.ndarray, far: np.ndarray, span: int = SPAN):
    """Repeated windows of aligned texts, by inserting one column per round.

    ``right[i]``: columns of text i right of the anchor's start; ``group``:
    ascending; windows of text i start ``near[i]`` to ``far[i]`` places left
    of the anchor.  Gives runs of repeated windows: (text, nearest, farthest).
    """
    cols = ColumnFile(texts, right)
    n = len(texts)
    order = np.arange(n)
    lcp = np.zeros(n + 1, np.int32)           # with the text before in order; 0 at the ends
    open_at = np.full(n, -1, np.int64)
    runs = []
    try:
        for c in range(cols.end - 1, cols.first - 1, -1):
            # Texts that end right of this column have nothing left to insert.
            done = cols.start[order] > c
            if done.any() and done.mean() > 0.2:
                order, lcp = _without(order, lcp, done)
                done = np.zeros(len(order), bool)
            if not len(order):
                break
            symbol = cols.column(c)[order].astype(np.int64) + 1
            inside = (cols.to[order] > c) & ~done
            symbol[~inside] = 0
            key = group[order] * 257 + symbol
            by = np.argsort(key, kind="stable")
            key = key[by]
            fresh = np.zeros(len(by) + 1, np.int32)
            same = np.flatnonzero((key[1:] == key[:-1]) & (symbol[by][1:] > 0))
            p, q = by[same], by[same + 1]
            low = lcp[q].copy()
            apart = np.flatnonzero(q - p > 1)
            if len(apart):
                at = np.stack((p[apart] + 1, q[apart] + 1), axis=1).reshape(-1)
                low[apart] = np.minimum.reduceat(lcp, at)[::2]
            fresh[same + 1] = np.minimum(low + 1, 1 << 20)
            order, lcp = order[by], fresh
            d = -c
            if d < 0:
                continue
            active = (near[order] <= d) & (d <= far[order])
            hit = active & (np.maximum(lcp[:-1], lcp[1:]) >= span)
            begin = order[hit & (open_at[order] < 0)]
            open_at[begin] = d
            close = order[~hit & (open_at[order] >= 0)]
            if len(close):
                runs.append((close, open_at[close], np.full(len(close), d - 1)))
                open_at[close] = -1
        rest = np.flatnonzero(open_at >= 0)
        runs.append((rest, open_at[rest], far[rest]))
    finally:
        cols.close()
    return tuple(np.concatenate([r[i] for r in runs]) for i in range(3))


def _without(order, lcp, gone):
    """Drop texts from the order; common prefixes span the gaps."""
    keep = np.flatnonzero(~gone)
    if not len(keep):
        return order[:0], np.zeros(1, np.int32)
    out = np.zeros(len(keep) + 1, np.int32)
    if len(keep) > 1:
        at = np.stack((keep[:-1] + 1, keep[1:] + 1), axis=1).reshape(-1)
        out[1:-1] = np.minimum.reduceat(lcp, at)[::2]
    return order[keep], out


# --------------------------------------------------------------- surroundings

def _members(rows, data, offs, keys, buckets: int, hot: dict, hot_limit: int, span: int):
    """Surroundings of the repeated anchors of a slice; equal ones once."""
    total = prefix_hash(data)
    row, lo, hi, place, h = anchors(data, offs, total, span)
    key = _key(h, buckets)
    want = np.zeros(len(key), bool)
    edge = T.row_starts(row, len(offs) - 1)
    for i, raw in enumerate(keys):
        a, b = edge[i], edge[i + 1]
        if a < b and raw is not None:
            known = np.frombuffer(raw, np.uint64)
            at = np.minimum(np.searchsorted(known, key[a:b]), len(known) - 1)
            want[a:b] = known[at] == key[a:b]
    row, lo, hi, place, key = (x[want] for x in (row, lo, hi, place, key))
    if not len(row):
        return None
    _, inv = T.powers(len(data))
    right = hi + span - place                     # bytes from the anchor's start on
    same = T.mix64((total[hi + span] - total[lo]) * inv[lo]
                   + T.mix64(key + (right * 1024 + hi - lo).astype(np.uint64)))
    _, first, back, count = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
    several = count[back] > 1
    salt = np.zeros(len(first), np.int32)
    if hot:
        blocks = np.array([-(-hot.get(k, 0) // hot_limit) for k in key[first].tolist()], np.int64)
        # Numbered from 1: 0 is the one block of an ordinary anchor.
        m = blocks > 0
        salt[m] = (same[first][m] % blocks[m].astype(np.uint64)).astype(np.int32) + 1
    return row, lo, hi, key, right, first, several, salt


def surroundings(joined: DataFrame, buckets: int, hot: dict, hot_limit: int, span: int) -> DataFrame:
    """Rows of ``MEMBER``: kind 0, surroundings of a repeated anchor; kind 1, a
    run of windows that repeat within the slice."""
    schema = arrow_schema(MEMBER)

    def run(batches):
        for rows, data, offs in T.slices(batches, "text"):
            m = _members(rows, data, offs, rows.column(3).to_pylist(), buckets, hot, hot_limit, span)
            if m is None:
                continue
            row, lo, hi, key, right, first, several, salt = m
            ids, rk = rows.column(0), rows.column(1)
            # Members.
            a, n = lo[first], hi[first] + span - lo[first]
            edge = np.concatenate(([0], np.cumsum(n)))
            flat = data[np.arange(edge[-1]) - np.repeat(edge[:-1] - a, n)]
            ctx = pa.Array.from_buffers(pa.binary(), len(first), [
                None, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
            pick = pa.array(row[first])
            shift = offs[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(first), np.int32)), pa.array(key[first].view(np.int64)),
                 pa.array(salt), ctx, pa.array(right[first].astype(np.int32)), ids.take(pick),
                 rk.take(pick), pa.array((lo - shift)[first].astype(np.int32)),
                 pa.array((hi - shift)[first].astype(np.int32)), pa.array(several[first])],
                schema=schema)
            # Runs that are settled here.
            at = np.flatnonzero(several)
            if len(at):
                pick = pa.array(row[at])
                # They only pass through: dealt by their row, not by the anchor.
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(len(at), np.int32)), rk.take(pick),
                     pa.array(np.full(len(at), -1, np.int32)), pa.nulls(len(at), pa.binary()),
                     pa.nulls(len(at), pa.int32()), ids.take(pick), rk.take(pick),
                     pa.array((lo - shift)[at].astype(np.int32)),
                     pa.array((hi - shift)[at].astype(np.int32)), pa.array(np.ones(len(at), bool))],
                    schema=schema)

    return joined.mapInArrow(run, MEMBER)


def _sorted_block(t: pa.Table, schema: pa.Schema, span: int):
    """Repeated windows of a block of whole groups."""
    key, salt = t.column("key").to_numpy(), t.column("salt").to_numpy()
    right = t.column("right").to_numpy().astype(np.int64)
    lo, hi = t.column("lo").to_numpy().astype(np.int64), t.column("hi").to_numpy().astype(np.int64)
    several = t.column("several").to_numpy().copy()
    data, offs = T.text_bytes(t.column("ctx"))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
    group = np.cumsum(new) - 1
    name = np.zeros(len(key), np.uint64)
    for x in range(0, len(key), 2000):            # a large group exceeds the block
        o = offs[x:x + 2001]
        total = prefix_hash(data[o[0]:o[-1]])
        _, inv = T.powers(len(total))
        name[x:x + 2000] = (total[o[1:] - o[0]] - total[o[:-1] - o[0]]) * inv[o[:-1] - o[0]]
    name = T.mix64(name + T.mix64((right * 4096 + np.diff(offs)).astype(np.uint64)))
    order = np.lexsort((name, group))
    head = np.ones(len(order), bool)
    head[1:] = (name[order][1:] != name[order][:-1]) | (group[order][1:] != group[order][:-1])
    start = np.flatnonzero(head)
    length = np.diff(np.append(start, len(order)))
    rep = order[start]
    # Equal surroundings: every window of them is repeated.
    equal = np.zeros(len(order), bool)
    equal[order] = np.repeat(length > 1, length)
    owner = ~several                       # others got their answer in the reading task
    settled = np.logical_or.reduceat(several[order], start) | (length > 1)
    members = [np.flatnonzero(equal & owner)]
    los, his = [lo[members[0]]], [hi[members[0]]]
    # Rounds only where a group still has different surroundings.
    kinds = np.bincount(group[rep], minlength=group[-1] + 1)
    go = np.flatnonzero(kinds[group[rep]] > 1)
    if len(go):
        r = rep[go]
        near = span - right[r]          # left of the anchor, nearest window
        far = near + (hi[r] - lo[r])
        texts = [data[offs[i]:offs[i + 1]] for i in r]
        who, d0, d1 = sort_columns(texts, right[r], group[r], near, far, span)
        keep = ~settled[go][who]
        who, d0, d1 = who[keep], d0[keep], d1[keep]
        i = r[who]
        # A window d places left of the anchor starts at hi - (d - near).
        members.append(i)
        los.append(hi[i] - (d1 - near[who]))
        his.append(hi[i] - (d0 - near[who]))
    i, a, b = np.concatenate(members), np.concatenate(los), np.concatenate(his)
    pick = pa.array(i)
    out = [pa.RecordBatch.from_arrays(
        [pa.array(np.ones(len(i), np.int32)), t.column("doc_id").combine_chunks().take(pick),
         t.column("rk").combine_chunks().take(pick), pa.array(a.astype(np.int32)),
         pa.array(b.astype(np.int32)), pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.int64()),
         pa.nulls(len(i), pa.bool_())], schema=schema)]
    # Blocks of a hot anchor: windows that other blocks may hold too.
    ids, rks = t.column("doc_id").combine_chunks(), t.column("rk").combine_chunks()
    for j, u in zip(rep[salt[rep] > 0].tolist(), settled[salt[rep] > 0].tolist()):
        total = prefix_hash(data[offs[j]:offs[j + 1]])
        w = np.arange(len(total) - span)
        h = T.mix64((total[w + span] - total[w]) * T.powers(len(total))[1][w])
        start = lo[j] + np.arange(len(w))
        done = np.full(len(w), u)
        for x, y in zip(a[i == j], b[i == j]):
            done |= (start >= x) & (start <= y)
        out.append(pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(w), 2, np.int32)), pa.array([ids[j].as_py()] * len(w), pa.int64()),
             pa.array([rks[j].as_py()] * len(w), pa.int64()), pa.array(start.astype(np.int32)),
             pa.array(start.astype(np.int32)), pa.array(np.full(len(w), key[j])),
             pa.array(h.view(np.int64)), pa.array(done)], schema=schema))
    return out


def repeated_runs(members: DataFrame, span: int) -> DataFrame:
    """Rows of ``FOUND``: kind 1, runs of repeated windows; kind 2, windows of
    hot blocks by hash."""
    schema = arrow_schema(FOUND)
    keys = ["key", "salt"]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            done = np.flatnonzero(kind == 1)
            if len(done):
                d = batch.take(pa.array(done))
                n = d.num_rows
                yield pa.RecordBatch.from_arrays(
                    [d.column("kind"), d.column("doc_id"), d.column("rk"), d.column("lo"),
                     d.column("hi"), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                     pa.nulls(n, pa.bool_())], schema=schema)
            batch = batch.take(pa.array(np.flatnonzero(kind == 0)))
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("ctx").nbytes
            if size >= BLOCK_BYTES:
                # Whole groups only; the last one may go on.
                t = pa.Table.from_batches(held).combine_chunks()
                k, s = t.column("key").to_numpy(), t.column("salt").to_numpy()
                cut = int(np.flatnonzero((k == k[-1]) & (s == s[-1]))[0])
                if cut:
                    yield from _sorted_block(t.slice(0, cut), schema, span)
                held = t.slice(cut).combine_chunks().to_batches()
                size = sum(x.column("ctx").nbytes for x in held) if cut else 0
        if held:
            yield from _sorted_block(pa.Table.from_batches(held).combine_chunks(), schema, span)

    return (members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, FOUND))


# ------------------------------------------------------------------- removal

def repeated_spans(src: DataFrame, hot_limit: int | None = None, span: int = SPAN) -> DataFrame:
    """``doc_id, rk, lo, hi``: runs of starts of repeated windows by row."""
    size = int(src.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    # Anchors a byte of text grow as the windows shorten.
    buckets = max(16, size * (SPAN - GRAM + 1) // (span - GRAM + 1) // BUCKET_TEXT)
    hot_limit = hot_limit or max(MIN_HOT, size // (span // 2) // HOT_KEYS)
    answers = repeated_anchors(src, buckets, hot_limit, span)
    # At most HOT_KEYS anchors are above the limit.
    hot = {r["doc_id"] & 0xFFFFFFFFFFFFFFFF: r["rk"] for r in answers.filter("kind = 1").collect()}
    rows = answers.filter("kind = 0").select(
        F.col("doc_id").alias("a_id"), F.col("rk").alias("a_rk"), "keys")
    joined = (src.join(rows, (F.col("rk") == F.col("a_rk")) & F.col("doc_id").eqNullSafe(F.col("a_id")))
              .select("doc_id", "rk", "text", "keys"))
    found = staged(repeated_runs(surroundings(joined, buckets, hot, hot_limit, span), span), "runs")
    runs = found.filter("kind = 1").select("doc_id", "rk", "lo", "hi")
    if not hot:
        return runs
    windows = found.filter("kind = 2").drop("kind")
    twice = (windows.groupBy("key", "whash").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    more = (windows.filter("not settled").join(twice, ["key", "whash"])
            .select("doc_id", "rk", "lo", "hi"))
    return runs.union(more)


def _cover(runs, n: int, span: int) -> list[tuple[int, int]]:
    """Bytes under runs of window starts, as maximal spans."""
    out: list[list[int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + span)
        else:
            out.append([lo, hi + span])
    return [(a, min(b, n)) for a, b in out]


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.xxhash64(F.col(id_col), text).alias("rk"), text.alias("text"))


def _collected(spans: DataFrame) -> DataFrame:
    return (spans.groupBy("rk", "doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
            .select(F.col("rk").alias("s_rk"), F.col("doc_id").alias("s_id"), "runs"))


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 hot_limit: int | None = None, span: int = SPAN) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every row.

    A byte is removed if a ``span``-byte string that covers it also starts at
    another place, in the same row or another; strings are judged on the
    input and matches never cross rows.  Null and empty texts have 0 bytes.
    Rows that repeat (same id, same text) are separate texts and repeat each
    other.  Other columns are not read.
    """
    src = _prepared(docs, id_col, text_col)
    spans = _collected(repeated_spans(src, hot_limit, span))
    joined = (src.join(spans, (F.col("rk") == F.col("s_rk")) & F.col("doc_id").eqNullSafe(F.col("s_id")),
                       "left").select("doc_id", "text", "runs"))
    schema = arrow_schema(RESULT)

    def run(batches):
        for rows, data, offs in T.slices(batches, "text"):
            out = []
            for i, runs in enumerate(rows.column(2).to_pylist()):
                text = data[offs[i]:offs[i + 1]]
                cut = _cover([(r["lo"], r["hi"]) for r in runs or ()], len(text), span)
                out.append((len(text), sum(b - a for a, b in cut), len(cut),
                            hashlib.sha256(_kept(text, cut)).hexdigest(),
                            [{"lo": a, "hi": b} for a, b in cut]))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0)] + [pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:])],
                schema=schema)

    return joined.mapInArrow(run, RESULT)


def _kept(text: np.ndarray, cut: list) -> bytes:
    if not cut:
        return text.tobytes()
    edge = [0] + [x for ab in cut for x in ab] + [len(text)]
    return b"".join(text[a:b].tobytes() for a, b in zip(edge[::2], edge[1::2]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length_col: str | None = "n_chars", span: int = SPAN) -> DataFrame:
    """All rows of ``docs`` with the repeated bytes taken out of their text.

    ``span`` is the least length in bytes of a repeated string (33 to 1,023).  A
    removed span is narrowed to whole characters, so texts stay valid UTF-8;
    ``length_col`` is set to the new number of characters where text went.
    Null texts stay null; other columns are unchanged.
    """
    spans = _collected(repeated_spans(_prepared(docs, id_col, text_col), span=span))
    key = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).alias("text"), key.alias("rk"))
    joined = (rows.join(spans, (F.col("rk") == F.col("s_rk")) & F.col("doc_id").eqNullSafe(F.col("s_id")),
                        "left").select("row", "runs"))
    schema, names = docs.schema, docs.columns

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            cols = dict(zip(names, row.flatten()))
            runs = batch.column(1).to_pylist()
            if any(runs):
                text = cols[text_col].to_pylist()
                size = cols[length_col].to_pylist() if length_col in cols else None
                for i, r in enumerate(runs):
                    if not r:
                        continue
                    data = np.frombuffer(text[i].encode(), np.uint8)
                    cut = _whole_characters(data, _cover([(x["lo"], x["hi"]) for x in r], len(data), span))
                    text[i] = _kept(data, cut).decode()
                    if size is not None:
                        size[i] = len(text[i])
                cols[text_col] = pa.array(text, cols[text_col].type)
                if size is not None:
                    cols[length_col] = pa.array(size, cols[length_col].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    return joined.mapInArrow(run, schema)


def _whole_characters(data: np.ndarray, cut: list) -> list[tuple[int, int]]:
    """Spans without the parts of characters at their ends."""
    inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
    out = []
    for a, b in cut:
        while a < b and inside(a):
            a += 1
        while b > a and inside(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return out
