"""Similarity join on word shingles: size-banded tiles with bitmap signatures.

Documents link when ``100 * |x & y| >= 75 * |x | y|`` over their sets of
five-word shingles.  Equal sets are one class from the start.

1. *Shared shingles.*  Tasks send each set's shingle hashes to hash-range
   buckets as packed blobs.  Buckets answer which shingles occur in two
   different sets; all others can be in no intersection.  A shingle that
   meets two sets already inside a task is answered there, and its bucket
   gets one marker, so a very common shingle costs one entry a task.  A set
   with less than 75 % shared shingles links with nothing and is done.
2. *Stars.*  The rest are ordered by a min-hash and read in that order; each
   set is compared exactly with the last few leaders of its min-hash.  This
   joins large groups of near copies with one comparison each.
3. *Tiles.*  What is left to find are links between different groups.  By the
   prefix principle two linked sets share a shingle among the first ones of
   both in any order that all sets follow; common shingles come last in it, so
   that they seldom make tiles.  Prefix shingles that occur in different groups
   make tiles, cut by bands of set size and into blocks of bounded rows.  In a
   tile parity bitmaps bound the overlap from above by bit counts; pairs that
   pass are intersected exactly as sorted arrays.  In some rounds each set tries
   only its most promising partner in one block of the tiles of its least
   hashes, and linked groups merge; a last pass then tries all pairs between
   the groups that remain, so no link between groups is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import textops as T
from touchline.llm.packing import arrow_schema, pack, unpack
from touchline.llm.tables import components, staged

SHINGLE = 5
NUM, DEN = 75, 100
# Words [^\x20\x09-\x0D]+ after lower-casing A-Z.
KEEP = T.class_of([(0x20, 0x20), (0x09, 0x0D)])
TABLE = T.byte_table(KEEP, fold_case=True, seed=13)

FLUSH_TOKENS = 1_000_000      # shingles packed at once in a task
FLUSH_SETS = 60_000           # fits the 16 bits of an entry; the last value marks
MARKER = 0xFFFF
BUCKET_TEXT = 16 << 20        # bytes of text per bucket and per shard
ROUNDS = 1                    # star rounds, each with its own min-hash
LEADERS = 6
BITS = 1024                   # bitmap size
BLOCK = 512                   # rows of a tile's block
MERGES = 4                    # at most so many rounds of the most promising partners
FIRST = 4                     # shingles that these rounds look at
FEW = 20                      # they end once a round links a 20th of the first one's links
BINS = 1 << 20                # of each row of the count sketch
COMMON = 64                   # counts below are one class
LOW48 = np.uint64((1 << 48) - 1)

PACKED = "dest int, blob binary"
SETS = ("kind int, doc_id bigint, cls bigint, n int, tokens binary, "
        + ", ".join(f"k{r} bigint" for r in range(ROUNDS)) + ", rk bigint")


def least_shared(n: np.ndarray) -> np.ndarray:
    """Fewest shared shingles with which a set of ``n`` can link: ceil(0.75 n)."""
    return -(-NUM * n // DEN)


# ------------------------------------------------------------ sets of a slice

def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE):
    """Sorted distinct shingle hashes of every row: (hashes, offsets, class).

    With fewer words the whole sequence is the one shingle; without words the
    set is empty.  The class is a hash of the whole set.
    """
    n_rows = len(offs) - 1
    starts, _, row = T.word_spans(data, offs, KEEP)
    words = T.span_hashes(data, starts, TABLE)
    begin = T.row_starts(row, n_rows)
    count = np.diff(begin)
    h, hrow = T.windows(words, row, k)
    parts, rows = [h], [hrow]
    for c in range(1, k):
        at = np.flatnonzero(count == c)
        if len(at):
            acc = np.full(len(at), c, np.uint64)
            for j in range(c):
                acc = acc * np.uint64(T._MUL) + words[begin[at] + j]
            parts.append(T.mix64(acc + np.uint64(k)))
            rows.append(at)
    h, hrow = np.concatenate(parts), np.concatenate(rows)
    order = np.argsort(hrow, kind="stable")
    h, hrow = h[order], hrow[order]
    edge = T.row_starts(hrow, n_rows)
    for i in range(n_rows):
        h[edge[i]:edge[i + 1]].sort()
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (hrow[1:] != hrow[:-1])
    h, hrow = h[first], hrow[first]
    offs = T.row_starts(hrow, n_rows)
    cls = np.zeros(n_rows, np.uint64)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        cls[full] = np.add.reduceat(T.mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), offs[full])
    return h, offs, T.mix64(cls + np.diff(offs).astype(np.uint64)).view(np.int64)


# ------------------------------------------------------------------- packing

def _rows(dest: list, blobs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(dest, pa.int32()), pa.array(blobs, pa.binary())],
                                      names=["dest", "blob"])


def _to_shards(cls, token, at, buckets: int, shards: int):
    """Answers, packed by the shard of their set."""
    shard = (cls.view(np.uint64) % np.uint64(shards)).astype(np.int64)[at]
    order = np.argsort(shard, kind="stable")
    token, at = token[order], at[order]
    edge = np.searchsorted(shard[order], np.arange(shards + 1))
    dest, blobs = [], []
    for s in np.flatnonzero(np.diff(edge)):
        lo, hi = edge[s], edge[s + 1]
        used, local = np.unique(at[lo:hi], return_inverse=True)
        dest.append(buckets + int(s))
        blobs.append(pack(cls[used], token[lo:hi], local.astype(np.int32)))
    return dest, blobs


def _token_id(bucket, low48: np.ndarray) -> np.ndarray:
    return low48 | (np.asarray(bucket, np.uint64) & np.uint64(0xFFFF)) << np.uint64(48)


class _Packer:
    """Collects distinct sets and packs them by bucket."""

    def __init__(self, buckets: int, shards: int) -> None:
        self.buckets, self.shards = buckets, shards
        self.clear()

    def clear(self) -> None:
        self.held, self.sets, self.cls, self.size, self.tokens = 0, 0, [], [], []

    def add(self, h, offs, cls) -> bool:
        n = np.diff(offs)
        self.cls.append(cls[n > 0])
        self.size.append(n[n > 0])
        self.tokens.append(h)
        self.held += len(h)
        self.sets += int((n > 0).sum())
        return self.held >= FLUSH_TOKENS or self.sets >= FLUSH_SETS // 2

    def flush(self):
        if not self.held:
            return [], []
        cls, n = np.concatenate(self.cls), np.concatenate(self.size)
        tokens = np.concatenate(self.tokens)
        self.clear()
        dest, blobs = [], []
        _, first = np.unique(cls, return_index=True)
        keep = np.zeros(len(cls), bool)
        keep[first] = True
        tokens = tokens[np.repeat(keep, n)]
        cls, n = cls[keep], n[keep].astype(np.int32)
        for lo in range(0, len(cls), FLUSH_SETS):     # one slice may hold very many short texts
            hi = min(len(cls), lo + FLUSH_SETS)
            skip, take = int(n[:lo].sum()), int(n[lo:hi].sum())
            d, b = self._pack_sets(cls[lo:hi], n[lo:hi], tokens[skip:skip + take])
            dest += d
            blobs += b
        return dest, blobs

    def _pack_sets(self, cls, n, tokens):
        at = np.repeat(np.arange(len(cls)), n)
        order = np.argsort(tokens)
        tokens, at = tokens[order], at[order]
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(tokens)))
        bucket = ((tokens >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)
        # Met twice here already: answer now, send one marker.
        known = np.repeat(length > 1, length)
        dest, blobs = _to_shards(cls, _token_id(bucket[known], tokens[known] & LOW48),
                                 at[known], self.buckets, self.shards)
        # Set sizes go to the sets' shards once.
        shard = cls.view(np.uint64) % np.uint64(self.shards)
        for s in np.unique(shard):
            m = shard == s
            dest.append(self.buckets + int(s))
            blobs.append(pack(cls[m], n[m]))
        keep = ~known
        keep[start] = True
        entry = (tokens[keep] & LOW48) << np.uint64(16)
        entry |= np.where(known[keep], MARKER, at[keep]).astype(np.uint64)
        # The bucket is the top of the hash, so entries are in bucket order.
        edge = np.searchsorted(bucket[keep], np.arange(self.buckets + 1).astype(np.uint64))
        for b in np.flatnonzero(np.diff(edge)):
            e = entry[edge[b]:edge[b + 1]]
            idx = (e & np.uint64(MARKER)).astype(np.int64)
            used = np.unique(idx[idx != MARKER])
            slot = np.full(MARKER + 1, MARKER, np.int64)
            slot[used] = np.arange(len(used))
            e = np.sort(e >> np.uint64(16) << np.uint64(16) | slot[idx].astype(np.uint64))
            dest.append(int(b))
            blobs.append(pack(cls[used], e))
        return dest, blobs


def _answer(bucket: int, table: pa.Table, buckets: int, shards: int):
    """Postings of the bucket's shared shingles, packed by shard."""
    cls, entries, at, base = [], [], [], 0
    for blob in table.column("blob"):
        c, e = unpack(blob.as_py(), np.int64, np.uint64)
        idx = (e & np.uint64(MARKER)).astype(np.int64)
        at.append(np.where(idx == MARKER, -1, idx + base))
        entries.append(e >> np.uint64(16))
        cls.append(c)
        base += len(c)
    cls, token, at = (np.concatenate(x) for x in (cls, entries, at))
    del entries
    order = np.argsort(token)
    token, at = token[order], at[order]
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(token)))
    if not (length > 1).any():
        return [], []
    several = np.repeat(length > 1, length)
    token, at, length = token[several], at[several], length[length > 1]
    start = np.concatenate(([0], np.cumsum(length)[:-1]))
    marked = at < 0
    owner = cls[np.maximum(at, 0)] if len(cls) else np.zeros(len(at), np.int64)
    low = np.minimum.reduceat(np.where(marked, np.iinfo(np.int64).max, owner), start)
    high = np.maximum.reduceat(np.where(marked, np.iinfo(np.int64).min, owner), start)
    shared = np.repeat((low < high) | np.logical_or.reduceat(marked, start), length) & ~marked
    return _to_shards(cls, _token_id(bucket, token[shared]), at[shared], buckets, shards)


def _min_hashes(tokens: np.ndarray) -> list[int]:
    return [int(T.mix64(tokens ^ np.uint64(0x1234567 * (r + 1))).min().view(np.int64))
            for r in range(ROUNDS)]


def _gather(table: pa.Table, schema: pa.Schema):
    """Suspect sets of a shard and the documents that are keyed here."""
    cls, token, at, base, docs, sizes = [], [], [], 0, [], []
    for blob in table.column("blob"):
        raw = blob.as_py()
        kind = np.frombuffer(raw, np.int32, 1)[0]
        if kind == 2:                                      # set sizes
            sizes.append(unpack(raw, np.int64, np.int32))
            continue
        if kind == 5:                                      # documents
            docs.append(unpack(raw, np.int64, np.int64, np.int32, np.int8, np.int64))
            continue
        c, t, i = unpack(raw, np.int64, np.uint64, np.int32)
        cls.append(c)
        token.append(t)
        at.append(i + base)
        base += len(c)
    for ids, c, m, null, rk in docs:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(c), np.int32)), pa.array(ids, mask=null.astype(bool)),
             pa.array(c), pa.array(m)] + [pa.nulls(len(c), f.type) for f in list(schema)[4:-1]]
            + [pa.array(rk)],
            schema=schema)
    if not base:
        return
    cls, token, at = (np.concatenate(x) for x in (cls, token, at))
    uniq, back = np.unique(cls, return_inverse=True)
    known, first = np.unique(np.concatenate([c for c, _ in sizes]), return_index=True)
    n = np.concatenate([m for _, m in sizes])[first[np.searchsorted(known, uniq)]]
    at = back[at]
    order = np.lexsort((token, at))
    token, at = token[order], at[order]
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (at[1:] != at[:-1])
    token, at = token[keep], at[keep]
    edge = T.row_starts(at, len(uniq))
    rows = [i for i in np.flatnonzero(np.diff(edge) >= least_shared(n.astype(np.int64)))]
    for lo in range(0, len(rows), 1000):
        part = rows[lo:lo + 1000]
        sets = [token[edge[i]:edge[i + 1]] for i in part]
        keys = [_min_hashes(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(part), np.int32)), pa.nulls(len(part), pa.int64()),
             pa.array(uniq[part]), pa.array(n[part]), pa.array([s.tobytes() for s in sets], pa.binary())]
            + [pa.array([k[r] for k in keys], pa.int64()) for r in range(ROUNDS)]
            + [pa.nulls(len(part), pa.int64())], schema=schema)


def row_key(id_col: str, text_col: str):
    """Tells rows apart by id and text; rows that repeat share it."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def suspect_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Staged table (``SETS``): kind 0, every row of ``docs`` with its class
    and set size; kind 1, every class of which 75 % of the shingles also
    occur in another class, with those shingles."""
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
                      row_key(id_col, text_col).alias("rk"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = shards = max(48, int(size) // BUCKET_TEXT)
    schema = arrow_schema(SETS)

    def read(batches):
        packer = _Packer(buckets, shards)
        for rows, data, offs in T.slices(batches, "text"):
            h, edge, cls = shingle_sets(data, offs)
            ids = rows.column(0)
            null = np.array(ids.is_null())
            rk = rows.column(2).to_numpy()
            ids = ids.fill_null(0).to_numpy()
            n = np.diff(edge).astype(np.int32)
            to = (T.mix64(ids.view(np.uint64) + cls.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
            dest, blobs = [], []
            for s in np.unique(to):
                m = to == s
                dest.append(buckets + int(s))
                blobs.append(pack(ids[m], cls[m], n[m], null[m].astype(np.int8),
                                  rk[m]))
            yield _rows(dest, blobs)
            if packer.add(h, edge, cls):
                yield _rows(*packer.flush())
        yield _rows(*packer.flush())

    def answer(key, table):
        if key[0].as_py() < buckets:
            dest, blobs = _answer(key[0].as_py(), table, buckets, shards)
            return pa.Table.from_batches([_rows(dest, blobs)])
        return table

    def gather(key, table):
        return pa.Table.from_batches(list(_gather(table, schema)), schema=schema)

    packed = src.mapInArrow(read, PACKED)
    answers = packed.groupBy("dest").applyInArrow(answer, PACKED)
    return staged(answers.groupBy("dest").applyInArrow(gather, SETS), "sets")


# --------------------------------------------------------------------- stars

def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _linked(shared: int, n: int, m: int) -> bool:
    return DEN * shared >= NUM * (n + m - shared)


STAR = "cls bigint, n int, tokens binary, " + ", ".join(
    f"k{r} bigint" for r in range(ROUNDS)) + ", parent bigint"


def star_round(roots: DataFrame, r: int) -> DataFrame:
    """Compare each set with the last leaders of its min-hash.  Rows are dealt
    by range of (min-hash, size, class), so one min-hash may span tasks."""
    schema = arrow_schema(STAR)
    key = f"k{r}"

    def run(batches):
        current, leaders = None, []
        for batch in batches:
            out = []
            cols = batch.to_pydict()
            for i in range(batch.num_rows):
                if cols[key][i] != current:
                    current, leaders = cols[key][i], []
                cls, n = cols["cls"][i], cols["n"][i]
                tokens = np.frombuffer(cols["tokens"][i], np.uint64)
                parent = None
                for p, m, other in leaders:
                    if DEN * min(n, m) >= NUM * max(n, m) and _linked(_overlap(tokens, other), n, m):
                        parent = p
                        break
                if parent is None:
                    leaders = [(cls, n, tokens)] + leaders[:LEADERS - 1]
                out.append(parent)
            keep = pa.array([p is None for p in out])
            tokens = pc.if_else(keep, batch.column(batch.schema.get_field_index("tokens")),
                                        pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("cls"), batch.column("n"), tokens]
                + [batch.column(f"k{j}") for j in range(ROUNDS)] + [pa.array(out, pa.int64())],
                schema=schema)

    cols = ["cls", "n", "tokens", *(f"k{j}" for j in range(ROUNDS))]
    return staged(roots.select(*cols).repartitionByRange(key, "n", "cls")
                  .sortWithinPartitions(key, "n", "cls").mapInArrow(run, STAR), f"star{r}")


# --------------------------------------------------------------------- tiles

PREFIX = "cls bigint, n int, v int, prefix array<bigint>, first array<bigint>, bits binary"


def _bins(tokens: np.ndarray) -> np.ndarray:
    """Places of the tokens in the two rows of the count sketch."""
    mask = np.uint64(BINS - 1)
    return np.stack([T.mix64(tokens ^ np.uint64(0x9E37 * (r + 1))) & mask for r in range(2)]).astype(np.int64)


def frequency_classes(roots: DataFrame) -> np.ndarray:
    """Binary logarithm of the bins of a count sketch over the shingles of
    ``roots``; 0 below ``COMMON``.  The sketch has a fixed size: at most
    ``2 * BINS`` counts reach the driver, one byte each goes to the tasks."""
    def run(batches):
        seen = np.zeros((2, BINS), np.int64)
        for batch in batches:
            tokens = np.frombuffer(b"".join(x.as_py() for x in batch.column(0)), np.uint64)
            for r, at in enumerate(_bins(tokens)):
                seen[r] += np.bincount(at, minlength=BINS)
        seen = seen.ravel()
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["bin", "c"])

    counts = (roots.select("tokens").mapInArrow(run, "bin int, c bigint")
              .groupBy("bin").agg(F.sum("c").alias("c")).filter(F.col("c") >= COMMON).toArrow())
    classes = np.zeros(2 * BINS, np.uint8)
    c = counts.column("c").to_numpy()
    classes[counts.column("bin").to_numpy()] = np.log2(np.maximum(c, 1)).astype(np.uint8)
    return classes.reshape(2, BINS)


def _rarest_first(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Sorted tokens in the order *frequency class, hash*: a function of the
    token alone, so all sets follow the same order."""
    rows = _bins(tokens)
    cls = np.minimum(classes[0, rows[0]], classes[1, rows[1]])
    return tokens[np.argsort(cls, kind="stable")] if cls.any() else tokens


def prefixes(sets: DataFrame, classes: np.ndarray) -> DataFrame:
    """Prefix shingles, least hashes and parity bitmap of each set.

    In the order *shingles of one class only, then rarest first* the first
    ``n - ceil(0.75 n) + 1`` shingles are the prefix; of these the shared ones
    are kept.  The bitmap toggles a bit per shared shingle, so bits that
    differ are at most the shingles that differ.
    """
    schema = arrow_schema(PREFIX)

    def run(batches):
        for batch in batches:
            n = batch.column("n").to_numpy()
            v, prefix, firsts, bits = [], [], [], []
            for size, raw in zip(n.tolist(), batch.column("tokens")):
                t = np.frombuffer(raw.as_py(), np.uint64)
                v.append(len(t))
                prefix.append(_rarest_first(t, classes)[:len(t) - -(-NUM * size // DEN) + 1].view(np.int64))
                firsts.append(t[:FIRST].view(np.int64))
                odd = np.bincount((T.mix64(t) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("cls"), batch.column("n"), pa.array(v, pa.int32()),
                 pa.array(prefix, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int64())),
                 pa.array(bits, pa.binary())], schema=schema)

    return sets.select("cls", "n", "tokens").mapInArrow(run, PREFIX)


def _tiles(pre: DataFrame, roots: DataFrame, merge: int | None = None) -> DataFrame:
    """Rows of all tiles whose shingle occurs in different groups.

    In a merging round (number ``merge``) a tile's blocks, dealt anew each
    round, are on their own; otherwise every two blocks meet.
    """
    # Sets visit the next band of sizes too; bands are a factor 4/3 wide.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)) + 1e-9).cast("int")
    own = (pre.join(roots, "cls", "left")
           .withColumn("grp", F.coalesce("root", "cls")).withColumn("own", band))
    postings = (own.select("cls", "grp", "own", F.explode("prefix" if merge is None else "first").alias("token"))
                .withColumn("band", F.explode(F.array("own", F.col("own") + 1))))
    sizes = (postings.groupBy("token", "band")
             .agg(F.count("*").alias("m"), F.min("grp").alias("lo"), F.max("grp").alias("hi"))
             .filter("lo < hi").select("token", "band", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    rows = (postings.join(sizes, ["token", "band"])
            .join(pre.select("cls", "n", "v", "bits"), "cls"))
    block = F.pmod(F.xxhash64(F.lit(merge), "cls"), F.col("blocks")).cast("int")
    other = (F.col("block") if merge is not None
             else F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return (rows.withColumn("block", block).withColumn("other", other)
            .withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
            .select("token", "band", "bi", "bj", "block", "own", "cls", "grp", "n", "v", "bits"))


PAIR = "x bigint, y bigint, gx bigint, gy bigint, score int"


def _tile_pairs(t: dict, lo: int, hi: int, best: bool):
    """Pairs of one tile that bit counts cannot exclude: places and score; with
    ``best`` only the most promising partner of every row."""
    band, bi, bj = t["band"][lo], t["bi"][lo], t["bj"][lo]
    own, block = t["own"][lo:hi], t["block"][lo:hi]
    mine = own == band
    pairs = [(np.flatnonzero(block == bi), np.flatnonzero((block == bj) & mine))]
    if bi != bj:      # visitors of either block meet the other block's own rows
        pairs.append((np.flatnonzero((block == bj) & ~mine), np.flatnonzero((block == bi) & mine)))
    n, v = t["n"][lo:hi].astype(np.int64), t["v"][lo:hi].astype(np.int64)
    cls, grp, bits = t["cls"][lo:hi], t["grp"][lo:hi], t["bits"][lo:hi]
    xs, ys, scores = [], [], []
    for a, b in pairs:
        for i in a:
            j = b[(grp[b] != grp[i]) & (DEN * np.minimum(n[b], n[i]) >= NUM * np.maximum(n[b], n[i]))]
            if bi == bj and mine[i]:
                j = j[cls[j] > cls[i]]
            if not len(j):
                continue
            differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
            # Twice the most that they can share.
            twice = v[i] + v[j] - differ
            ok = (DEN + NUM) * twice >= 2 * NUM * (n[i] + n[j])
            j, twice = j[ok], twice[ok]
            xs.append(np.full(len(j), i))
            ys.append(j)
            scores.append(twice * 1_000_000 // (n[i] + n[j]))
    if not xs:
        return None
    x, y, score = (np.concatenate(c) for c in (xs, ys, scores))
    if best and len(x):
        x, y, score = np.concatenate((x, y)), np.concatenate((y, x)), np.concatenate((score, score))
        order = np.lexsort((cls[y], -score, x))
        order = order[np.concatenate(([True], x[order][1:] != x[order][:-1]))]
        x, y, score = x[order], y[order], score[order]
    return x + lo, y + lo, score


def candidate_pairs(tiles: DataFrame, best: bool) -> DataFrame:
    """Distinct pairs ``x < y`` of all tiles; with ``best``, one for each ``x``."""
    schema = arrow_schema(PAIR)
    keys = ["token", "band", "bi", "bj"]

    def emit(batch, edges: np.ndarray):
        t = {c: batch.column(c).to_numpy() for c in batch.schema.names if c != "bits"}
        t["bits"] = np.frombuffer(b"".join(x.as_py() for x in batch.column("bits")),
                                  np.uint64).reshape(-1, BITS // 64)
        found = [p for lo, hi in zip(edges[:-1], edges[1:])
                 if hi - lo > 1 and (p := _tile_pairs(t, lo, hi, best)) is not None]
        if not found:
            return
        x, y, score = (np.concatenate([f[i] for f in found]) for i in range(3))
        if best:      # one partner for each set of the batch
            order = np.lexsort((t["cls"][y], -score, t["cls"][x]))
            c = t["cls"][x[order]]
            keep = order[np.concatenate(([True], c[1:] != c[:-1]))] if len(order) else order
        else:
            swap = t["cls"][x] > t["cls"][y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            both = np.stack((t["cls"][x], t["cls"][y]), axis=1)
            keep = np.unique(both, axis=0, return_index=True)[1]
        x, y, score = x[keep], y[keep], score[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(t["cls"][x]), pa.array(t["cls"][y]), pa.array(t["grp"][x]),
             pa.array(t["grp"][y]), pa.array(score.astype(np.int32))], schema=schema)

    def run(batches):
        rest = None
        for batch in batches:
            if rest is not None and rest.num_rows:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.logical_or.reduce(
                [(c := batch.column(k).to_numpy())[1:] != c[:-1] for k in keys])
            edges = np.flatnonzero(new)         # the last tile may go on in the next batch
            yield from emit(batch, edges)
            rest = batch.slice(edges[-1])
        if rest is not None and rest.num_rows:
            yield from emit(rest, np.array([0, rest.num_rows]))

    pairs = tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, PAIR)
    if best:
        return (pairs.groupBy("x").agg(F.max(F.struct("score", "y", "gx", "gy")).alias("p"))
                .select("x", "p.y", "p.gx", "p.gy"))
    return pairs.select("x", "y", "gx", "gy").dropDuplicates(["x", "y"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose exact intersection links them."""
    side = lambda c: sets.select(
        F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}"))

    def run(batches):
        for batch in batches:
            keep = [
                _linked(_overlap(np.frombuffer(a.as_py(), np.uint64),
                                 np.frombuffer(b.as_py(), np.uint64)), n.as_py(), m.as_py())
                for a, b, n, m in zip(batch.column("tx"), batch.column("ty"),
                                      batch.column("nx"), batch.column("ny"))]
            yield batch.select(["x", "y", "gx", "gy"]).filter(pa.array(keep, pa.bool_()))

    return (pairs.join(side("x"), "x").join(side("y"), "y")
            .select("x", "y", "gx", "gy", "nx", "ny", "tx", "ty")
            .mapInArrow(run, "x bigint, y bigint, gx bigint, gy bigint"))


# ---------------------------------------------------------------------- join

def similarity_classes(sets: DataFrame) -> DataFrame:
    """``cls, root`` of every class that links with another one."""
    found = sets.filter("kind = 1")
    roots, forest = found, None
    for r in range(ROUNDS):
        done = star_round(roots, r)
        edges = done.filter("parent is not null").select(F.col("cls"), F.col("parent").alias("root"))
        if forest is None:
            forest = edges
        else:
            up = edges.select(F.col("cls").alias("root"), F.col("root").alias("up"))
            forest = (forest.join(up, "root", "left").select("cls", F.coalesce("up", "root").alias("root"))
                      .union(edges))
        roots = done.filter("parent is null").drop("parent")
    forest = staged(forest, "forest")
    pre = staged(prefixes(found, frequency_classes(roots)), "prefixes")
    rows = pre.count()
    todo, most = [*range(MERGES), None], 0
    while todo:
        merge = todo.pop(0)
        pairs = candidate_pairs(_tiles(pre, forest, merge), best=merge is not None)
        links = staged(verify(pairs, found), "links")
        made = links.count()
        most = max(most, made)
        if made * FEW <= most:
            todo = todo[-1:]          # merging is done: all pairs next, then the end
        if not made:
            continue
        joined = components(links.select(F.col("gx").alias("a"), F.col("gy").alias("b")))
        joined = joined.select(F.col("node"), F.col("root").alias("top"))
        forest = staged(
            forest.join(joined, forest["root"] == joined["node"], "left")
            .select("cls", F.coalesce("top", "root").alias("root"))
            .union(joined.join(forest.select(F.col("cls").alias("node")), "node", "left_anti")
                   .select(F.col("node").alias("cls"), F.col("top").alias("root"))), "forest", rows)
    return forest


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id, row_key, stays`` for every row.

    ``component_id`` is the smallest document id reachable by links, itself
    included; ``stays`` marks the row of that id (of repeated ids one text)
    with which the component would be kept; ``class_id`` names the set of shingles (equal sets share it).
    Null and empty texts and texts without words have an empty set and link
    with nothing.  Repeated rows stay repeated; a null id never becomes a
    component id, so a null-id row alone has a null component.  Other columns
    are not read.
    """
    sets = suspect_sets(docs, id_col, text_col)
    roots = similarity_classes(sets)
    rows = (sets.filter("kind = 0").select("doc_id", "n", "cls", "rk").join(roots, "cls", "left")
            .withColumn("grp", F.coalesce("root", "cls")))
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"),
                    F.col("rk").alias("rk"))
    least = rows.filter("n > 0").groupBy("grp").agg(F.min(name).alias("first"))
    return (rows.join(least, "grp", "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.col("cls").alias("class_id"), F.col("rk").alias("row_key"),
        ((F.col("n") == 0) | (F.col("rk") == F.col("first.rk"))).alias("stays")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns unchanged; rows without words
    all stay.  Rows that repeat (same id, same text) count as one, but of
    rows without words only those that have an id."""
    keys = (jaccard_components(docs, id_col, text_col).filter("stays and n_shingles > 0")
            .select(F.col("row_key").alias("k")).distinct())
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.filter(worded).select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("rk"))
    blank, named = docs.filter(~worded), F.col(id_col).isNotNull()
    return (rows.join(keys, rows["rk"] == keys["k"], "left_semi")
            .dropDuplicates(["rk"]).select("row.*")
            .union(blank.filter(~named))
            .union(blank.filter(named).dropDuplicates([id_col, text_col])))
