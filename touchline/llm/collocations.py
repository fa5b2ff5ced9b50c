"""Phrase collocations counted by tries of Apriori-safe candidates.

Level by level, a pass over the texts each:

1. A phrase is proposed at each word (level one), or where its two phrases one
   word shorter may be frequent.  What may be frequent is a bitmap of bounded
   size over phrase hashes, so it never misses one.
2. A task merges equal proposals, a wave of bounded size at a time, and deals
   them by ranges of their hash to parts; their number follows the text bytes.
   A phrase costs a part one row a wave at most, so a common one fills no task.
3. In a part proposals are summed by hash; a hash met by two phrases only adds,
   so those under ``min_count`` are safely dropped.  The rest are the candidates.
4. A part's candidates are cut into double-array tries over bytes of bounded
   size.  A trie meets only the proposals of its own hashes: a state each, all
   advanced a byte at a time through check and base, the accepting ones
   bincounted with their proposals' counts.  What is frequent feeds the next
   level's bitmap.
5. Scores are exact: products are DECIMAL(38,0), their quotient is integral.

Texts are read ``max_words`` times and once for their size, however many
candidates there are.  Merging tells words apart by a 64-bit hash with their
language, phrases by two hashes of these; tries compare bytes.

Nulls: a text counts as empty, a language as ``und``.  Repeated rows all count.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.packing import arrow_schema, pack, unpack
from touchline.llm.tables import staged
from touchline.llm.textops import byte_table, class_of, mix64, release, slices, span_hashes, word_spans

U64 = np.uint64
MAP_BITS = 25, 27              # bitmap of phrases that may be frequent: 4 MB to 16 MB
PART_BYTES = 12 << 20          # text bytes whose proposals one part takes
TRIE_BYTES = 2 << 20           # candidate bytes of one trie
WAVE_BYTES = 24 << 20          # proposals that a task holds at once
SPAN_ROWS = 65536              # texts gathered at once

DEALT = "part int, lang string, n bigint, blob binary"
COUNTED = "lang string, phrase string, h bigint, n bigint"

WORD = class_of([(0x09, 0x0D), (0x20, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F)])
BREAK = ~class_of([(0x0A, 0x0D), (0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F)])
TABLE = byte_table(WORD, fold_case=True, seed=13)
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[0x41:0x5B] += 32
SPACE, STOP = 0x20, 0x0A
_STEP = U64(0xD6E8FEB86659FD93)
_OTHER = U64(0x9E3779B97F4A7C15)


# --- words of a slice --------------------------------------------------------

class Words:
    """Words of a slice: places, hash (of language and word), whether the next
    word follows in the same piece."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray):
        lang = rows.column(0).dictionary_encode()
        self.langs = lang.dictionary.to_pylist()
        seed = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
                         for x in self.langs], U64)
        self.data = FOLDED[data]
        self.starts, self.ends, row = word_spans(data, offs, WORD)
        self.lang = lang.indices.to_numpy().astype(np.int64)[row]
        self.hash = mix64(span_hashes(data, self.starts, TABLE) ^ seed[self.lang]) if len(row) else np.zeros(0, U64)
        piece = np.cumsum(BREAK[data])[self.starts] if len(row) else row
        self.joined = np.zeros(len(row), bool)
        self.joined[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """Words with one separator after each (a space if the next word is
        joined, else a stop), and where each begins, the end of all included."""
        lens = self.ends - self.starts + 1
        offs = np.concatenate([[0], np.cumsum(lens)])
        at = np.arange(offs[-1]) + np.repeat(self.starts - offs[:-1], lens)
        out = self.data[np.minimum(at, len(self.data) - 1)]
        out[offs[1:] - 1] = np.where(self.joined, SPACE, STOP)
        return out, offs


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("string").alias("text"))


def _spans(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Bytes of the spans, one after the other."""
    out = []
    for lo in range(0, len(starts), SPAN_ROWS):
        n = lens[lo:lo + SPAN_ROWS].astype(np.int64)
        ends = np.cumsum(n)
        out.append(data[np.arange(ends[-1]) + np.repeat(starts[lo:lo + SPAN_ROWS] - (ends - n), n)])
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


# --- proposals ---------------------------------------------------------------

def bitmap(hashes: DataFrame, col: str) -> np.ndarray:
    """Bits of the hashes' leading bits: 16 a hash, within ``MAP_BITS``."""
    least, most = MAP_BITS
    bits = min(most, max(least, (16 * hashes.count()).bit_length()))
    at = hashes.select(F.shiftrightunsigned(F.col(col), 64 - bits).alias("x"))
    got = (at.groupBy(F.shiftright("x", 6).alias("w"))
           .agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("bits")).toArrow())
    out = np.zeros(1 << (bits - 6), U64)
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy().view(U64)
    return out


def _may(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> U64(64 - (64 * len(bits) - 1).bit_length())
    return (bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) != 0


def phrase_starts(w: Words, maps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the phrase of len(maps) + 1 words at each word, and where both
    of its phrases one word shorter may be frequent."""
    if not maps or not len(w.hash):
        return w.hash, np.ones(len(w.hash), bool)
    key, alive = w.hash, _may(maps[0], w.hash)
    for k in range(1, len(maps) + 1):
        nxt = np.zeros(len(key), bool)
        nxt[:-1] = alive[:-1] & alive[1:]
        if k == 1:
            nxt &= w.joined
        last = np.zeros(len(key), U64)
        last[:len(key) - k] = w.hash[k:]
        key = mix64(key * _STEP + last)
        alive = nxt & _may(maps[k], key) if k < len(maps) else nxt
    return key, alive


def _merge(g: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of each pair of hashes in the order of ``g``, and its count; a
    pair may come twice where phrases share ``g``."""
    order = np.argsort(g)
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[order[1:]] != g[order[:-1]]) | (other[order[1:]] != other[order[:-1]])
    first = np.flatnonzero(fresh)
    return order[first], np.add.reduceat(n[order], first)


class Wave:
    """Proposals of a task until they are dealt."""

    def __init__(self):
        self.rows, self.data, self.held, self.size, self.words = [], [], 0, 0, {}

    def add(self, w: Words, key: np.ndarray, alive: np.ndarray, k: int) -> None:
        if k == 1:
            for x, n in zip(w.langs, np.bincount(w.lang, minlength=len(w.langs)).tolist()):
                self.words[x] = self.words.get(x, 0) + n
                self.held += len(x) + 16
        at = np.flatnonzero(alive)
        if not len(at):
            return
        other = np.zeros(len(at), U64)
        for i in range(k):
            other = other * _OTHER + w.hash[at + i]
        keep, n = _merge(key[at], other, np.ones(len(at), np.int64))
        at, other = at[keep], other[keep]
        stream, offs = w.stream()
        head = [f"{x}\n".encode() for x in w.langs]
        head_n = np.array([len(x) for x in head])
        head_at = self.size + len(stream) + np.cumsum(head_n) - head_n
        lang = w.lang[at]
        rows = (key[at], other, n, self.size + offs[at], offs[at + k] - 1 - offs[at], head_at[lang], head_n[lang])
        self.rows.append(rows)
        self.data += [stream, np.frombuffer(b"".join(head), np.uint8)]
        self.size += len(stream) + int(head_n.sum())
        self.held += sum(x.nbytes for x in rows) + len(stream)

    def dealt(self, parts: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The proposals by part, their texts led by language and line break;
        words of each language in parts below zero."""
        if self.rows:
            g, other, n, *text = (np.concatenate(x) for x in zip(*self.rows))
            keep, n = _merge(g, other, n)
            g = g[keep]
            start, size, head_at, head_n = (x[keep] for x in text)
            data = np.concatenate(self.data)
            self.rows, self.data = [], []
            edges = np.searchsorted(((g >> U64(32)) * U64(parts)) >> U64(32), np.arange(parts + 1, dtype=U64))
            found = np.flatnonzero(edges[1:] > edges[:-1])
            blobs = []
            for lo, hi in zip(edges[found].tolist(), edges[found + 1].tolist()):
                both = np.stack([head_at[lo:hi], start[lo:hi]], 1).reshape(-1)
                lens = np.stack([head_n[lo:hi], size[lo:hi]], 1).reshape(-1)
                blobs.append(pack(g[lo:hi], n[lo:hi], (head_n[lo:hi] + size[lo:hi]).astype(np.int32),
                                  _spans(data, both, lens)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int32()), pa.nulls(len(found), pa.string()), pa.nulls(len(found), pa.int64()),
                 pa.array(blobs, schema.field("blob").type)], schema=schema)
        if self.words:
            langs = list(self.words)
            part = [-1 - int.from_bytes(hashlib.blake2b(x.encode(), digest_size=4).digest(), "little") % parts
                    for x in langs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(langs, pa.string()), pa.array(list(self.words.values()), pa.int64()),
                 pa.nulls(len(langs), schema.field("blob").type)], schema=schema)
        self.__init__()


def proposals(docs: DataFrame, maps: list[np.ndarray], parts: int, wave_bytes: int) -> DataFrame:
    """Phrases of len(maps) + 1 words that may be frequent (``DEALT``)."""
    k = len(maps) + 1
    schema = arrow_schema(DEALT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave = Wave()
        for rows, data, offs in slices(batches, "text"):
            w = Words(rows, data, offs)
            wave.add(w, *phrase_starts(w, maps), k)
            if wave.held > wave_bytes:
                yield from wave.dealt(parts, schema)
        yield from wave.dealt(parts, schema)

    return _docs(docs).mapInArrow(run, DEALT)


# --- double-array tries ------------------------------------------------------

def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base, check, accept`` of a trie over sorted distinct keys.  From state
    s a byte c leads to base[s] + c if check there is s; accept is a key's place
    or -1.  The root is state 0."""
    lens = np.array([len(k) for k in keys], np.int64)
    data = np.frombuffer(b"".join(keys), np.uint8)
    offs = np.concatenate([[0], np.cumsum(lens)])[:-1]
    node = np.zeros(len(keys), np.int64)          # node of each key's prefix
    parents, symbols, n_nodes = [], [], 1
    alive = np.arange(len(keys))
    final = np.zeros(len(keys), np.int64)
    depth = 0
    while len(alive):
        alive = alive[lens[alive] > depth]
        if not len(alive):
            break
        c = data[offs[alive] + depth]
        fresh = np.ones(len(alive), bool)
        # Keys are sorted: a node's keys stand together among those alive.
        fresh[1:] = ~((node[alive[1:]] == node[alive[:-1]]) & (c[1:] == c[:-1]))
        number = n_nodes + np.cumsum(fresh) - 1
        parents.append(node[alive[fresh]])
        symbols.append(c[fresh])
        node[alive] = number
        n_nodes += int(fresh.sum())
        final[alive] = number
        depth += 1
    parent = np.concatenate(parents) if parents else np.zeros(0, np.int64)
    symbol = np.concatenate(symbols).astype(np.int64) if symbols else np.zeros(0, np.int64)
    return _place(parent, symbol, n_nodes, final)


def _place(parent: np.ndarray, symbol: np.ndarray, n_nodes: int, final: np.ndarray):
    """Slots for all nodes: states with most children first, at random places
    that no other state has; those with one child fill the free slots."""
    order = np.argsort(parent, kind="stable")
    parent, symbol, child = parent[order], symbol[order], order + 1
    states, first, n_children = np.unique(parent, return_index=True, return_counts=True)
    base_of = np.zeros(n_nodes, np.int64)
    slot = np.zeros(n_nodes, np.int64)
    size = n_nodes + n_nodes // 8 + 1024
    taken = np.zeros(size + 512, bool)
    taken[0] = True
    rng = np.random.default_rng(1)
    top = int(n_children.max(initial=0))
    width = 1 << max(0, top - 1).bit_length()
    while width > 1:
        todo = np.flatnonzero((n_children > width // 2) & (n_children <= width))
        tries = 0
        while len(todo):
            at = rng.integers(1, size, len(todo))
            rep = np.repeat(np.arange(len(todo)), n_children[todo])
            edge = np.arange(len(rep)) - np.repeat(np.cumsum(n_children[todo]) - n_children[todo], n_children[todo])
            edge = np.repeat(first[todo], n_children[todo]) + edge
            want = at[rep] + symbol[edge]
            _, one, back, many = np.unique(want, return_index=True, return_inverse=True, return_counts=True)
            # Of proposals that meet, the earliest stays.
            clash = taken[want] | ((many[back] > 1) & (one[back] != np.arange(len(want))))
            bad = np.zeros(len(todo), bool)
            bad[rep[clash]] = True
            good = ~bad[rep]
            taken[want[good]] = True
            slot[child[edge[good]]] = want[good]
            base_of[states[todo[~bad]]] = at[~bad]
            todo = todo[bad]
            tries += 1
            if tries % 16 == 0:
                size = size + size // 2
                taken = np.concatenate([taken, np.zeros(size + 512 - len(taken), bool)])
        width //= 2
    lone = np.flatnonzero(n_children == 1)
    edge = first[lone]
    free = np.flatnonzero(~taken[256:]) + 256
    if len(free) < len(lone):
        extra = len(lone) - len(free)
        taken = np.concatenate([taken, np.zeros(extra, bool)])
        free = np.concatenate([free, np.arange(len(taken) - extra, len(taken))])
    free = free[:len(lone)]
    slot[child[edge]] = free
    base_of[states[lone]] = free - symbol[edge]
    total = int(slot.max(initial=0)) + 1
    total = max(total, int(base_of.max(initial=0)) + 257)
    base, check = np.zeros(total, np.int32), np.full(total, -1, np.int32)
    accept = np.full(total, -1, np.int32)
    base[slot] = base_of
    check[slot[child]] = slot[parent]
    accept[slot[final]] = np.arange(len(final))
    accept[0] = -1
    return base, check, accept


class Trie:
    def __init__(self, keys: list[bytes]):
        self.base, self.check, self.accept = double_array(keys)

    def find(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Place of the key that each span is, or -1, for all spans at once."""
        place = np.full(len(starts), -1, np.int32)
        rows, state, depth = np.arange(len(starts)), np.zeros(len(starts), np.int32), 0
        while len(rows):
            to = self.base[state] + data[starts[rows] + depth]
            live = self.check[to] == state
            depth += 1
            done = live & (lens[rows] == depth)
            place[rows[done]] = self.accept[to[done]]
            live &= ~done
            rows, state = rows[live], to[live]
        return place


def part_counts(blobs: Iterable[bytes], min_count: int, trie_bytes: int,
                schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``COUNTED`` of one part's candidates that occur ``min_count`` times, a
    trie at a time."""
    g, n, lens, data = (np.concatenate(x) for x in zip(*(unpack(x, U64, np.int64, np.int32, np.uint8) for x in blobs)))
    order = np.argsort(g)
    first = np.flatnonzero(np.concatenate([[True], g[order[1:]] != g[order[:-1]]]))
    n_rows = np.diff(np.append(first, len(g)))
    safe = np.add.reduceat(n[order], first) >= min_count
    order, n_rows = order[np.repeat(safe, n_rows)], n_rows[safe]
    if not len(order):
        return
    offs = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
    g, n, starts, lens = g[order], n[order], offs[order], lens[order]
    edges = np.concatenate([[0], np.cumsum(n_rows)])             # rows of each candidate
    size = np.concatenate([[0], np.cumsum(lens[edges[:-1]], dtype=np.int64)])
    lo = 0
    while lo < len(n_rows):
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + trie_bytes, side="right")) - 1)
        a, b = edges[lo], edges[hi]

        def texts(rows: np.ndarray) -> set[bytes]:
            return {data[i:i + m].tobytes() for i, m in zip(starts[rows].tolist(), lens[rows].tolist())}

        keys = sorted(texts(edges[lo:hi]))
        place = Trie(keys).find(data, starts[a:b], lens[a:b])
        lost = a + np.flatnonzero(place < 0)
        if len(lost):                                            # phrases that share a hash
            keys = sorted(set(keys) | texts(lost))
            place = Trie(keys).find(data, starts[a:b], lens[a:b])
        total = np.bincount(place, weights=n[a:b], minlength=len(keys)).astype(np.int64)
        h = np.zeros(len(keys), U64)
        h[place] = g[a:b]
        seen = np.flatnonzero(total >= min_count)
        lang, phrase = zip(*(keys[i].decode().rsplit("\n", 1) for i in seen.tolist())) if len(seen) else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()),
                                          pa.array(h[seen].view(np.int64)), pa.array(total[seen])], schema=schema)
        lo = hi


def trie_counts(dealt: DataFrame, parts: int, min_count: int, trie_bytes: int) -> DataFrame:
    """``lang, phrase, h, n`` of every phrase that occurs ``min_count`` times;
    a row without phrase has the words of its language."""
    schema = arrow_schema(COUNTED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = {}, {}
        for b in batches:
            for part, lang, n, blob in zip(*(c.to_pylist() for c in b.columns)):
                if part < 0:
                    words[lang] = words.get(lang, 0) + n
                else:
                    held.setdefault(part, []).append(blob)
        if words:
            empty = pa.nulls(len(words), pa.string()), pa.nulls(len(words), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(words), pa.string()), *empty, pa.array(list(words.values()), pa.int64())], schema=schema)
        for part in sorted(held):
            yield from part_counts(held.pop(part), min_count, trie_bytes, schema)
        release()

    return dealt.repartitionById(parts, "part").mapInArrow(run, COUNTED)


# --- scores ------------------------------------------------------------------

def _exact(c: Column) -> Column:
    return c.cast("decimal(16,0)")


def scores(counts: DataFrame, max_words: int) -> DataFrame:
    """Candidates of two words or more (``lang, phrase, a, l, r, score``) by
    their lowest cut, those inside a longer one gone."""
    c = counts.withColumn("w", F.split("phrase", " "))
    phrases = c.filter(F.size("w") >= 2).select("lang", "phrase", "w", F.col("n").alias("a"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = (cuts.withColumn("first", F.array_join(F.slice("w", F.lit(1), F.col("k")), " "))
            .withColumn("rest", F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ")))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    a = _exact(F.col("a"))
    cuts = cuts.withColumn("_x", (F.lit(1_000_000).cast("decimal(7,0)") * (a * a)).cast("decimal(38,0)")) \
               .withColumn("_y", (_exact(F.col("l")) * _exact(F.col("r"))).cast("decimal(38,0)")) \
               .withColumn("score", F.expr("_x div _y"))
    best = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.a", "b.l", "b.r", "b.score")
    # Phrases of two words or more inside longer ones.
    size = F.size("w")
    inside = phrases.filter(size > 2).select("lang", "w", F.col("a").alias("longer"), F.explode(
        F.sequence(F.lit(2), size - 1)).alias("m"))
    inside = inside.select("lang", "longer", "w", "m", F.explode(
        F.sequence(F.lit(1), size - F.col("m") + 1)).alias("i"))
    inside = (inside.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "longer")
              .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    return (best.join(inside, ["lang", "phrase"], "left")
            .filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(50) * F.col("a")))
            .drop("longer"))


def collocations(docs: DataFrame, min_count: int = 10, max_words: int = 3, top: int = 2000,
                 trie_bytes: int = TRIE_BYTES, wave_bytes: int = WAVE_BYTES,
                 part_bytes: int = PART_BYTES) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``."""
    n_bytes = _docs(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(n_bytes // part_bytes) + 1
    maps, counts, totals = [], None, None
    for k in range(1, max_words + 1):
        dealt = proposals(docs, maps, parts, wave_bytes)
        found = staged(trie_counts(dealt, parts, min_count, trie_bytes), f"phrases-{k}")
        if k == 1:
            totals = found.filter("phrase is null").select("lang", "n")
            found = found.filter("phrase is not null")
        if k < max_words:
            maps.append(bitmap(found, "h"))
        counts = found if counts is None else counts.union(found)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # The first of a language are among the first of its shares, so no task sorts a whole language.
    share = F.pmod(F.xxhash64("phrase"), F.lit(math.isqrt(parts)))
    ranked = scores(counts, max_words)
    for group in (["lang", share], ["lang"]):
        ranked = (ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint"))
                  .filter(F.col("rank") <= top))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
