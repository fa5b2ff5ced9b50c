"""Benchmark decontamination over suffix arrays of the training documents.

A task cuts its documents into shards of a few megabytes.  For each shard it
builds the word-level suffix array of the training text, by prefix doubling
over word numbers, and binary-searches every test suffix in it: the range of
equal windows gives all locations, and each location is extended to the
longest verbatim match.

Words that no test item holds cannot be in a match, so they end suffixes, and
runs shorter than the shortest window are left out of the array; both are
exact.  Test items come in blocks of bounded size, one pass over the rows
each, without any shuffle.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import textops as T

WINDOW = 10
BLOCK_BYTES = 2 << 20       # test text per pass

# Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
KEEP = T.class_of([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
TABLE = T.byte_table(KEEP, fold_case=True)

SCHEMA = ("doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
          "contaminated boolean, items array<string>, "
          "matches array<struct<item_id:string,item_word:int,doc_word:bigint,n_words:int>>")


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, _, row = T.word_spans(data, offs, KEEP)
    return T.span_hashes(data, starts, TABLE), row


@dataclass
class TestBlock:
    """Suffixes of a block of test items over a dense word numbering."""
    ids: list                 # item ids as strings (None for null)
    vocab: np.ndarray         # sorted word hashes; word number = place + 1
    text: np.ndarray          # word numbers, items separated and padded by 0
    item: np.ndarray          # per suffix: item, place in text, place in item, window length
    place: np.ndarray
    word: np.ndarray
    window: np.ndarray
    longest: int
    shortest: int

    @classmethod
    def of(cls, ids: list, texts: list) -> "TestBlock":
        data, offs = T.text_bytes(pa.array(texts, pa.large_string()))
        h, row = _words(data, offs)
        vocab = np.unique(h)
        number = (np.searchsorted(vocab, h) + 1).astype(np.int64)
        n = np.bincount(row, minlength=len(ids))
        begin = T.row_starts(row, len(ids))
        longest = int(n.max(initial=0))
        text = np.zeros(len(h) + len(ids) + longest + 1, np.int64)
        place = np.arange(len(h)) + row
        text[place] = number
        word = np.arange(len(h)) - begin[row]
        window = np.minimum(n, WINDOW)
        use = word + window[row] <= n[row]     # suffixes that hold a whole window
        return cls(ids, vocab, text, row[use], place[use], word[use], window[row][use],
                   longest, int(window[n > 0].min(initial=WINDOW)))


def suffix_array(text: np.ndarray, at: np.ndarray, run: np.ndarray, depth: int) -> np.ndarray:
    """Places ``at`` in order of the words that follow them, to ``depth`` words
    or the next 0; equal suffixes by place.  Prefix doubling: 1, 2, 4, ..."""
    rank = np.zeros(len(text) + depth + 1, np.int64)
    rank[:len(text)] = text
    span = 1
    while span < depth:
        # A suffix that ended within the span has no second half.
        second = rank[at + span]
        full = run[at] >= span
        key = rank[at] * np.int64(len(at) + int(text.max(initial=0)) + 2) + np.where(full, second, 0)
        _, new = np.unique(key, return_inverse=True)
        rank = np.zeros(len(rank), np.int64)
        rank[at] = new + 1
        span *= 2
    return at[np.argsort(rank[at], kind="stable")]


def text_runs(text: np.ndarray) -> np.ndarray:
    """Words from each place to the next 0."""
    n = len(text)
    stop = np.where(text == 0, np.arange(n), n)
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)


def _bounds(text: np.ndarray, sa: np.ndarray, tests: TestBlock) -> tuple[np.ndarray, np.ndarray]:
    """Range of the suffix array that starts with each test suffix's window."""
    k = np.arange(WINDOW)
    live = k[None, :] < tests.window[:, None]
    want = np.where(live, tests.text[np.minimum(tests.place[:, None] + k, len(tests.text) - 1)], 0)

    def search(upper: bool) -> np.ndarray:
        lo = np.zeros(len(want), np.int64)
        hi = np.full(len(want), len(sa), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            have = text[sa[np.minimum(mid, len(sa) - 1)][:, None] + k]
            # Words after a 0 belong to another text.
            ended = np.cumsum(have == 0, axis=1) > 0
            have = np.where(live & ~ended, have, 0)
            differ = have != want
            first = np.argmax(differ, axis=1)
            rows = np.arange(len(want))
            less = differ.any(axis=1) & (have[rows, first] < want[rows, first])
            right = (less | ~differ.any(axis=1)) if upper else less
            lo = np.where(open_ & right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        return lo

    return search(False), search(True)


def find_matches(data: np.ndarray, offs: np.ndarray, tests: TestBlock):
    """Words per row, and all left-maximal longest matches of a shard:
    (words per row, row, item, word in item, word in row, length)."""
    n_rows = len(offs) - 1
    h, row = _words(data, offs)
    n_words = np.bincount(row, minlength=n_rows)
    none = (n_words,) + (np.zeros(0, np.int64),) * 5
    if not len(h) or not len(tests.place):
        return none
    at = np.minimum(np.searchsorted(tests.vocab, h), len(tests.vocab) - 1)
    number = np.where(tests.vocab[at] == h, at + 1, 0)
    text = np.zeros(len(h) + n_rows + max(tests.longest, WINDOW) + 1, np.int64)
    place = np.arange(len(h)) + row
    text[place] = number
    run = text_runs(text)
    # Whole runs are ranked (tails order the suffixes before them); suffixes
    # that are shorter than every window are then left out.
    opens = (text > 0) & (np.concatenate(([0], text[:-1])) == 0)
    whole = run[np.maximum.accumulate(np.where(opens, np.arange(len(text)), 0))]
    sa = suffix_array(text, np.flatnonzero((text > 0) & (whole >= tests.shortest)), run,
                      tests.longest)
    sa = sa[run[sa] >= tests.shortest]
    if not len(sa):
        return none
    lo, hi = _bounds(text, sa, tests)
    count = hi - lo
    t = np.repeat(np.arange(len(lo)), count)
    spot = sa[np.arange(len(t)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
    source = tests.place[t]
    # Not left-maximal: the match that starts one word earlier holds it.
    before = (tests.word[t] > 0) & (spot > 0) & (tests.text[source - 1] == text[spot - 1])
    t, spot, source = t[~before], spot[~before], source[~before]
    length = tests.window[t].astype(np.int64)
    growing = np.arange(len(t))
    while len(growing):
        a = tests.text[np.minimum(source[growing] + length[growing], len(tests.text) - 1)]
        b = text[np.minimum(spot[growing] + length[growing], len(text) - 1)]
        growing = growing[(a == b) & (a > 0)]
        length[growing] += 1
    begin = T.row_starts(row, n_rows)
    # Place in the padded text = word number in the shard + row.
    word_of = np.zeros(len(text), np.int64)
    word_of[place] = np.arange(len(h))
    r = row[word_of[spot]]
    return n_words, r, tests.item[t], tests.word[t], word_of[spot] - begin[r], length


def test_blocks(bench: DataFrame, item_col: str, text_col: str) -> list[TestBlock]:
    """Test items in blocks of about ``BLOCK_BYTES`` of text (a longer item
    makes a larger block); only one block's rows are gathered at a time."""
    items = bench.select(F.col(item_col).cast("string").alias("item_id"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(total) // BLOCK_BYTES)
    blocks = []
    for b in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else items
        rows = part.collect()
        blocks.append(TestBlock.of([r["item_id"] for r in rows], [r["text"] for r in rows]))
    return blocks


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """Longest verbatim matches of every document (``SCHEMA``).

    ``n_hit`` counts document words inside any occurrence of a window of
    ``WINDOW`` item words (an item of fewer words is one window); ``items``
    are the ids with an occurring window.  One row per input row: repeated
    ids stay repeated, null or empty texts have no words.  Items without
    words never match; an item with a null id marks words but is not listed.
    With an empty benchmark nothing is contaminated.
    """
    match_type = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()),
                                     ("doc_word", pa.int64()), ("n_words", pa.int32())]))
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                      F.col(text_col).alias("text"),
                      F.expr("cast(array() as array<struct<item_id:string,item_word:int,"
                             "doc_word:bigint,n_words:int>>)").alias("matches"))
    blocks = test_blocks(bench, item_col, item_text_col) or [TestBlock.of([], [])]

    def search(tests: TestBlock, last: bool):
        def run(batches):
            for rows, data, offs in T.slices(batches, "text"):
                n_words, r, item, iw, dw, n = find_matches(data, offs, tests)
                found = [list(x) for x in rows.column(2).to_pylist()]
                for i, j, a, b, m in zip(r.tolist(), item.tolist(), iw.tolist(), dw.tolist(),
                                         n.tolist()):
                    found[i].append({"item_id": tests.ids[j], "item_word": a, "doc_word": b,
                                     "n_words": m})
                if not last:
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), rows.column(1), pa.array(found, match_type)],
                        names=["doc_id", "text", "matches"])
                    continue
                hits, items, digests = [], [], []
                for m in found:
                    hits.append(_covered(m))
                    ids = sorted({x["item_id"] for x in m if x["item_id"] is not None})
                    items.append(ids)
                    digests.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(n_words.astype(np.int64)), pa.array(hits, pa.int64()),
                     pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()),
                     pa.array([x > 0 for x in hits], pa.bool_()),
                     pa.array(items, pa.list_(pa.string())), pa.array(found, match_type)],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256",
                           "contaminated", "items", "matches"])
        return run

    for k, tests in enumerate(blocks):
        last = k == len(blocks) - 1
        src = src.mapInArrow(search(tests, last), SCHEMA if last else src.schema)
    return src


def _covered(matches: list) -> int:
    total, end = 0, -1
    for lo, n in sorted((m["doc_word"], m["n_words"]) for m in matches):
        total += max(0, lo + n - max(lo, end))
        end = max(end, lo + n)
    return total


def remove_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text",
                        item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no test window, all columns unchanged."""
    at = docs.columns.index(text_col)
    schema = docs.schema

    def clean(tests: TestBlock):
        def run(batches):
            for batch in batches:
                batch = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
                for rows, data, offs in T.slices([batch], f"c{at}"):
                    keep = np.ones(rows.num_rows, bool)
                    keep[find_matches(data, offs, tests)[1]] = False
                    yield rows.filter(pa.array(keep)).rename_columns(schema.names)
        return run

    for tests in test_blocks(bench, item_col, item_text_col):
        docs = docs.mapInArrow(clean(tests), schema)
    return docs
