from collections import Counter

import numpy as np
import re
from common import LOWER, rng, table

from touchline.llm import collocations as C


def brute(docs, min_count, max_words, top):
    f, n = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        cands = [p for p, a in c.items() if len(p) > 1 and a >= min_count]
        longer = Counter()
        for p in cands:
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i:i + m]] = max(longer[p[i:i + m]], c[p])
        rows = []
        for p in cands:
            a = c[p]
            if longer[p] and 100 * longer[p] >= 50 * a:
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, r, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out, key=str)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, x, 1) for i, (t, x) in enumerate(docs)],
                                 "doc_id bigint, text string, lang string, phrase int")


def random_docs(seed, n=120):
    r = rng(seed)
    vocab = ["a", "b", "the", "THE", "Öl", "x\x0b", "x'y", "\U0001f600", "ab", "c"]
    docs = []
    for _ in range(n):
        words = [r.choice(vocab) for _ in range(r.randrange(0, 40))]
        docs.append(("".join(w + r.choice([" ", "  ", "\t", ", ", ".", "\n", " "]) for w in words),
                     r.choice(["en", "fr", None])))
    return docs + [(None, "en"), ("", None), (" \t.,", "zz"), ("a b " * 20_000, "en"), ("q" * 3000 + " r", "long")] * 2


def test_against_brute_force(spark):
    for seed in range(2):
        docs = random_docs(seed)
        for most, top in ((3, 2000), (2, 5)):
            got = table(C.collocations(frame(spark, docs), 10, most, top))
            assert got == brute(docs, 10, most, top)


def test_many_small_tries_and_waves(spark):
    docs = random_docs(7)
    got = table(C.collocations(frame(spark, docs), 2, 4, 2000, trie_bytes=200, wave_bytes=8000))
    assert got == brute(docs, 2, 4, 2000)


def test_empty(spark):
    assert table(C.collocations(frame(spark, []))) == []
    assert table(C.collocations(frame(spark, [(None, None), ("a b", "en")]))) == []


def test_double_array_finds_all_keys():
    r = np.random.default_rng(3)
    keys = sorted({bytes(r.integers(0, 256, r.integers(1, 9), dtype=np.uint8)) for _ in range(3000)}
                  | {b"a", b"ab", b"abc", bytes(range(256)) * 3})
    base, check, accept = C.double_array(keys)

    def walk(key):
        s = 0
        for c in key:
            t = int(base[s]) + c
            if check[t] != s:
                return -1
            s = t
        return accept[s]

    assert [walk(k) for k in keys] == list(range(len(keys)))
    known = set(keys)
    for k in keys[:500]:
        other = k[:-1] + bytes([(k[-1] + 1) % 256])
        assert (walk(other) >= 0) == (other in known)


def test_exact_beyond_64_bits(spark):
    big = 40_000_000_000
    counts = spark.createDataFrame([("en", "a", big + 7), ("en", "b", big + 9), ("en", "a b", big)],
                                   "lang string, phrase string, n bigint")
    got = C.scores(counts, 3).first()
    assert got["score"] == 1_000_000 * big * big // ((big + 7) * (big + 9))


def test_texts_are_read_once_a_level(spark):
    docs = random_docs(7)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    frame_ = frame(spark, docs)
    got = table(C.collocations(frame_.mapInArrow(count, frame_.schema), 2, 3, 2000, trie_bytes=200, wave_bytes=8000))
    assert got == brute(docs, 2, 3, 2000)
    assert seen.value <= 4 * len(docs)          # three levels and the size, however many tries


def test_many_parts(spark):
    docs = random_docs(5)
    for top in (3, 2000):
        got = table(C.collocations(frame(spark, docs), 2, 3, top, trie_bytes=500, wave_bytes=8000, part_bytes=4000))
        assert got == brute(docs, 2, 3, top)


def test_phrases_of_one_hash(spark):
    def blob(rows):
        texts = [t.encode() for _, _, t in rows]
        return C.pack(np.array([g for g, _, _ in rows], np.uint64), np.array([n for _, n, _ in rows]),
                      np.array([len(t) for t in texts], np.int32), np.frombuffer(b"".join(texts), np.uint8))

    blobs = [blob([(5, 9, "en\na b"), (5, 7, "en\na c"), (5, 1, "x\ny\na b"), (8, 9, "en\nd")]),
             blob([(5, 3, "en\na b"), (5, 3, "en\na c"), (5, 1, "en\na"), (9, 10, "en\nd e")])]
    for trie_bytes in (1, 1000):
        out = C.part_counts(blobs, 10, trie_bytes, C.arrow_schema(C.COUNTED))
        got = sorted(tuple(x.values()) for b in out for x in b.to_pylist())
        assert got == [("en", "a b", 5, 12), ("en", "a c", 5, 10), ("en", "d e", 9, 10)]


def test_merge_keeps_pairs_apart():
    g, other = np.array([3, 3, 1, 3, 1], np.uint64), np.array([0, 1, 0, 0, 0], np.uint64)
    keep, n = C._merge(g, other, np.array([1, 2, 4, 8, 16]))
    sums = {}
    for i, x in zip(keep.tolist(), n.tolist()):
        sums[int(g[i]), int(other[i])] = sums.get((int(g[i]), int(other[i])), 0) + x
    assert sums == {(1, 0): 20, (3, 0): 9, (3, 1): 2}
