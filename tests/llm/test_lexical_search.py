import math
import re
from collections import Counter

import numpy as np
from common import LOWER, rng, table

from touchline.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall((t or "").translate(LOWER))


def brute(docs, items, k):
    rows = [(d, Counter(terms(t))) for d, t in docs]
    n = sum(1 for _, c in rows if c)
    total = sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    texts = {}
    for i, t in items:
        texts[i] = min(texts.get(i, t or ""), t or "")
    out = []
    for i, t in texts.items():
        hits = []
        for d, c in rows:
            size = sum(c.values())
            if not size:
                continue
            m = 75 + 25 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1)))
                    * (10 ** 9 * c[x] // (1000 * c[x] + 12 * m)) for x in terms(t) if x in c)
            if s > 0:
                hits.append((-s, d is None, d or 0, d))
        for r, h in enumerate(sorted(hits, key=lambda h: h[:3])[:k], 1):
            out.append((i, r, h[3], -h[0]))
    return sorted(out, key=str)


def check(spark, docs, items, k=20):
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame([(a, b, 2) for a, b in items], "item_id bigint, text string, doc_id int")
    got = sorted((tuple(r) for r in L.rank_documents(d, i, k).collect()), key=str)
    assert got == brute(docs, items, k)


def random_case(seed, n_docs=700, n_items=40):
    r = rng(seed)
    vocab = [f"w{j}" for j in range(60)] + ["The", "Öl", "ÄÖ", "7"]
    vocab2 = [f"v{j}" for j in range(60)]

    def text(n):
        words = r.choice([vocab, vocab2, vocab + vocab2])
        return r.choice([" ", ", ", "\n"]).join(r.choice(words) for _ in range(n))

    return ([(j, text(r.randrange(0, 60))) for j in range(n_docs)],
            [(j, text(r.randrange(0, 30))) for j in range(n_items)])


def test_against_brute_force(spark):
    docs, items = random_case(1)
    docs += [(9000, None), (9001, ""), (None, docs[5][1]), (None, docs[5][1]), (5, docs[5][1]), (9002, "w1 " * 60_000)]
    items += [(None, "w1 w2"), (70, None), (71, "... "), (72, "nowhere"), (3, "w9 w9 v3"), (73, "w3 " * 500)]
    check(spark, docs, items)
    check(spark, docs, items, 1)


def test_ties_and_few_documents(spark):
    docs = [(j, "a b c") for j in range(500, 0, -1)] + [(1000, "z")]
    check(spark, docs, [(1, "a"), (2, "z z"), (3, "b a")])
    check(spark, docs[:3], [(1, "a"), (2, "q")])


def test_blocks_and_trees(spark, monkeypatch):
    docs, items = random_case(2, 300, 30)
    monkeypatch.setattr(L, "BLOCK_BYTES", 500)
    monkeypatch.setattr(L, "ITEMS", 3)
    check(spark, docs, items)


def test_empty(spark):
    check(spark, [], [(1, "a")])
    check(spark, [(1, "a")], [])
    check(spark, [(1, None)], [(1, None)])


def test_bounds_hold_and_prune():
    r = np.random.default_rng(0)
    points = np.zeros((64, 40))
    for i in range(64):
        lo = 20 * (i % 2)
        points[i, lo + r.choice(20, 6, replace=False)] = r.integers(1, 100, 6)
    rows = [{int(t): int(v) for t, v in enumerate(points[i]) if v} for i in range(10)]
    tree = L.ItemTree(list(range(10)), rows)
    docs = points[:, tree.terms]
    docs = docs[L.median_order(docs)]
    full = tree.levels[-1] @ docs.T
    for floor in (1.0, float(np.quantile(full, 0.9)), 1e9):
        floors = np.where(tree.numbers >= 0, floor, np.inf)
        a, b, score = L.pairs_above(tree, docs, floors)
        want = {(i, j) for i in range(len(full)) for j in range(64) if full[i, j] >= floors[i]}
        assert set(zip(a.tolist(), b.tolist())) == want
        assert all(full[i, j] == s for i, j, s in zip(a, b, score))


def test_large_documents_share():
    tf, size = np.array([1, 2], np.int64), np.array([10 ** 12, 3], np.int64)
    n, total = 10 ** 9, 10 ** 15
    want = [10 ** 9 * int(t) // (1000 * int(t) + 12 * (75 + 25 * int(s) * n // total)) for t, s in zip(tf, size)]
    assert L.impacts(tf, size, n, total).tolist() == want
