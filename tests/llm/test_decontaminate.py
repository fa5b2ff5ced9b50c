import hashlib

import numpy as np
from common import ALNUM, LOWER, docs_frame, rng, table

from touchline.llm import decontaminate as D


def words(t):
    return ALNUM.findall((t or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault((n, tuple(w[j:j + n])), set()).add(i)
    out = []
    for d, t in docs:
        w, ids = words(t), set()
        hit = np.zeros(len(w), bool)
        for n in {k[0] for k in windows}:
            for j in range(len(w) - n + 1):
                found = windows.get((n, tuple(w[j:j + n])))
                if found:
                    hit[j:j + n] = True
                    ids |= found
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((d, len(w), int(hit.sum()), len(ids),
                    hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit.any())))
    return sorted(out, key=str)


def random_case(seed):
    r = rng(seed)
    vocab = ["a", "b", "c", "The", "Öl", "x1"][:r.choice([2, 3, 6])]

    def text(n):
        return r.choice([" ", ", ", "\n"]).join(r.choice(vocab) for _ in range(n))

    items = [(k, text(r.choice([0, 1, 3, 9, 10, 11, 15, 30]))) for k in range(8)]
    docs = [(k, text(r.randrange(0, 60)) + " " + r.choice(items)[1] + " zz " + text(3))
            for k in range(40)]
    return docs, items


COLS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_against_brute_force(spark):
    for seed in range(3):
        docs, items = random_case(seed)
        docs += [(100, None), (101, ""), (102, " ,."), (3, docs[3][1]), (3, docs[3][1]),
                 (None, docs[4][1]), (103, "a " * 50_000)]
        items += [(None, "q r s"), (90, None), (90, "q r s t"), (1, items[1][1])]
        bench = spark.createDataFrame(items, "item_id bigint, text string")
        got = table(D.contamination(docs_frame(spark, docs), bench).select(*COLS))
        assert got == brute(docs, items)


def test_matches_are_the_longest(spark):
    item = " ".join(f"w{i}" for i in range(30))
    doc = "x y " + " ".join(f"w{i}" for i in range(5, 25)) + " z " + " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    row = D.contamination(docs_frame(spark, [(1, doc)]), bench).first()
    found = sorted((m["item_word"], m["doc_word"], m["n_words"]) for m in row["matches"])
    assert found == [(0, 23, 12), (5, 2, 20)]


def test_blocks_of_items_agree(spark, monkeypatch):
    docs, items = random_case(5)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    frame = docs_frame(spark, docs)
    one = table(D.contamination(frame, bench).select(*COLS))
    monkeypatch.setattr(D, "BLOCK_BYTES", 60)
    assert len(D.test_blocks(bench, "item_id", "text")) > 2
    assert table(D.contamination(frame, bench).select(*COLS)) == one == brute(docs, items)


def test_removal_keeps_clean_rows_whole(spark):
    docs, items = random_case(6)
    docs.append((50, None))
    frame = docs_frame(spark, docs)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    bad = {r[0] for r in brute(docs, items) if r[5]}
    kept = D.remove_contaminated(frame, bench)
    assert kept.schema == frame.schema
    assert table(kept) == [r for r in table(frame) if r[0] not in bad]


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    frame = docs_frame(spark, [(1, "a b c")])
    assert D.contamination(frame.limit(0), bench).count() == 0
    assert not D.contamination(frame, bench.limit(0)).first()["contaminated"]
    assert D.remove_contaminated(frame, bench.limit(0)).count() == 1
