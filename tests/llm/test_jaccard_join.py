import collections

from common import LOWER, SPACED, docs_frame, rng, table

from touchline.llm import jaccard_join as J


def shingles(t):
    w = SPACED.findall((t or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for g in s for j in where[g])
        for g in s:
            where[g].append(i)
        for j, k in shared.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n):
    r = rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    bases = [[r.choice(vocab) for _ in range(r.choice([3, 5, 8, 20, 40, 100]))] for _ in range(10)]
    chain = [r.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(n):
        k = r.random()
        if k < 0.5:
            b = list(r.choice(bases))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                b[r.randrange(len(b))] = r.choice(vocab)
        elif k < 0.75:          # a chain of overlapping texts, linked only step by step
            o = r.randrange(0, 50)
            b = (chain * 4)[o:o + 45]
        else:
            b = [r.choice(vocab) for _ in range(r.choice([0, 1, 2, 4, 5, 30]))]
        rows.append((i * 7 % 1009, " ".join(b)))
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 40)          # several blocks a tile
    rows = corpus(1, 500) + [(2001, None), (2002, "  "), (2003, ""), (5, "One two"), (5, "one TWO"),
                             (None, "only here and nowhere else today"), (3000, "z y x w v " * 8000)]
    got = J.jaccard_components(docs_frame(spark, rows)).select("doc_id", "n_shingles", "component_id")
    assert table(got) == brute(rows)


def test_keep_one_of_each_component(spark):
    rows = corpus(2, 150) + [(2001, None), (None, "only here and nowhere else today"), (2002, "")]
    rows += [rows[3]]
    frame = docs_frame(spark, rows)
    kept = J.keep_one(frame)
    assert kept.schema == frame.schema
    truth = brute(rows)
    want = {r[2] for r in truth if r[1]} | {r[0] for r in truth if not r[1]}
    assert sorted((r[0] for r in table(kept)), key=str) == sorted(want, key=str)
    assert J.keep_one(frame.limit(0)).count() == 0


def test_bit_counts_never_exclude_a_link():
    import numpy as np
    r = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(r.integers(0, 2**63, 120).astype(np.uint64))
        b = np.unique(np.concatenate((a[r.integers(0, 5):], r.integers(0, 2**63, 9).astype(np.uint64))))
        bits = [np.bincount((J.T.mix64(x) % np.uint64(J.BITS)).astype(int), minlength=J.BITS) & 1
                for x in (a, b)]
        assert (len(a) + len(b) - int((bits[0] ^ bits[1]).sum())) / 2 >= J._overlap(a, b)


def test_rows_without_words_all_stay(spark):
    empty = [(None, None), (None, None), (None, ""), (None, " "), (7, ""), (7, None), (8, " \n\t"), (9, None)]
    rows = empty + [(1, "one two three"), (1, "one two three"), (None, "four"), (None, "four"), (2, "\u00a0"),
                    (2, "\u00a0"), (7, "")]
    kept = table(J.keep_one(docs_frame(spark, rows)).select("doc_id", "text"))
    assert kept == sorted(empty + [(1, "one two three"), (None, "four"), (2, "\u00a0")], key=str)
