import collections
import hashlib

import numpy as np
from common import docs_frame, rng, table

from touchline.llm import suffix_dedup as S


def brute(rows, span=400):
    seen = collections.Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        for j in range(len(b) - span + 1):
            seen[b[j:j + span]] += 1
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - span + 1):
            if seen[b[j:j + span]] > 1:
                gone[j:j + span] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=120):
    r = rng(seed)

    def text(k):
        return "".join(r.choice("ab cdé\n\0") for _ in range(k))

    parts = [text(k) for k in (300, 399, 400, 401, 420, 700, 1500)]
    rows = []
    for i in range(n):
        t = ""
        for _ in range(r.randrange(0, 4)):
            t += text(r.randrange(0, 300)) + r.choice(parts)[r.choice([0, 0, 1, 30]):]
        rows.append((i, t))
    return rows + [(900, "a" * 1000), (901, "ab" * 700), (902, "a" * 399), (903, None), (904, ""),
                   (905, parts[5]), (905, parts[5]), (None, parts[6]), (None, text(50)),
                   (906, "a" * 450), (907, text(60_000))]


COLS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_against_brute_force(spark):
    rows = corpus(1)
    got = S.dedup_report(docs_frame(spark, rows)).select(*COLS)
    assert table(got) == brute(rows)


def test_blocks_of_a_hot_anchor(spark):
    rows = corpus(2)
    got = S.dedup_report(docs_frame(spark, rows), hot_limit=6).select(*COLS)
    assert table(got) == brute(rows)


def test_removed_text_stays_whole_characters(spark):
    p = "é" * 300
    rows = [(1, "x" + p + "y"), (2, "è" + p + "w"), (3, "keep me"), (4, None), (5, "")]
    frame = docs_frame(spark, rows)
    out = S.remove_repeats(frame)
    assert out.schema == frame.schema
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got[3] == ("keep me", 7) and got[4][0] is None and got[5][0] == ""
    assert got[1] == ("xy", 2) and got[2] == ("èw", 2)
    assert S.remove_repeats(frame.limit(0)).count() == 0


def test_rounds_give_common_prefixes():
    """Runs of windows of aligned texts equal direct comparison."""
    r = rng(3)
    base = bytes(r.choice(b"abc") for _ in range(760))
    texts, right = [], []
    for _ in range(40):
        b = bytearray(base)
        for _ in range(r.choice([0, 1, 2])):
            b[r.randrange(760)] = r.choice(b"xyz")
        lo, hi = r.randrange(0, 150), r.randrange(610, 760)
        texts.append(np.frombuffer(bytes(b[lo:hi]), np.uint8))
        right.append(hi - 360)
    right = np.array(right)
    near = S.SPAN - right
    far = near + np.array([len(t) - S.SPAN for t in texts])
    who, a, b = S.sort_columns(texts, right, np.zeros(40, np.int64), np.maximum(near, 0), far)
    got = {(int(i), d) for i, x, y in zip(who, a, b) for d in range(x, y + 1)}
    at = collections.defaultdict(list)
    for i, t in enumerate(texts):
        for s in range(len(t) - S.SPAN + 1):
            d = int(far[i] - s)
            if d >= max(0, near[i]):
                at[d, t[s:s + S.SPAN].tobytes()].append((i, d))
    assert got == {x for v in at.values() if len(v) > 1 for x in v}


def test_passages_by_length(spark):
    """Passages of 51 to 90 words in two documents each: those of at least the
    span go from both, whatever stands beside them, shorter ones stay."""
    r = rng(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.choice([2, 4, 5, 6, 9])))
    text = lambda n: " ".join(word() for _ in range(n))
    span, docs, planted = 350, [], {}
    for k in range(51, 91):
        passage = text(k)
        planted[k] = len(passage)
        docs += [(2 * k, f"{text(60)} |{passage}| {text(9)}"), (2 * k + 1, f"<{passage}> {text(70)}")]
    assert min(planted.values()) < span < max(planted.values())
    df = docs_frame(spark, docs)
    got = {x.doc_id: x.text for x in S.remove_repeats(df, span=span).collect()}
    for k, n in planted.items():
        for i, before in docs[2 * (k - 51):2 * (k - 51) + 2]:
            # One space on either side may belong to the match.
            assert (len(before) - len(got[i])) in ((n, n + 1, n + 2) if n >= span else (0,) if n < span - 2 else (0, n, n + 1, n + 2))
