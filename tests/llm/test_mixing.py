import numpy as np
import pytest
from common import SPACED, docs_frame, rng, table

from touchline.llm import mixing as M


def test_targets():
    t = M.source_targets({"a": 100, "b": 100, "c": 100, None: 100})
    assert sum(t.values()) == pytest.approx(400)
    assert t["b"] == pytest.approx(2 * t["a"]) and t[None] == pytest.approx(t["a"])
    t = M.source_targets({"a": 1000, "b": 10, "c": 0})
    assert t == {"a": pytest.approx(980), "b": pytest.approx(30), "c": 0}
    # The excess of one source may push the next over its limit.
    t = M.source_targets({"a": 10_000, "b": 10, "c": 2500})
    assert t["b"] == 30 and t["c"] == pytest.approx(7500) and sum(t.values()) == pytest.approx(12_510)
    assert M.source_targets({}) == {} and M.source_targets({"a": 0}) == {"a": 0}


def test_tree_splits_exactly():
    q = np.array([5, 0, 1000, 37, 3072])
    leaves = M.splitting_tree(q, 13, seed=1)
    assert (leaves.sum(axis=0) == q).all() and (leaves >= 0).all()
    assert leaves.sum(axis=1).max() - leaves.sum(axis=1).min() <= 2
    assert (M.splitting_tree(q, 13, seed=1) == leaves).all()
    big = M.splitting_tree(np.array([40_000, 20_000]), 2, seed=3)
    assert abs(big[0, 0] - 20_000) < 600          # hypergeometric spread


def corpus(n):
    r = rng(4)
    return [(i, " ".join("w" * r.randrange(1, 4) for _ in range(r.choice([0, 3, 20, 50])))) for i in range(n)]


def test_mix(spark):
    rows = corpus(900) + [(2000, None), (2001, ""), (None, "a b c"), (3007, "same text"), (3007, "same text"),
                          (2002, "long " * 600)]
    frame = docs_frame(spark, rows).selectExpr(
        "* except (source)", "case when doc_id % 10 < 6 then 'big' when doc_id % 10 < 9 then 'mid' "
        "when doc_id = 2002 then null else 'b' end as source")
    got = M.mix(frame).toPandas()
    assert len(got) == len(rows)
    size = {i: len(SPACED.findall(t or "")) for i, t in rows}
    assert all(s == size[int(i)] for i, s in zip(got.doc_id, got["size"]) if i == i)
    assert (got.taken <= 3 * got["size"]).all()
    assert (got.taken == got["size"] * got.shards.map(len)).all()
    sizes = got.groupby("source", dropna=False)["size"].sum().to_dict()
    sizes = {(None if k != k or k is None else k): int(v) for k, v in sizes.items()}
    want = M.source_targets(sizes)
    for s, g in got.groupby("source", dropna=False):
        s = None if s != s or s is None else s
        assert g.target.iloc[0] == pytest.approx(want[s]) and g.source_size.iloc[0] == sizes[s]
        assert abs(g.taken.sum() - want[s]) <= max(60, 0.02 * want[s])
    again = M.mix(frame.repartition(5), keep_rows=False).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_mixed_rows_are_copies_of_input_rows(spark):
    rows = corpus(200) + [(2000, None)]
    frame = docs_frame(spark, rows)
    mixed = M.mix(frame, shards=5)
    out = M.mixed_rows(mixed)
    assert out.schema == frame.schema
    copies = {int(i): len(s) for i, s in mixed.select("doc_id", "shards").collect()}
    seen = {}
    for r in table(out):
        seen[r[0]] = seen.get(r[0], 0) + 1
    assert seen == {i: c for i, c in copies.items() if c}
    assert set(table(out)) <= set(table(frame))
    assert M.mix(frame.limit(0)).count() == 0
