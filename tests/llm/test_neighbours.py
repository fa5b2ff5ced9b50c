import numpy as np
from common import table

from touchline.llm import neighbours as N

SF = "/root/testdata/sf0.01"


def brute(ids, x, q_ids, q, k=10):
    out = {}
    for i, v in zip(q_ids, q):
        d = np.sqrt(np.square(x - v).sum(axis=1))
        d[ids == i] = np.inf
        first = np.lexsort((ids, d))[:k]
        out[int(i)] = [int(j) for j, e in zip(ids[first], d[first]) if np.isfinite(e)]
    return out


def test_quantile():
    assert abs(N.chi_square_quantile(0.95, 2) - 5.9915) < 1e-3
    assert abs(N.chi_square_quantile(0.99, 8) - 20.0902) < 1e-3


def test_recall_and_scores(spark):
    from pyspark.sql import functions as F
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = N.nearest(rows, rows.filter(F.col("vec_id") % 20 == 0)).toPandas()
    pdf = rows.toPandas()
    ids, x = pdf.vec_id.to_numpy(), np.stack(pdf.embedding).astype(float)
    want = brute(ids, x, ids[ids % 20 == 0], x[ids % 20 == 0])
    hit = sum(len(set(g.vec_id) & set(want[q])) for q, g in got.groupby("query_id"))
    assert hit >= 0.9 * sum(map(len, want.values()))
    at = {i: v for i, v in zip(ids, x)}
    for r in got.head(50).itertuples():
        assert abs(r.score - np.sqrt(np.square(at[r.query_id] - at[r.vec_id]).sum())) < 1e-12


def test_clusters_stop_early():
    r = np.random.default_rng(0)
    centre = r.normal(size=(40, 32)) * 20
    x = centre[r.integers(0, 40, 8000)] + r.normal(size=(8000, 32))
    ids = np.arange(8000)
    best = [(np.zeros(0), np.zeros(0, np.int64))] * 50
    seen = N.search_block(ids, x, ids[:50], x[:50], 10, 0.99, best)
    want = brute(ids, x, ids[:50], x[:50])
    assert seen < 0.5 * 50 * 8000
    assert sum(len(set(best[i][1]) & set(want[i])) for i in range(50)) >= 0.9 * 500


def test_ties_and_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [1.0, 2.0]) for i in range(40, 0, -1)]
    rows += [(100, [5.0, 5.0]), (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [inf, 1.0]),
             (600, [None, 1.0]), (700, [1.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    from pyspark.sql import functions as F
    got = table(N.nearest(df, df.filter("vec_id in (20, 100, 200, 400, 700)")))
    want_20 = [1, 2, 3, 4, 5, 6, 7, 7, 8, 9]
    assert [(r[1], r[2]) for r in sorted(x for x in got if x[0] == 20)] == list(
        zip(range(1, 11), want_20))
    assert {r[0] for r in got} == {20, 100}
    few = N.nearest(df.filter(F.col("vec_id").isin(1, 100)), df.filter("vec_id = 100"))
    assert [r[:3] for r in table(few)] == [(100, 1, 1)]
    assert N.nearest(df.limit(0), df.limit(0)).count() == 0


def test_query_id_with_different_vectors(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 30)],
                                 "vec_id bigint, embedding array<float>")
    for asked in ([20.0, 5.0, 9.0], [5.0, 20.0, 9.0], [9.0, 20.0, 5.0]):
        q = spark.createDataFrame([(99, [a, 1.0]) for a in asked], rows.schema).coalesce(1)
        got = table(N.nearest(rows, q, k=1))
        assert got == [(99, 1, 5, 0)]


def test_blocks_are_staged_one_by_one(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 101)],
                                 "vec_id bigint, embedding array<float>")
    asked = rows.filter("vec_id <= 50")
    want = table(N.nearest(rows, asked, k=3))
    monkeypatch.setattr(N, "QUERY_BLOCK", 8)
    got = N.nearest(rows, asked, k=3)
    assert table(got) == want and len(want) == 150
    # No closure with a block's queries is left in the plan.
    assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
