import zlib

import numpy as np
import pyarrow.parquet as pq
from common import docs_frame

from touchline.llm import language_id as L

SF = "/root/testdata/sf0.01"


def test_gradients_match_differences():
    net = L.BiGRU(3, 4, seed=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(97, 101, (5, 6)).astype(np.uint8), r.integers(0, 3, 6)

    def loss():
        return -net.log_probs(x)[:, np.arange(6), y].mean()

    grads = net.step(x, y)
    for k in net.p:
        for at in list(zip(*np.nonzero(np.abs(grads[k]) > 1e-4)))[:6]:
            old = net.p[k][at]
            net.p[k][at] = old + 1e-4
            up = loss()
            net.p[k][at] = old - 1e-4
            down = loss()
            net.p[k][at] = old
            assert abs((up - down) / 2e-4 - grads[k][at]) < 2e-3 * max(1, abs(grads[k][at]))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.identify(docs, per_lang=60, steps=500, units=12).toPandas()
    lang = dict(zip(*pq.read_table(f"{SF}/documents.parquet").select(["doc_id", "lang"])
                    .to_pydict().values()))
    held = got[got.held_out]
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))
    assert np.mean([p == lang[i] for i, p in zip(held.doc_id, held.lang_pred)]) > 0.93
    assert got.score.between(0, 1).all()


def test_edge_rows(spark):
    rows = [(i, t) for i, t in enumerate(["die und der " * 4, "the of and " * 4] * 20)]
    rows += [(100, None), (101, ""), (102, "12 .. 34"), (103, "🙂 …"), (104, "日本"), (105, "x" * 70_000),
             (None, "the of"), (3, "the of"), (3, "the of")]
    frame = docs_frame(spark, rows).drop("lang").selectExpr(
        "*", "case when doc_id >= 100 then null when text like 'die%' then 'de' else 'en' end as lang")
    got = L.identify(frame, steps=60, units=6).toPandas()
    assert len(got) == len(rows)
    by = {int(i): (p, s) for i, p, s in zip(got.doc_id, got.lang_pred, got.score) if i == i}
    assert all(by[i] == ("und", 0.0) for i in (100, 101, 102, 103))
    assert by[104][0] in ("de", "en") and by[0][0] == "de" and by[1][0] == "en"
    blind = L.identify(frame.withColumn("lang", frame["lang"].substr(9, 1)).filter("doc_id > 99"))
    assert set(blind.toPandas().lang_pred) == {"und"}
    assert L.identify(frame.limit(0)).count() == 0
