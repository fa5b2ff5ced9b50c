import zlib

import numpy as np
import pyarrow.parquet as pq
from common import docs_frame, slices_of, table

from touchline.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def sample():
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    text = dict(zip(docs["doc_id"], docs["text"]))
    lab = pq.read_table(f"{SF}/labels.parquet").to_pydict()
    return [(i, text[i], y) for i, y in zip(lab["doc_id"], lab["toxic"]) if i in text]


def test_held_out_accuracy():
    rows = sample()
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 0][:4000]
    model = X.train([r[1] for r in learn], np.array([r[2] for r in learn]))
    p = np.concatenate([model.scores(d, o) for _, d, o in slices_of([r[1] for r in held])])
    y = np.array([r[2] for r in held])
    # A tenth of this table's toxic labels are on texts without any mark.
    assert ((p >= 0.5) & (y == 1)).sum() >= 0.85 * y.sum()
    assert ((p >= 0.5) & (y == 0)).sum() <= 0.005 * (y == 0).sum()


def test_label_model_finds_good_and_copied_voters():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.3
    side = np.where(y, 1, -1)
    votes = np.stack([np.where(r.random(4000) < a, side, -side) * (r.random(4000) < 0.8)
                      for a in (0.95, 0.9, 0.85, 0.6, 0.5)], axis=1).astype(np.int8)
    votes = np.concatenate((votes, votes[:, 3:4], votes[:, 3:4]), axis=1)    # a voter and its copies
    m = X.LabelModel.fit(votes, 0.5 + 0.2 * votes[:, 0])
    acc = m.accuracies()
    assert acc[0] > 0.9 and acc[0] > acc[2] > acc[3]
    assert m.share[3] < 0.5 < m.share[0]
    assert ((m.posterior(votes) >= 0.5) == y).mean() > 0.9


def test_edge_rows(spark):
    rows = [(i, ("nasty vile " if i % 4 == 0 else "kind words here ") + f"t{i}") for i in range(200)]
    rows += [(300, None), (301, ""), (302, "nasty vile " * 20_000), (5, "again"), (5, "again"),
             (None, "nasty vile")]
    frame = docs_frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)]
                                   + [(0, 1), (1, None), (None, 1), (999, 1)], "doc_id bigint, toxic int")
    model = X.fit(frame, labels)
    got = X.score(frame, model).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()
    for i, h in zip(got.doc_id, got.held_out):
        assert h == (i == i and zlib.crc32(str(int(i)).encode()) % 5 == 0)
    flag = {int(i): p for i, p in zip(got.doc_id, got.predicted) if i == i}
    assert flag[8] == 1 and flag[9] == 0 and flag[302] == 1 and flag[300] == flag[301] == 0
    kept = X.remove_toxic(frame, model)
    assert kept.schema == frame.schema
    assert len(table(kept)) == int((got.predicted == 0).sum())
    none = X.fit(frame, labels.limit(0))
    assert X.score(frame, none).filter("predicted = 1").count() == 0
    assert X.score(frame.limit(0), model).count() == 0
