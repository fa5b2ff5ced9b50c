import sys

import __spark_entry__ as entry
import corpus_pipeline
from test_decontaminate import brute as windows
from test_jaccard_join import brute as groups
from test_suffix_dedup import brute as repeats
from touchline.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "toxicity":
            gone = {i for i, _ in before} - set(ids(docs))
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert all(labels.get(i, 1) == 1 for i in gone) and len(gone) < 0.2 * len(before)
        elif name == "jaccard_join":
            truth = groups(before)
            assert ids(docs) == sorted({r[2] for r in truth if r[1]} | {r[0] for r in truth if not r[1]})
        elif name == "suffix_dedup":
            size = {r["doc_id"]: len(r["text"].encode()) for r in docs.collect()}
            for i, n, removed, spans, _ in repeats(before, corpus_pipeline.PASSAGE_BYTES):
                assert 0 <= size[i] - (n - removed) <= 6 * spans     # whole characters only
        elif name == "decontamination":
            assert ids(docs) == sorted(r[0] for r in windows(before, items) if not r[5])
        else:
            assert set(ids(docs)) <= {i for i, _ in before}
            assert max(ids(docs).count(i) for i in set(ids(docs))) <= 3
        if name != "mixing":
            assert docs.columns == corpus_pipeline.COLUMNS


def test_registered():
    names = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(SQL) <= set(QUERIES)


def test_rest_works_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "touchline.llm.queries", None)
    names = entry.queries()
    assert "pipeline" not in names and "attribution_report" in names
