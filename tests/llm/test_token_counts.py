import numpy as np
import pyarrow as pa
import pytest
from common import docs_frame, rng, slices_of, table

from touchline.llm.queries import model_path
from touchline.llm.token_counts import PieceModel, _Counter, _marks_as_spaces, token_counts

sentencepiece = pytest.importorskip("sentencepiece")
PARTS = [" ", "  ", "▁", "a", "b", "the", "\n", "é", "日", "本", "①", "<s>", "</s>", "<unk>",
         "<0x41>", "\x00", " " * 40, "ing", "er", "x" * 30, "=" * 17, "----", "1", "🙂", "н"]


def library(texts):
    m = sentencepiece.SentencePieceProcessor(model_file=model_path())
    return [len(x) for x in m.encode(texts)]


def test_counts_equal_the_library():
    r = rng(1)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(0, 60))) for _ in range(1500)]
    c = _Counter(model_path())
    got = np.concatenate([c.counts(d, o) for _, d, o in
                          slices_of(_marks_as_spaces(pa.array(texts)).to_pylist())])
    assert got.tolist() == library(texts)


def test_edge_rows(spark):
    long = "word " * 30_000 + "日" * 3_000
    rows = [(1, None), (2, ""), (3, " "), (4, long), (5, "a b"), (5, "a b"), (None, "x")]
    got = table(token_counts(docs_frame(spark, rows), model_path()))
    n = dict(zip([t for _, t in rows if t], library([t for _, t in rows if t])))
    want = [(i, len((t or "").encode()), n.get(t, 0), n.get(t, 0) > 4096) for i, t in rows]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert token_counts(docs_frame(spark, [(1, "a")]).limit(0), model_path()).count() == 0


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "m.model"
    path.write_bytes(b"\x0a\x05\x0a\x03a\xe2\x96")
    with pytest.raises(Exception):
        PieceModel(str(path))
