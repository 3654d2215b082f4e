"""Batches are worked on in stretches of bounded bytes, whatever their number of rows; what comes out is the same."""

import pyarrow as pa
import pytest
from pyspark.sql.types import ArrayType, DoubleType, StructType
from siftline.functions import batches
from siftline.operators import chunks, repair, tokens

#: One batch as Spark hands it over: 3 MB of text, a null, an empty text, and one that is longer than a stretch.
TEXTS = [None, "", *("word ünd\nline %d " % i * 60 for i in range(3000)), "x y\n" * (batches.STRETCH // 3)]


def captured(monkeypatch, module, make):
    """The function that make hands to Spark's Arrow UDF."""
    found = []
    with monkeypatch.context() as m:
        m.setattr(module.F, "arrow_udf", lambda f, kind: lambda *columns: found.append(f))
        make()
    return found[0]


def test_tokens(monkeypatch):
    sizes = []

    def sized(texts):
        sizes.append(len(texts) > 1 and sum(len(t.encode()) for t in texts))
        return tokens.get("word")(texts)

    tokens.register("sized", lambda _: sized)
    parts = list(captured(monkeypatch, tokens, lambda: tokens.tokens("text", "sized"))(iter([pa.array(TEXTS)])))
    assert len(sizes) > 3 and max(sizes) <= batches.STRETCH
    got = [[t["start"] for t in row] for part in parts for row in part.to_pylist()]
    assert got == [x[1].tolist() for x in tokens.get("word")([t or "" for t in TEXTS])]


def parts_of(monkeypatch, module, make, *columns):
    f = captured(monkeypatch, module, make)
    return list(f(iter([columns if len(columns) > 1 else columns[0]])))


@pytest.mark.parametrize(("column", "whole"), [(chunks.line_spans, chunks._line_spans), (chunks.word_tokens, chunks._word_spans)])
def test_spans(monkeypatch, column, whole):
    parts = parts_of(monkeypatch, chunks, lambda: column(None), pa.array(TEXTS))
    assert len(parts) > 3 and [x for p in parts for x in p.to_pylist()] == whole(pa.array(TEXTS)).to_pylist()


@pytest.mark.parametrize("form", [chunks.with_merged_spans, chunks.with_line_scores])
def test_scores(form):
    """The function handed to mapInArrow gives several batches for one, and the same rows as text by text."""
    texts = [t or "" for t in TEXTS]
    words = [t.split() for t in texts]
    scores = pa.array([[[float(len(w) % 5) for w in x[k : k + 64]] for k in range(0, max(1, len(x) - 16), 48)] for x in words])
    found = []

    class Frame:
        schema = StructType().add("text", "string").add("scores", ArrayType(ArrayType(DoubleType())))
        mapInArrow = staticmethod(lambda f, schema: found.append(f))

    form(Frame, "text", "scores", 64, 16)
    batch = pa.RecordBatch.from_arrays([pa.array(texts), scores], ["text", "scores"])
    got = list(found[0](iter([batch])))
    alone = [row for k in range(len(texts)) for out in found[0](iter([batch.slice(k, 1)])) for row in out.to_pylist()]
    assert len(got) > 3 and [row for out in got for row in out.to_pylist()] == alone


def test_repairs(monkeypatch):
    code = "import os\ndef f(x):\n    if x:\n        return os.sep\n" + "y = 1\n" * 2000
    rows = [code] * 200 + [None, "def ("]
    parts = parts_of(monkeypatch, repair, lambda: repair.repair_udf("c", "k"), pa.array(rows), pa.array([[4]] * len(rows)))
    got = [r for p in parts for r in p.to_pylist()]
    want = [repair.repair(c, [4]) for c in (code, None, "def (")]
    assert len(parts) > 1 and [r | {"reasons": dict(r["reasons"])} for r in (got[0], *got[-2:])] == want and got[:200] == got[:1] * 200
