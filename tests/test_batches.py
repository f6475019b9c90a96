import pyarrow as pa

from granary.operators import chunking, splitting
from granary.operators.batches import portions


def test_portions_hold_every_row_once_and_little_text():
    texts = ["é" * 300, None, "", "x" * 5000, *["y" * 90] * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"]).slice(1)
    parts = list(portions(batch, 1, most=1000))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(1, len(texts)))
    assert len(parts) > 4 and all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 1000 for p in parts)
    assert list(portions(batch.slice(0, 0), 1)) == []


def test_chunks_are_made_portion_by_portion(spark, monkeypatch):
    """A batch of 3 MB gives its chunks in several batches, none of them much over a portion."""
    docs = spark.createDataFrame([(i, "A sentence of words. " * 5000) for i in range(30)], "doc_id long, text string")
    batch = pa.RecordBatch.from_arrays([pa.array([r.doc_id for r in docs.collect()]), pa.array([r.text for r in docs.collect()])], names=["doc_id", "text"])
    taken = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, cut, schema: taken.append(list(cut(iter([batch])))) or self)
    chunking.chunk_documents(docs)
    splitting.recursive_chunks(docs, 400, 40)
    for made in taken:
        assert len(made) > 1 and max(b.nbytes for b in made) < 2 << 20 and set(pa.Table.from_batches(made)["doc_id"].to_pylist()) == set(range(30))
