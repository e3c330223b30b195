import pyarrow as pa
from umbra.llm.batches import pieces


def test_pieces_keep_every_row_in_order():
    texts = ["a" * 5, None, "", "b" * 50, "c", "d" * 9, "é" * 3]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "t"])
    for most in (1, 6, 10, 1000):
        found = list(pieces(iter([batch, batch.slice(0, 0), batch.slice(3, 2)]), 1, most))
        assert [x for p in found for x in p.column(1).to_pylist()] == texts + texts[3:5]
        assert all(p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column(1).to_pylist()) <= most for p in found)
