"""Batches in pieces."""

import pyarrow as pa

from siftmark.sources.shared import pieces


def test_pieces_are_small_and_whole():
    b = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x" * (i % 300) for i in range(1000)])], ["i", "t"])
    got = list(pieces(b, 5000))
    assert [i for p in got for i in p.column(0).to_pylist()] == list(range(1000)) and len(got) > 20
    assert all(p.nbytes <= 5000 or p.num_rows == 1 for p in got)
    assert [p.num_rows for p in pieces(b.slice(0, 0))] == [0] and len(list(pieces(b, 1))) == 1000
