import numpy as np
import pyarrow as pa

from veilspark.llm import textbytes as T


def test_slices_and_tables_that_workers_keep_are_small():
    batch = pa.RecordBatch.from_arrays([pa.array(["a b " * 25_000] * 40)], names=["text"])
    parts = [*T.slices(iter([batch]), "text")]
    assert sum(p.num_rows for p in parts) == 40
    T._powers.clear()
    for part in parts:
        data, offsets = T.texts_of(part.column("text"))
        assert len(data) <= 1 << 20
        T.span_hashes(data, offsets[:-1], offsets[1:])
    assert sum(t.nbytes for t in T._powers.values()) < 20 << 20
    assert np.all(offsets == np.arange(len(offsets)) * 100_000)
