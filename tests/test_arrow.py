import pyarrow as pa

from folioframe.functions.arrow import by_size


def test_batches_are_cut_by_size():
    texts = ["a" * 10, None, "", "b" * 100, "c" * 5, "d" * 6]
    batch = pa.record_batch({"k": list(range(6)), "t": texts})
    got = list(by_size(iter([batch, batch.slice(3, 2), batch.slice(0, 0)]), 1, most=12))
    assert [g.column(0).to_pylist() for g in got] == [[0, 1, 2], [3], [4, 5], [3], [4], []]
    assert len(list(by_size(iter([batch]), 1))) == 1
