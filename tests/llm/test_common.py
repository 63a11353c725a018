import pyarrow as pa

from weft.llm.common import fresh, grouped, narrow


def batches(rows, each):
    return [pa.RecordBatch.from_pydict({"g": pa.array([g for g, _ in rows[a : a + each]], pa.int64()), "x": pa.array([x for _, x in rows[a : a + each]], pa.binary())}) for a in range(0, len(rows), each)]


def test_groups_stay_whole_and_no_row_is_lost():
    rows = [(g, bytes([g]) * k) for g in range(7) for k in range(1 + g * g)]
    for each in (1, 2, 3, 10, 1000):
        got = list(grouped(iter(batches(rows, each)), "g"))
        assert [(g, x) for b in got for g, x in zip(b.column("g").to_pylist(), b.column("x").to_pylist())] == rows
        seen = [set(b.column("g").to_pylist()) for b in got]
        assert sum(map(len, seen)) == 7  # no group is in two batches


def test_a_group_is_one_batch_with_wide_offsets():
    """With offsets of 32 bits pyarrow deals a group of over 2 GiB to several batches; with 64 it can't."""
    (got,) = grouped(iter(batches([(1, b"x" * 1000)] * 50, 10)), "g")
    assert got.num_rows == 50 and got.schema.field("x").type == pa.large_binary()
    small = batches([(1, b"x")], 1)[0].schema
    parts = list(narrow(got, small, 20))
    assert [p.num_rows for p in parts] == [20, 20, 10] and all(p.schema == small for p in parts)


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "rid int, _rid int")
    assert fresh(df, "rid", "RID", "x") == ["__rid", "__RID", "x"]
