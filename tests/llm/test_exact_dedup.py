from pathlib import Path

import pyarrow as pa
import pytest

from lintel.llm import exact_dedup
from lintel.session import shared_dir
from tests.llm.helpers import DOCS, awkward, clashing, empty, rows


def check(spark, docs, **how):
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    got = rows(exact_dedup.exact_duplicates(df, **how))
    least, number = {}, {}
    for d in docs:
        number[d[1]] = number.get(d[1], 0) + 1
        if d[0] is not None and (least.get(d[1]) is None or d[0] < least[d[1]]):
            least[d[1]] = d[0]
    assert [(a, b, n) for a, b, _, n in got] == sorted(((d[0], least.get(d[1]), number[d[1]] - 1) for d in docs), key=repr)
    assert sum(not dup for *_, dup, _ in got) == len(number)
    assert all(a == b for a, b, dup, _ in got if not dup)
    kept = rows(exact_dedup.dedup(df, **how))
    assert [(d[0], d[1]) for d in kept] == sorted(((least.get(c), c) for c in number), key=repr)
    assert set(kept) <= set(docs)
    assert not list(Path(shared_dir(spark).removeprefix("file:")).glob("grace/spill/*"))


@pytest.mark.parametrize("table_bytes", [1 << 24, 2000, 1])
@pytest.mark.parametrize("bits", [1, 3])
def test_against_brute_force(spark, table_bytes, bits):
    docs = [(1000 - i, f"text {i % 37} " * (i % 11), "en", "s", 0) for i in range(700)] + [(7, None, "en", "s", 0), (3, None, "en", "s", 0), (None, "text", "en", "s", 0), (None, "text", "en", "s", 0)]
    docs += [(9, "A", "en", "s", 0), (10, "A", "en", "s", 1), (10, "B", "en", "s", 0), (None, "A", "en", "s", 0), (-5, "a", "en", "s", 0), (-5, "a", "en", "s", 0)]
    check(spark, docs, table_bytes=table_bytes, fanout_bits=bits)


def test_many_copies_and_others_in_one_bucket(spark):
    docs = [(i, "same " * 50, "en", "s", 0) for i in range(3000)] + [(10_000 + i, f"other {i} " * 20, "en", "s", 0) for i in range(500)] + [(20_000 + i, "same " * 50, "en", "s", 0) for i in range(1500)]
    check(spark, docs, table_bytes=4000)


def test_table_tells_contents_with_one_hash_apart():
    t = exact_dedup.ContentTable(4)
    assert [t.add(5, b"a", 9), t.add(5, b"b", 8), t.add(5, b"a", 7), t.add(9, b"c", None), t.add(13, b"d", 1)] == [0, 1, 0, 2, 3]
    assert t.least == [7, 8, None, 1]
    for i in range(100):
        t.add(i, str(i).encode(), i)
    assert t.add(5, b"b", 0) == 1


def test_spill_files_go_when_a_task_is_stopped(tmp_path):
    def records():
        for k in range(20):
            yield pa.RecordBatch.from_arrays([pa.array([k * 7, k * 13 + 1]), pa.array([k, 100 + k]), pa.array([1, 2]), pa.array([1, 1]), pa.array([b"x" * 50, b"%d" % k * 50], pa.large_binary())], schema=exact_dedup._RECORD)
        if stop:
            raise RuntimeError("stopped")

    for stop in (True, False):
        made = exact_dedup.grace(records, str(tmp_path / "s"), 200, 2)
        if stop:
            with pytest.raises(RuntimeError):
                list(made)
        else:
            next(made)
            made.close()
        assert not list((tmp_path / "s").glob("*"))


def test_awkward(spark):
    got = rows(exact_dedup.exact_duplicates(awkward(spark)))
    assert len(got) == 8 and [dup for a, _, dup, _ in got if a == 1] == [False, True]
    assert rows(exact_dedup.exact_duplicates(empty(spark))) == []
    kept = rows(exact_dedup.dedup(awkward(spark)))
    assert kept == sorted(set(map(tuple, awkward(spark).collect())), key=repr)
    assert rows(exact_dedup.dedup(clashing(spark))) == rows(clashing(spark))
    assert rows(exact_dedup.dedup(empty(spark))) == []
