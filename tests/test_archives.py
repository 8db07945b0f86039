"""Packing and listing of archives hold little at a time, whatever comes in; odd keys."""

import io
import tarfile
import tracemalloc

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lintel.plans import queries
from lintel.sources.archive_readers import read_members

SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def table_of(folder, rows) -> str:
    pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA), folder / "conversations.parquet")
    return str(folder)


@pytest.fixture
def steps(spark, monkeypatch):
    """(input, function) of each mapInArrow that is planned."""
    kind, found = type(spark.range(1)), []
    own = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **k: found.append((self, f)) or own(self, f, *a, **k))
    return found


def peak_of(f, batches):
    """(rows, bytes of the largest batch, bytes that Python and Arrow held at most beside the input) of what f hands on."""
    rows, largest, before, most = 0, 0, pa.total_allocated_bytes(), 0
    tracemalloc.start()
    for b in f(iter(batches)):
        rows, largest, most = rows + b.num_rows, max(largest, b.nbytes), max(most, pa.total_allocated_bytes() - before)
    most += tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, largest, most


def test_packing_holds_one_batch_however_many_archives(spark, tmp_path, steps):
    folder = table_of(tmp_path, [(3 * k + 1, t, "user", f"{k} {t} " + "x" * 5000) for k in range(3000) for t in range(2)])
    queries._conversation_archives(spark, folder)
    rows, f = steps[0]
    rows, largest, most = peak_of(f, rows.toArrow().combine_chunks().to_batches())
    assert rows == 3000 and largest < 2 << 20 and most < 12 << 20  # 60 MB of tar archives


def test_listing_holds_few_members(spark, steps):
    data, n = io.BytesIO(), 40_000
    with tarfile.open(fileobj=data, mode="w:gz") as t:
        for k in range(n):
            t.addfile(tarfile.TarInfo(f"{k}.txt"))
    data = data.getvalue()
    archives = spark.createDataFrame([(x, x, x, c) for x, c in (("a.tar.gz", data), ("bad.tar.gz", b"\xff" * 100))], "path string, name string, display_name string, content binary")
    got = read_members(archives).select("archive_path", "ord", "member", "error").collect()
    whole = [r for r in got if r["archive_path"] == "a.tar.gz"]
    assert [(r["ord"], r["member"]) for r in whole] == [(k, f"{k}.txt") for k in range(n)]
    assert [(r["ord"], r["error"] is None) for r in got if r["archive_path"] == "bad.tar.gz"] == [(-1, False)]
    rows, _, most = peak_of(steps[0][1], archives.where("name = 'a.tar.gz'").toArrow().to_batches())
    assert rows == n and most < 8 << 20


@pytest.mark.parametrize("query", ["archive_listing", "archive_contents"])
def test_odd_ids_and_turns(spark, tmp_path, query):
    keys = (-6, -5, -4, -2, -1, 0, 1, 2, 3, 1 << 40, None)
    folder = table_of(tmp_path, [(k, t, role, f"{k} {t} {role}" * n) for k in keys for t, role, n in ((2, "user", 1), (1, "user", 0), (1, "user", 3), (1, "bot", 40), (10, "user", 2))])
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    answer = db.execute(queries.SQL[query])
    columns = [d[0] for d in answer.description]
    got = queries.QUERIES[query](spark, folder).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(answer.fetchall(), key=repr)
