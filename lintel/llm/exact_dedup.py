"""Grace hash deduplication: records are partitioned to spill files until each bucket fits an open-addressing table of complete contents."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import PRIVATE, checkpointed, shared_dir, ship, sized, tidy, written

#: A table holds contents of up to so many bytes, records and their copies in Python beside it; a larger bucket is partitioned further.
TABLE_BYTES = 4 << 20
#: Buckets that a bucket is partitioned into: 2 to the power of this.
FANOUT_BITS = 3
_RECORD = pa.schema([("h", pa.int64()), ("key", pa.int64()), ("id", pa.int64()), ("rows", pa.int64()), ("content", pa.large_binary())])


class ContentTable:
    """Open addressing with linear probing; slots hold the number of a distinct content, which is compared whole."""

    def __init__(self, slots: int = 1 << 10):
        self.slots = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.least: list[int | None] = []
        self.bytes = 0
        # Of records, which stand for rows: content, key and number of rows; by content the key of the record that stays.
        self.number: list[int] = []
        self.keys: list[int] = []
        self.rows: list[int] = []
        self.stays: list[int] = []

    def add(self, h: int, content: bytes, doc_id: int | None) -> int:
        """The number of the content, new or known; keeps the least non-null id of each content."""
        slots = self.slots
        mask = len(slots) - 1
        at = (h ^ (h >> 31)) & mask
        while (n := slots[at]) >= 0:
            if self.hashes[n] == h and self.contents[n] == content:
                if doc_id is not None and (self.least[n] is None or doc_id < self.least[n]):
                    self.least[n] = doc_id
                return n
            at = (at + 1) & mask
        slots[at] = n = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.least.append(doc_id)
        self.bytes += len(content)
        if 2 * (n + 1) > len(slots):
            self._grow()
        return n

    def record(self, h: int, content: bytes, doc_id: int | None, key: int, rows: int) -> None:
        """A record of `rows` rows. Of a content's records that of the least id stays, of equal ones that of the least key."""
        known = len(self.contents)
        n = self.add(h, content, None)
        if n == known:
            self.stays.append(key)
            self.least[n] = doc_id
        elif (doc_id is None, doc_id or 0, key) < (self.least[n] is None, self.least[n] or 0, self.stays[n]):
            self.least[n], self.stays[n] = doc_id, key
        self.number.append(n)
        self.keys.append(key)
        self.rows.append(rows)

    def _grow(self) -> None:
        slots = [-1] * (2 * len(self.slots))
        mask = len(slots) - 1
        for n, h in enumerate(self.hashes):
            at = (h ^ (h >> 31)) & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = n
        self.slots = slots


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class _Spill:
    """The spill files of one bucket in the shared folder, one to a part."""

    def __init__(self, root: str, parts: int):
        self.fs, path = _filesystem(root)
        self.dir = f"{path}/{uuid.uuid4().hex}"
        self.fs.create_dir(self.dir, recursive=True)
        self.files: list = [None] * parts

    def write(self, batch: pa.RecordBatch, part: np.ndarray) -> None:
        for p in np.unique(part):
            rows = batch.take(pa.array(np.flatnonzero(part == p)))
            if self.files[p] is None:
                sink = self.fs.open_output_stream(f"{self.dir}/{p}")
                self.files[p] = (sink, pa.ipc.new_stream(sink, _RECORD, options=pa.ipc.IpcWriteOptions(compression="lz4")))
            self.files[p][1].write_batch(rows)

    def close(self) -> None:
        for f in self.files:
            if f is not None and not f[0].closed:
                f[1].close()
                f[0].close()

    def read(self):
        """For each part that has records, a function that gives its batches; the file goes when it has been used."""
        self.close()
        for p, f in enumerate(self.files):
            if f is not None:
                path = f"{self.dir}/{p}"

                def batches(path=path):
                    with self.fs.open_input_stream(path) as source, pa.ipc.open_stream(source) as stream:
                        yield from stream

                yield batches
                self.fs.delete_file(path)

    def remove(self) -> None:
        """All files go, also where the task has failed or was stopped midway."""
        try:
            self.close()
        finally:
            if self.fs.get_file_info(self.dir).type != fs.FileType.NotFound:
                self.fs.delete_dir(self.dir)


def _groups(table: ContentTable) -> pa.RecordBatch:
    """For each record in the table its group: the least id, the key of the record that stays, and how many rows there are."""
    number = np.array(table.number, np.int64)
    key, rows = np.array(table.keys, np.int64), np.array(table.rows, np.int64)
    total = np.bincount(number, rows, len(table.contents)).astype(np.int64) if len(number) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(table.least, pa.int64()).take(pa.array(number)), pa.array(np.array(table.stays, np.int64)[number] if len(number) else number), pa.array(total[number])], names=_GROUP)


_GROUP = ["key", "group_id", "stays", "rows"]


def _filled(table: ContentTable, batch: pa.RecordBatch) -> None:
    for h, key, doc_id, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        table.record(h, text, doc_id, key, n)


def grace(batches, root: str, table_bytes: int, bits: int, level: int = 0):
    """Groups of one bucket's records. They are held until they exceed the table; then they are partitioned by the next bits of the hash.

    Records of one hash can't be partitioned: they go to a table that grows with its distinct
    contents only, and the bucket's other records are partitioned. Spill files go in any case.
    """
    shift, mask = level * bits, (1 << bits) - 1
    exhausted = shift + bits > 64
    held, size, single, one = [], 0, True, None
    source = (b for b in batches() if b.num_rows)
    spill = None

    def parts(b: pa.RecordBatch) -> np.ndarray:
        return ((b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(shift)) & np.uint64(mask)).astype(np.int64)

    try:
        for b in source:
            if spill is not None:
                spill.write(b, parts(b))
                continue
            h = b.column(0).to_numpy(zero_copy_only=False)
            one = h[0] if one is None else one
            single = single and bool((h == one).all())
            held.append(b)
            size += b.nbytes
            if size <= table_bytes:
                continue
            if exhausted or single:  # what is in the table takes its room once, however many copies come
                table = ContentTable()
                for x in held:
                    _filled(table, x)
                held = []

                def others(table=table):
                    for x in source:
                        same = np.full(x.num_rows, exhausted) | (x.column(0).to_numpy(zero_copy_only=False) == one)
                        if same.any():
                            _filled(table, x.filter(pa.array(same)))
                        if not same.all():
                            yield x.filter(pa.array(~same))

                yield from grace(others, root, table_bytes, bits, level)
                yield _groups(table)
                return
            spill = _Spill(root, mask + 1)
            for x in held:
                spill.write(x, parts(x))
            held = []
        if spill is None:
            table = ContentTable()
            for x in held:
                _filled(table, x)
            del held
            if table.contents:
                yield _groups(table)
        else:
            for part in spill.read():
                yield from grace(part, root, table_bytes, bits, level + 1)
    finally:
        if spill is not None:
            spill.remove()


_LOCAL = "doc_id long, row long, key long, h long, least long, copies long, content binary"


def _folded(rows: DataFrame, table_bytes: int) -> DataFrame:
    """Each row with the key of its content within its task; the first of a task's copies (of the least id) carries content, hash and their number.

    So a content is shipped once a task, however many copies the task has. A task's table is
    emptied when it is full: copies further apart are found later, like those of other tasks.
    """

    def run(batches):
        none = b"\xff\xfenull"  # no UTF-8 text
        base, count = TaskContext.get().partitionId() << 36, 0
        table, ids, own, number = ContentTable(), [], [], []

        def flush():
            nonlocal count, table, ids, own, number
            if not ids:
                return
            doc_id, row, at = pa.concat_arrays(ids), pa.concat_arrays(own), np.concatenate(number)
            least = pa.array(table.least, pa.int64())
            hit = pc.or_(pc.fill_null(pc.equal(doc_id, least.take(pa.array(at))), False), pc.is_null(least.take(pa.array(at)))).to_numpy(zero_copy_only=False)
            hits = np.flatnonzero(hit)
            lead = hits[np.unique(at[hits], return_index=True)[1]]  # a row for each content, in order of content
            blank = lambda values, kind: pa.array(values, kind)
            place = np.full(len(at), -1)
            place[lead] = np.arange(len(lead))
            take = pa.array(np.where(place < 0, 0, place), mask=place < 0)
            h, n = blank(table.hashes, pa.int64()), blank(np.bincount(at, minlength=len(lead)), pa.int64())
            contents = blank(table.contents, pa.binary())
            for k in range(0, len(at), 4096):
                some = take.slice(k, 4096)
                yield pa.RecordBatch.from_arrays([doc_id.slice(k, 4096), row.slice(k, 4096), pa.array(base + count + at[k : k + 4096]), h.take(some), least.take(some), n.take(some), contents.take(some)], names=["doc_id", "row", "key", "h", "least", "copies", "content"])
            count += len(lead)
            table, ids, own, number = ContentTable(), [], [], []

        for b in batches:
            content = pc.fill_null(b.column(3).cast(pa.string()).cast(pa.binary()), none)
            for k in range(0, b.num_rows, 512):
                h, i, r, c = (x.slice(k, 512) for x in (b.column(2), b.column(0), b.column(1), content))
                number.append(np.fromiter(map(table.add, h.to_pylist(), c.to_pylist(), i.to_pylist()), np.int64, len(h)))
                ids.append(i)
                own.append(r)
                if table.bytes > table_bytes or len(ids) > 2048:
                    yield from flush()
        yield from flush()
        tidy()

    return rows.mapInArrow(run, _LOCAL)


def _duplicates(docs: DataFrame, doc_id: str, text: str, row, table_bytes: int, fanout_bits: int) -> DataFrame:
    """(doc_id, row, group_id, is_duplicate, n_links) for every row; row is a column of numbers of the caller's."""
    spark = docs.sparkSession
    ship(spark)
    root = f"{shared_dir(spark)}/grace"
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row.cast("long").alias("row"), h.alias("h"), F.col(text).cast("string").alias("text"))
    local = written(_folded(rows, table_bytes), "exact")

    def run(batches):
        def records():
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    part = b.slice(at, 512)
                    yield pa.RecordBatch.from_arrays([*part.columns[:4], part.column(4).cast(pa.large_binary())], schema=_RECORD)

        for found in grace(records, os.path.join(root, "spill"), table_bytes, fanout_bits):
            for at in range(0, found.num_rows, 4096):
                yield found.slice(at, 4096)
        tidy()

    leads = local.where("content is not null").select("h", "key", F.col("least").alias("id"), "copies", "content")
    groups = leads.repartition("h").mapInArrow(run, "key long, group_id long, stays long, rows long")
    # A key is of one task's rows: no key has more of them, so the join has no hot one.
    joined = local.select("doc_id", "row", "key", F.col("content").isNotNull().alias("lead")).join(groups.withColumnRenamed("key", "k"), F.col("key") == F.col("k"))
    return joined.select("doc_id", "row", "group_id", (~(F.col("lead") & (F.col("stays") == F.col("key")))).alias("is_duplicate"), (F.col("rows") - 1).alias("n_links"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES, fanout_bits: int = FANOUT_BITS) -> DataFrame:
    """(doc_id, group_id, is_duplicate, n_links) for every row of docs: group_id is the least doc_id with the very same text, n_links the number of other rows with it.

    One row of each group is no duplicate, that of the least doc_id; where rows repeat that doc_id,
    one of them. Null texts are equal to each other and to no other text, the empty one included;
    null ids are never the least, unless the whole group's are null. Other columns are ignored. An
    empty table gives an empty one.

    Each task first puts its own rows' contents into an open-addressing table, so that a content is
    shipped once a task. What is left is partitioned by a 64-bit hash: first by Spark's shuffle,
    which balances buckets, then each bucket beyond `table_bytes` by the hash's next bits to spill
    files in the shared folder, and so on until it fits the table. Contents are compared whole.
    """
    return _duplicates(docs, doc_id, text, F.lit(0), table_bytes, fanout_bits).drop("row")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES, fanout_bits: int = FANOUT_BITS) -> DataFrame:
    """docs, columns as they are, with exactly one row for each content, that of the least doc_id (see exact_duplicates).

    Rows are told apart by numbers of their own, not by doc_id: a doc_id with several contents
    keeps all of them, and repeated rows and null ids give one row a content.
    """
    row, gone = f"{PRIVATE}row", f"{PRIVATE}gone"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    twice = checkpointed(_duplicates(numbered, doc_id, text, F.col(row), table_bytes, fanout_bits).where("is_duplicate").select(F.col("row").alias(gone)))
    return numbered.join(sized(twice), F.col(row) == F.col(gone), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = """
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS group_id, doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_duplicate, count(*) OVER (PARTITION BY text) - 1 AS n_links FROM documents
"""
