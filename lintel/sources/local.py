"""A folder as a table. Spark's own listing hides dotfiles, names that begin with an underscore and empty files, which a linter is after."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import PurePath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lintel.model import suffix_of, with_derived
from lintel.session import ship

LISTING = "path string, name string, size bigint, is_dir boolean"
#: Files of more bytes are read by chunks, but for those that must be whole to be read at all.
CHUNK_BYTES, OVERLAP_BYTES = 1 << 20, 2 << 10
#: Of others as many are read as tell whether they are text.
SAMPLE_BYTES = 8192
#: Texts of more bytes are not read.
MOST_BYTES = 2 << 30
_WHOLE = (".7z", ".gz", ".tar", ".zip", ".xlsx", ".docx")


def content_of(path: str, largest: int, chunk: int = CHUNK_BYTES) -> tuple[bytes | None, bool]:
    """(content, whether it is whole): up to `chunk` bytes, an archive, office file or readme up to `largest`; of a larger file the beginning, of one over `largest`, or that cannot be read, nothing."""
    try:
        size = os.path.getsize(path)
        if size > largest:
            return None, False
        with open(path, "rb") as f:
            whole = size <= chunk or path.lower().endswith(_WHOLE) or os.path.basename(path).lower() in ("readme.md", "readme.txt")
            return (f.read() if whole else f.read(SAMPLE_BYTES)), whole
    except OSError:
        return None, False


class InvalidPath(ValueError):
    """A path that leads upwards."""


def validate_path(path: str) -> tuple[str, list[str]]:
    """The clean path, and warnings; a path with `..` left in it is refused, an absolute one warned of."""
    clean = os.path.normpath(path)
    if ".." in clean:
        raise InvalidPath(f"invalid path: '{path}' contains '..'")
    return clean, [f"Using an absolute path: '{clean}'"] if os.path.isabs(clean) else []


class _Slice(InputPartition):
    def __init__(self, entries: list[tuple[str, int, bool]]):
        super().__init__(None)
        self.entries = entries


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.recursive = options.get("recursive", "false") == "true"
        self.slice_bytes = int(options.get("slicebytes", 64 << 20))

    def _walk(self) -> Iterator[tuple[str, int, bool]]:
        """Entries in lexical order, a folder before what is in it; without `recursive` the top level's files only."""

        def visit(folder: str) -> Iterator[tuple[str, int, bool]]:
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError:
                return
            for e in entries:
                is_dir = e.is_dir(follow_symlinks=False)
                if is_dir and not self.recursive:
                    continue
                try:
                    size = e.stat().st_size
                except OSError:
                    size = 0
                yield os.path.join(folder, e.name), size, is_dir
                if is_dir:
                    yield from visit(e.path)

        yield from visit(self.root)

    def partitions(self) -> list[_Slice]:
        out: list[_Slice] = [_Slice([])]
        held = 0
        for e in self._walk():
            if out[-1].entries and (held + e[1] > self.slice_bytes or len(out[-1].entries) >= 10_000):
                out.append(_Slice([]))
                held = 0
            out[-1].entries.append(e)
            held += e[1]
        return out

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for path, size, is_dir in partition.entries:
            yield path, PurePath(path).name, size, is_dir


def with_content(files: DataFrame, largest: int) -> DataFrame:
    """files with `content` and whether it is `whole` (see content_of), read from their paths, which all executors see; null for folders and where nothing can be read.

    The column is an expression: a plan that does not use it does not read the files.
    """
    ship(files.sparkSession)

    @F.arrow_udf("struct<content:binary,whole:boolean>")
    def read(path: pa.Array) -> pa.Array:
        got = [(None, False) if p is None else content_of(p, largest) for p in path.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([c for c, _ in got], pa.binary()), pa.array([w for _, w in got], pa.bool_())], ["content", "whole"])

    is_dir = F.coalesce("is_dir", F.lit(False)) if "is_dir" in files.columns else F.lit(False)
    got = read(F.when(~is_dir, F.col("path")))
    return files.withColumn("content", got["content"]).withColumn("whole", got["whole"])


def measured(files: DataFrame) -> DataFrame:
    """files with the sizes that files at their paths have; the given size where there is none."""
    ship(files.sparkSession)

    @F.arrow_udf("bigint")
    def size(path: pa.Array) -> pa.Array:
        return pa.array([os.path.getsize(p) if p is not None and os.path.isfile(p) else None for p in path.to_pylist()], pa.int64())

    return files.withColumn("size", F.coalesce(size(F.col("path")), F.col("size")))


class LocalFiles(DataSource):
    """format("lintel_files"): path; recursive ("true"); slicebytes: files of about so many bytes are a partition."""

    @classmethod
    def name(cls) -> str:
        return "lintel_files"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def local_files(spark: SparkSession, path: str, include_folders: bool | str = False, content: bool = False, largest: int = 1 << 30) -> DataFrame:
    """A files table (lintel.model.FILES) of a folder, with `ord` and, if asked for, `content` and whether it is `whole` (see content_of). The folder is one that all executors see."""
    ship(spark)
    clean, _ = validate_path(path)
    spark.dataSource.register(LocalFiles)
    recursive = str(include_folders).lower() == "true"
    rows = spark.read.format("lintel_files").options(path=clean, recursive=str(recursive).lower()).load()
    out = with_derived(rows.withColumn("suffix", suffix_of(F.col("name"))))
    columns = ["path", "name", "display_name", "size", "suffix", "is_archive", "archive_name"]
    out = out.select(*columns, F.monotonically_increasing_id().alias("ord"), "is_dir")
    return with_content(out, largest) if content else out


def text_chunks(files: DataFrame, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES, most: int = MOST_BYTES) -> DataFrame:
    """(path, name, display_name, archive_name, chunk, content, error): files by chunks, each with the last bytes of the one before.

    A file's chunks are rows of their own, so that a large file is many tasks' work and none holds
    more than a chunk. A file of more than `most` bytes, or that cannot be read, gives an error.
    """
    ship(files.sparkSession)

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                part = b.slice(at, 1)
                path, size, k = part.column(0)[0].as_py(), part.column(4)[0].as_py(), part.column(5)[0].as_py()
                content, error = None, None
                try:
                    if size > most:
                        raise OSError(f"file too large: {size} bytes (max {most})")
                    with open(path, "rb") as f:
                        first = max(0, k * chunk - overlap)
                        f.seek(first)
                        content = f.read((k + 1) * chunk - first)
                except OSError as e:
                    error = f"Error streaming file '{path}': {e}"
                yield pa.RecordBatch.from_arrays([*part.columns[:4], part.column(5), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["path", "name", "display_name", "archive_name", "chunk", "content", "error"])

    files = measured(files.select("path", "name", "display_name", "archive_name", "size"))
    last = F.when(F.col("size") > most, F.lit(0)).otherwise(F.floor((F.greatest(F.col("size"), F.lit(1)) - 1) / chunk))
    rows = files.select("path", "name", "display_name", "archive_name", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("chunk"))
    return rows.repartition(F.hash("path", "chunk")).mapInArrow(run, "path string, name string, display_name string, archive_name string, chunk bigint, content binary, error string")
