"""What the operators of this subpackage share: the shared folder, sized joins, word splitting."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.session import shared_dir, ship

__all__ = ["shared_dir", "ship"]

#: Columns that an operator adds to a caller's rows for a while start so; no caller's column should.
PRIVATE = "__lt_"
#: A side of a join is broadcast up to so many bytes, as measured, and shuffled beyond.
BROADCAST_BYTES = 16 << 20
#: Texts are handled in Python in slices of about so many bytes.
SLICE_BYTES = 2 << 20
#: Cut off both ends of a word before it is hashed.
EDGES = ".,;:!?\"'()[]{}<>*#%&@$^~`|\\/+=-_«»„“”‘’…–—¿¡·"


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder, its lineage cut; survives the loss of executors."""
    ship(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, where it stays: what reads only some of its columns reads no others."""
    path = fresh_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def delete_dir(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def bytes_of(df: DataFrame, *columns: str) -> int:
    """What the rows of df take, by measuring: the given string or binary columns, and 16 bytes for each other."""
    other = 16 * (len(df.columns) - len(columns))
    size = F.lit(other)
    for c in columns:
        size = size + F.coalesce(F.octet_length(c), F.lit(0))
    return df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]


def sized(df: DataFrame, *columns: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its measured size allows; otherwise Spark shuffles both sides (AQE splits skewed keys)."""
    return F.broadcast(df) if bytes_of(df, *columns) <= limit else df.hint("merge")


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(start, slice) of a text array, each of about `most` bytes; a longer text is a slice by itself."""
    if len(texts) == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def tidy() -> None:
    """Give memory that is free back to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(offsets, codes, vocabulary): the words of text i are vocabulary[codes[offsets[i]:offsets[i + 1]]].

    Words are split at white space, made lower case and cut of punctuation at both ends; what is
    then empty is dropped. A null text has no words.
    """
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    coded = pc.dictionary_encode(lists.flatten())
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    plain = pc.dictionary_encode(pc.utf8_trim(pc.utf8_lower(coded.dictionary), EDGES))
    vocabulary = plain.dictionary.to_pylist()
    codes = plain.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes] if len(codes) else codes
    if "" in (gone := set(vocabulary) & {""}):
        keep = codes != vocabulary.index("")
        before = np.concatenate([[0], np.cumsum(keep)])
        offsets, codes = before[offsets], codes[keep]
        del gone
    return offsets, codes, vocabulary


def hash64(words: list[str], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def one_row_each(docs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """docs with one row for each non-null key: of rows that repeat a key, the first by `order`.

    Only repeated keys are shuffled with their rows.
    """
    n = f"{PRIVATE}n"
    again = docs.groupBy(F.col(key).alias(f"{PRIVATE}key")).agg(F.count(F.lit(1)).alias(n)).where(f"{n} > 1 and {PRIVATE}key is not null").select(f"{PRIVATE}key")
    again = checkpointed(again)
    if not again.take(1):
        return docs
    from pyspark.sql import Window

    hit = docs[key] == F.col(f"{PRIVATE}key")
    side = sized(again)
    first = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    repeated = docs.join(side, hit, "left_semi").withColumn(n, F.row_number().over(first)).where(f"{n} = 1").drop(n)
    return docs.join(side, hit, "left_anti").unionByName(repeated)
