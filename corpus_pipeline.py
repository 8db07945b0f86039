"""A corpus made ready for training: toxic documents out, boilerplate lines out, one of each group of near copies, packed sequences.

Rows of documents that no stage has a reason to drop go through all of them: null and empty texts
are not toxic, have no lines, are near to nothing, and are packed as pieces of size 0 without a bin;
null ids stay. Rows that repeat a doc_id are scored and cut each, and one of them stays as near
copies of each other do. Columns beside those of documents are carried along to the packing, which
gives its own. Very long texts are handled whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lintel.llm.common import delete_dir, fresh_dir
from lintel.llm.line_dedup import dedup_lines
from lintel.llm.packing import pack
from lintel.llm.simhash import dedup
from lintel.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on `labels`, does not reject."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source."""
    return dedup_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return dedup(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, occurrence, piece, start, size, bin) for all pieces of all documents."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the packing; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the documents of sf_dir.

    What each stage keeps is written as Parquet to the shared folder and read again; a stage's
    input goes once its result is there, so that of a run the result alone stays.
    """
    docs, root, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_dir(spark, "pipeline"), None
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete_dir(spark, last)
        last = path
    return docs
