"""The same checks over a stream of files: checks of single files are narrow and run unchanged; counts are kept by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.config import Config
from lintel.operators import checks


def stream_messages(files: DataFrame, config: Config) -> DataFrame:
    """Messages of names, and of contents where there is a column `text`."""
    out = checks.name_messages(files, config)
    return out.unionByName(checks.keyword_messages(files, config)) if "text" in files.columns else out


def windowed_counts(messages: DataFrame, ts: str = "ts", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, test_name, issue_count) by event time; a window is final once the watermark has passed it."""
    grouped = messages.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "test_name").agg(F.count(F.lit(1)).alias("issue_count"))
    return grouped.select(F.col("w.start").alias("start"), "test_name", "issue_count")
