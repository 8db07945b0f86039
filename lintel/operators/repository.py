"""Checks of whole packages; each takes any number of packages at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.functions import names


def _messages(df: DataFrame, test: str) -> DataFrame:
    null = lambda c: F.lit(None).cast("string").alias(c)
    return df.select(F.lit(test).alias("test_name"), "content", F.lit("repository").alias("source_kind"), null("path"), null("name"), null("display_name"), null("archive_name"))


def packages_without_readme(files: DataFrame, package: str = "package_id") -> DataFrame:
    """(package, content) for each package none of whose files is a readme."""
    readmes = files.where(names.is_readme(F.col("name"))).select(F.col(package).alias("__p"))
    every = files.select(package).distinct()
    return every.join(readmes, F.col(package).eqNullSafe(F.col("__p")), "left_anti").select(package, F.lit("No ReadMe file in repository.").alias("content"))


def missing_from_contents(files: DataFrame, package: str = "package_id", order: str = "ord", text: str = "text") -> DataFrame:
    """(package, content) for each package whose readme does not name all files, a file being named by its name without extension.

    Of several readmes the last counts. A package without a readme, or whose readme cannot be read
    (null text), gives nothing.
    """
    is_readme = names.is_readme(F.col("name"))
    readme = files.where(is_readme).groupBy(F.col(package).alias("__p")).agg(F.max_by(text, order).alias("__readme"))
    others = files.where(~is_readme).join(readme, F.col(package).eqNullSafe(F.col("__p")))
    absent = others.where(~F.contains("__readme", names.stem(F.col("name"))))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("name").alias("n")))), lambda x: F.concat(F.lit("'"), x.n, F.lit("'")))
    grouped = absent.groupBy(package).agg(F.array_join(listed, ", ").alias("__l"))
    return grouped.select(package, F.concat(F.lit("ReadMe file is missing a complete table of contents for this repository. Missing files are: "), "__l").alias("content"))


def has_readme(files: DataFrame, package: str = "package_id") -> DataFrame:
    return _messages(packages_without_readme(files, package), "HasReadme")


def readme_contents(files: DataFrame, package: str = "package_id", order: str = "ord", text: str = "text") -> DataFrame:
    return _messages(missing_from_contents(files, package, order, text), "ReadMeContainsTOC")
