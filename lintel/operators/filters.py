"""Which rows a check looks at."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.config import Config

#: Constructs that RE2 spells otherwise than java.util.regex, and their translation.
_TRANSLATED = ((re.compile(r"\(\?P<"), "(?<"), (re.compile(r"\[\[:(\^?)(\w+):\]\]"), None))
_POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space", "punct": "Punct", "xdigit": "XDigit", "cntrl": "Cntrl", "print": "Print", "graph": "Graph", "blank": "Blank"}


def java_pattern(patterns: Sequence[str]) -> str | None:
    """The patterns as one alternative for rlike; None, with a warning, if they cannot be read.

    RE2's named groups and POSIX classes are translated; look-around and back-references, which RE2
    does not have, are refused.
    """
    joined = "|".join(patterns)
    joined = _TRANSLATED[0][0].sub(_TRANSLATED[0][1], joined)
    joined = re.sub(r"\[\[:(\^?)(\w+):\]\]", lambda m: (r"\P{" if m[1] else r"\p{") + _POSIX.get(m[2], "Alpha") + "}", joined)
    try:
        if re.search(r"\(\?(?:[=!>]|<[=!])|\\[1-9]", joined):
            raise re.error("look-around and back-references are not supported")
        re.compile(re.sub(r"\\[pP]\{\w+\}", "x", joined.replace("(?<", "(?P<")).replace(r"\z", r"\Z"))
    except re.error as e:
        warnings.warn(f"invalid regular expression '{'|'.join(patterns)}': {e}", stacklevel=2)
        return None
    return joined


def matches(name: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern is found anywhere in the name; false without patterns, and for patterns that cannot be read."""
    if not patterns or (p := java_pattern(patterns)) is None:
        return F.lit(False)
    return name.rlike(p)


def wanted(config: Config, check: str, name: Column) -> Column:
    """The whitelist decides where it has entries, else the blacklist; a check without a section looks at everything."""
    test = config.test(check)
    if test.whitelist:
        return matches(name, test.whitelist)
    if test.blacklist:
        return ~matches(name, test.blacklist)
    return F.lit(True)


def for_check(files: DataFrame, config: Config, check: str) -> DataFrame:
    return files.where(wanted(config, check, F.col("name")))


def small_enough(size: Column, limit: int) -> Column:
    return size <= F.lit(limit)


def skipped_by_size(files: DataFrame, limit: int) -> DataFrame:
    """Rows for the report of what was not looked into."""
    return files.where(~small_enough(F.col("size"), limit)).select(F.col("name").alias("filename"), "path", F.lit("File too large for content scanning").alias("reason"))
