"""Columns that judge file names. Each gives the finding's text, or null."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_NAME_BYTES = 64
#: Characters that a name should not have: control characters and these. The first one is reported.
SPECIAL_CLASS = r"""[\x00-\x1f!"#$%&'()*,;<>?@\[\]^`{}~]"""
_SHORT_ESCAPES = {7: "a", 8: "b", 9: "t", 10: "n", 11: "v", 12: "f", 13: "r"}


def non_ascii(name: Column) -> Column:
    """All characters beyond ASCII, in order, repeated ones too."""
    found = F.regexp_replace(name, r"[\x00-\x7F]", "")
    return F.when(found != "", F.concat(F.lit("File name contains non-ASCII character: "), found))


def white_space(name: Column) -> Column:
    """U+0020 only."""
    return F.when(F.contains(name, F.lit(" ")), F.lit("File name contains spaces."))


def _quoted(c: Column) -> Column:
    """A character in single quotes, as a Go program writes it: control characters and the quote are escaped."""
    escapes = [F.lit(chr(i)) for i in range(32)]
    shown = [F.lit("'\\" + _SHORT_ESCAPES[i] + "'" if i in _SHORT_ESCAPES else f"'\\x{i:02x}'") for i in range(32)]
    table = F.create_map(*[x for pair in zip(escapes, shown, strict=True) for x in pair], F.lit("'"), F.lit("'\\''"))
    return F.coalesce(F.element_at(table, c), F.concat(F.lit("'"), c, F.lit("'")))


def special_characters(name: Column) -> Column:
    found = F.regexp_extract(name, f"({SPECIAL_CLASS})", 1)
    return F.when(found != "", F.concat(F.lit("File name contains invalid character: "), _quoted(found)))


def too_long(name: Column, limit: int = MAX_NAME_BYTES) -> Column:
    """Longer than 64 bytes, not characters."""
    return F.when(F.octet_length(name) > limit, F.lit("File name is too long."))


def _equals(disallowed: str) -> Callable[[Column], Column]:
    return lambda x: F.lower(x) == disallowed.lower()


def invalid_names(name: Column, disallowed: Sequence[str]) -> Column:
    """An array of findings: for each disallowed name one if the last path element equals it but for case, else one if it
    ends with it (case matters); and one for each folder above that equals it but for case."""
    parts = F.split(name, "/")
    base, folders = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    whole = F.concat(F.lit("File or Folder has an invalid name: "), name)
    found = []
    for d in disallowed:
        own = F.when(F.lower(base) == d.lower(), whole).when(F.endswith(base, F.lit(d)), F.concat(F.lit("File has an invalid suffix: "), name))
        found.append(F.array_compact(F.array(own)))
        found.append(F.transform(F.filter(folders, _equals(d)), lambda _: whole))
    return F.concat(*found) if found else F.array().cast("array<string>")


def stem(name: Column) -> Column:
    """A name without its last extension; a dotfile has an empty one."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def is_readme(name: Column) -> Column:
    return F.lower(name).isin("readme.md", "readme.txt")


def is_pdf(name: Column, suffix: Column) -> Column:
    return F.endswith(name, F.lit(".pdf")) | (suffix == ".pdf")


def is_supported_archive(name: Column) -> Column:
    """By case-sensitive suffix; a .gz that is no .tar.gz is an archive that cannot be read."""
    return name.rlike(r"\.(zip|7z|tar|tar\.gz)$")
