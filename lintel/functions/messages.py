"""Columns over findings: their type, subject, rendering and grouping keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A finding is of the first type whose text it contains.
TYPES = (
    ("File name contains non-ASCII character:", "non-ascii-filename"),
    ("File name contains spaces", "filename-spaces"),
    ("Sensitive data in File? Found suspicious keyword(s):", "sensitive-data"),
    ("Do you have hardcoded filepaths", "hardcoded-paths"),
    ("File or Folder has an invalid name:", "invalid-name"),
    ("File has an invalid suffix:", "invalid-suffix"),
    ("In archived file:", "archived-file-issue"),
)
_INTERNAL = r"Do you have (\w+) internal information"
_TITLES = {
    "IsFreeOfKeywords": "Possible sensitive content detected",
    "HasValidFileName": "File name issues",
    "HasValidNameLength": "File name too long",
    "IsFreeOfSpecialChars": "Special characters in file name",
    "IsFreeOfLeadingTrailingSpaces": "Leading or trailing spaces in file name",
    "HasOnlyASCIIChars": "Non-ASCII characters in file name",
    "HasReadMe": "Missing README file",
    "HasValidTOCTree": "Table of contents issues",
    "HasNoInvalidFileNames": "Invalid file names in archive",
    "HasNoEmptyFolders": "Empty folders in archive",
    "HasNoHiddenFiles": "Hidden files in archive",
}


def message_type(content: Column) -> Column:
    """A label for alike findings; for others their first 50 bytes (whole characters)."""
    first_50 = F.make_valid_utf8(F.substring(F.encode(content, "UTF-8"), 1, 50).cast("string"))
    out = F.when(F.octet_length(content) > 50, F.regexp_replace(first_50, "�+$", "")).otherwise(content)
    for part, label in reversed(TYPES[3:]):
        out = F.when(F.contains(content, F.lit(part)), F.lit(label)).otherwise(out)
    out = F.when(content.rlike(_INTERNAL), F.concat(F.lower(F.regexp_extract(content, _INTERNAL, 1)), F.lit("-internal"))).otherwise(out)
    for part, label in reversed(TYPES[:3]):
        out = F.when(F.contains(content, F.lit(part)), F.lit(label)).otherwise(out)
    return out


def shown_name() -> Column:
    return F.coalesce(F.nullif("display_name", F.lit("")), F.col("name"))


def subject_key() -> Column:
    """`archive > name` for members, the shown name for files, `repository` for packages."""
    inside = F.concat(F.nullif("archive_name", F.lit("")), F.lit(" > "), shown_name())
    return F.when(F.col("source_kind") == "file", F.coalesce(inside, shown_name())).otherwise("repository")


def formatted() -> Column:
    """A finding as a line."""
    return (
        F.when(F.col("source_kind") == "file", F.concat(F.lit("- File issue in '"), subject_key(), F.lit("': "), F.col("content")))
        .when(F.col("source_kind") == "repository", F.concat(F.lit("- Repository issue: "), F.col("content")))
        .otherwise(F.concat(F.lit("- Unknown source issue: "), F.col("content")))
    )


def parent_path(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/", 1)


def message_key(message: Column) -> Column:
    """A finding without the values that it quotes at its end."""
    single, double = F.instr(message, F.lit(" '")), F.instr(message, F.lit(' "'))
    cut = lambda mark: F.trim(F.substring_index(message, mark, 1))
    return F.when(single > 0, cut(" '")).when(double > 0, cut(' "')).otherwise(message)


def group_title(parent: Column, key: Column) -> Column:
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return (
        F.when((parent != "") & (key != ""), F.concat_ws(" with ", q(parent), q(key)))
        .when(parent != "", q(parent))
        .when(key != "", q(key))
        .otherwise("similar issues")
    )


def issue_line(subject: Column, archive: Column, message: Column) -> Column:
    """`  - archive -> member: message`, `  - Repository: message` or `  - file: message`; a message that is the subject is not repeated."""
    inside = F.nullif(archive, F.lit("")).isNotNull()
    own = F.when(inside, F.concat(archive, F.lit(" -> "), subject)).when(subject.isin("", "Repository"), "Repository").otherwise(subject)
    said = F.when((message == "") | (message == F.when(inside, archive).otherwise(subject)), F.lit("")).otherwise(F.concat(F.lit(": "), message))
    return F.concat(F.lit("  - "), own, said)


def title(check: Column) -> Column:
    pairs = [F.lit(x) for item in _TITLES.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), check), check)


def shortened(content: Column, limit: int = 80) -> Column:
    """Content of more than `limit` bytes is cut, at a character, and given dots."""
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(content, "UTF-8"), 1, limit - 3).cast("string")), "�+$", "")
    return F.when(F.octet_length(content) > limit, F.concat(cut, F.lit("..."))).otherwise(content)
