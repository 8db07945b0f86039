"""Columns that look into contents: is it text, and which keywords are in it."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_BYTES = 8192
SNIFF_BYTES = 512
TEXT_SUFFIXES = tuple("." + x for x in "bat c conf config cpp css csv go h html ini java js json log md php pl properties ps1 py rb sh sql toml txt xml yaml yml".split())
#: Tags that begin an HTML text, after white space, for the sniffing that browsers do.
_TAGS = "!doctype html|html|head|script|iframe|h1|div|font|table|a|style|title|b|body|br|p|!--"


def _latin(content: Column, n: int) -> Column:
    """The first n bytes, a character each."""
    return F.decode(F.substring(content, 1, n), "ISO-8859-1")


def sniffed_text(content: Column) -> Column:
    """Whether MIME sniffing (WHATWG) of the first 512 bytes gives text/*: a byte order mark, an HTML or XML beginning, or no binary byte."""
    s = _latin(content, SNIFF_BYTES)
    bom = s.rlike("^(ï»¿|þÿ|ÿþ)")
    markup = s.rlike(rf"(?i)^[\t\n\f\r ]*<(({_TAGS})[ >]|\?xml)") | s.rlike(r"^[\t\n\f\r ]*<!--")
    other = s.rlike(r"^(%PDF-|%!PS-Adobe-|GIF8[79]a|\u0089PNG|BM|RIFF|PK\x03\x04|Rar!|\x1f\u008b)")
    binary = s.rlike(r"[\x00-\x08\x0b\x0e-\x1a\x1c-\x1f]")
    return bom | markup | (~other & ~binary)


_BOM = re.compile(rb"^(\xef\xbb\xbf|\xfe\xff|\xff\xfe)")
_MARKUP = re.compile(rb"(?i)^[\t\n\f\r ]*<((" + _TAGS.encode() + rb")[ >]|\?xml)|^[\t\n\f\r ]*<!--")
_OTHER = re.compile(rb"^(%PDF-|%!PS-Adobe-|GIF8[79]a|\x89PNG|BM|RIFF|PK\x03\x04|Rar!|\x1f\x8b)")
_BINARY = re.compile(rb"[\x00-\x08\x0b\x0e-\x1a\x1c-\x1f]")


def sniffed_text_bytes(content: bytes) -> bool:
    """sniffed_text where archives are unpacked, member by member."""
    s = content[:SNIFF_BYTES]
    return bool(_BOM.search(s) or _MARKUP.search(s) or not _OTHER.search(s) and not _BINARY.search(s))


def is_text(path: Column, content: Column) -> Column:
    """A known suffix; else an empty content; else no NUL in the first 8 KiB, and sniffed text or 95 % printable bytes."""
    sample = _latin(content, SAMPLE_BYTES)
    n = F.length(sample)
    other = F.length(F.regexp_replace(sample, r"[\t\n\r\x20-\x7e\x80-\xff]", ""))
    by_suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*TEXT_SUFFIXES)
    by_content = (n == 0) | (~F.contains(sample, F.lit("\0")) & (sniffed_text(content) | (n - other >= 0.95 * n)))
    return by_suffix | by_content


def as_text(content: Column) -> Column:
    """Bytes as UTF-8; what is not valid is replaced, so that no keyword's place drifts."""
    return F.make_valid_utf8(content.cast("string"))


def has_bytes(content: Column, pattern: Column) -> Column:
    """Whether the pattern is anywhere in the content, byte by byte; an empty pattern is in all."""
    return F.contains(content.cast("binary"), pattern.cast("binary"))


def keyword_list(joined: str) -> list[str]:
    """`a|b` as keywords."""
    return joined.split("|")


def matched(text: Column, keywords: Sequence[str]) -> Column:
    """The keywords found, as the text first spells them, without repeats, in byte order; keywords are literal and case does not matter."""
    low = F.lower(text)
    spelled = [F.when(F.contains(low, F.lit(k.lower())), F.substring(text, F.instr(low, F.lit(k.lower())), F.lit(len(k)))) for k in dict.fromkeys(keywords) if k]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*spelled)))) if spelled else F.array().cast("array<string>")


def matched_configured(text: Column, keywords: Sequence[str]) -> Column:
    """The keywords found, as they are configured; of spellings that differ in case only, the last."""
    low = F.lower(text)
    last = {k.lower(): k for k in keywords if k}
    found = [F.when(F.contains(low, F.lit(l)), F.lit(k)) for l, k in last.items()]
    return F.array_sort(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")


def any_match(text: Column, keywords: Sequence[str]) -> Column:
    low, out = F.lower(text), F.lit(False)
    for k in keywords:
        if k:
            out = out | F.contains(low, F.lit(k.lower()))
    return out


def listed(found: Column) -> Column:
    """'a', 'b'"""
    return F.concat(F.lit("'"), F.array_join(found, "', '"), F.lit("'"))


def member_wanted_name(name: str, whitelist: Sequence[str], blacklist: Sequence[str]) -> bool:
    """member_wanted where archives are unpacked."""
    hit = lambda parts: any(p.lower() in name.lower() or not name for p in parts)
    return not (blacklist and hit(blacklist)) and not (whitelist and not hit(whitelist))


def member_wanted(name: Column, whitelist: Sequence[str], blacklist: Sequence[str]) -> Column:
    """Archive members are filtered by literal, case-insensitive parts of their name, the blacklist first."""
    low, out = F.lower(name), F.lit(True)

    def hit(parts: Sequence[str]) -> Column:
        any_ = F.lit(False)
        for p in parts:
            any_ = any_ | F.contains(low, F.lit(p.lower())) | (name == "")
        return any_

    if blacklist:
        out = out & ~hit(blacklist)
    if whitelist:
        out = out & hit(whitelist)
    return out
