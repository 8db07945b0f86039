"""Readers of archives and office files: bytes to rows, in Python over Arrow batches."""

from __future__ import annotations

import io
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.functions import text
from lintel.model import BODIES, MEMBERS
from lintel.session import ship
from lintel.sources import sevenzip

_MEMBER_NAMES = ("archive_path", "archive_name", "archive_label", "ord", "member", "size", "is_dir", "content", "error")
_BATCH_BYTES = 8 << 20
#: Of an archive that is listed so many members are held at once.
_LISTED = 4096
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


@dataclass(frozen=True)
class Gate:
    """Which members' contents are read (see lintel.operators.archives.member_gate), and how many bytes of an archive in all."""

    largest: int = 10 << 20
    budget: int = 100 << 20
    whitelist: tuple[str, ...] = ()
    blacklist: tuple[str, ...] = ()
    only_text: bool = True


class _Budget:
    """What an archive has been charged; members of zip and 7z archives count twice against what was read before."""

    def __init__(self, gate: Gate, name: str):
        self.gate, self.used, self.factor = gate, 0, 2 if name.endswith((".zip", ".7z")) else 1

    def content(self, name: str, size: int, read: Callable[[int], bytes]) -> bytes | None:
        """A member's content if the gate and the budget admit it. Of others no more than the sniffed bytes are unpacked."""
        g = self.gate
        if not 0 < size <= g.largest or not text.member_wanted_name(name, g.whitelist, g.blacklist):
            return None
        head = read(min(size, text.SNIFF_BYTES))
        if g.only_text and not text.sniffed_text_bytes(head):
            return None
        if self.factor * self.used + size > g.budget:
            return None
        self.used += size
        return head + read(size - len(head))


def members_of(data: bytes, name: str, gate: Gate | None) -> Iterator[tuple[str, int, bool, bytes | None, str | None]]:
    """(member, size, is_dir, content, error) in the archive's order, one after another; without a gate contents are not read.

    A member that cannot be read has an error and no content.
    """
    budget = _Budget(gate, name) if gate else None

    def content(member: str, size: int, is_dir: bool, open_: Callable[[], Callable[[int], bytes]]):
        if budget is None or is_dir:
            return None, None
        try:
            return budget.content(member, size, open_()), None
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, zlib.error, lzma.LZMAError, OSError, ValueError) as e:
            return None, f"Error reading member '{member}' of archive '{name}': {e}"

    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                with ExitStack() as stack:
                    yield i.filename, i.file_size, i.is_dir(), *content(i.filename, i.file_size, i.is_dir(), lambda i=i, stack=stack: stack.enter_context(z.open(i)).read)
    elif name.endswith((".tar", ".tar.gz")):
        with tarfile.open(fileobj=io.BytesIO(data), mode="r|gz" if name.endswith(".gz") else "r|", stream=True) as t:  # stream: what it has read it does not keep
            for i in t:
                own = i.name + "/" * (i.isdir() and not i.name.endswith("/"))
                yield own, i.size, i.isdir(), *content(own, i.size, not i.isreg(), lambda i=i: t.extractfile(i).read)
    elif name.endswith(".7z"):
        for member, size, is_dir, read in sevenzip.members(data):
            yield member, size, is_dir, *content(member, size, is_dir or read is None, lambda read=read: read)
    else:
        raise ValueError(f"Unsupported archive type: {name}")


def read_members(archives: DataFrame, gate: Gate | None = None) -> DataFrame:
    """lintel.model.MEMBERS of a files table with `content`; contents of the members that the gate admits, none without a gate.

    Members are handed on as they are unpacked, in batches of a few MB, so that a task holds one
    archive and one batch whatever the archive unpacks to. An archive that cannot be read gives a
    row with `error` where it breaks off, and no other row when only listed; so does a member that
    cannot be read. To tell, an archive of many members is gone through once before they are listed.
    """
    ship(archives.sparkSession)

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                head = (r["path"], r["name"], r["display_name"] or r["name"])
                listed = []
                try:
                    for k, (member, size, is_dir, content, error) in enumerate(members_of(r["content"] or b"", r["name"], gate)):
                        one = (*head, k, member, size, is_dir, content, error)
                        if gate is None:
                            if k < _LISTED:
                                listed.append(one)
                            continue
                        rows.append(one)
                        held += len(content or b"")
                        if len(rows) >= 256 or held > _BATCH_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
                    if len(listed) == _LISTED:
                        for k, one in enumerate(members_of(r["content"] or b"", r["name"], None)):
                            if k % _LISTED == 0 and k:
                                yield _batch(listed)
                                listed = []
                            if k >= _LISTED:
                                listed.append((*head, k, *one))
                except Exception as e:  # noqa: BLE001 - archives of strangers break in many ways
                    listed = [(*head, -1, None, None, None, None, f"Error reading archive '{r['name']}': {e}")]
                rows += listed
                while len(rows) >= 256:
                    yield _batch(rows[:256])
                    rows = rows[256:]
        if rows:
            yield _batch(rows)

    return archives.select("path", "name", "display_name", "content").mapInArrow(run, MEMBERS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(_MEMBER_NAMES))


def _sheets(z: zipfile.ZipFile, have: set[str]) -> list[str]:
    """The sheets' parts in the workbook's order; those it does not name come last, by name."""
    named: list[str] = []
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= have:
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            to = targets.get(sheet.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"), "")
            named.append(to.lstrip("/") if to.startswith("/") else f"xl/{to}")
    rest = sorted((n for n in have if n.startswith("xl/worksheets/") and n.endswith(".xml")), key=lambda n: (len(n), n))
    return list(dict.fromkeys([n for n in named if n in have and n.startswith("xl/worksheets/")] + rest))


def xlsx_blobs(data: bytes) -> list[str]:
    """A text for each sheet that has string cells: the cells of a row, each with a space after it, and a line end."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        have = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in have:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        sheets = _sheets(z, have)
        out = []
        for sheet in sheets:
            text = ""
            for row in ElementTree.fromstring(z.read(sheet)).iter(f"{_S}row"):
                line = ""
                for c in row.iter(f"{_S}c"):
                    kind, value = c.get("t"), c.find(f"{_S}v")
                    cell = ""
                    if kind == "s" and value is not None and value.text:
                        cell = shared[int(value.text)]
                    elif kind == "str" and value is not None:
                        cell = value.text or ""
                    elif kind == "inlineStr":
                        cell = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    line += cell + " " if cell else ""
                text += line + "\n" if line else ""
            if text:
                out.append(text)
        return out


def _paragraph(p) -> str:
    out = ""
    for e in p.iter():
        out += (e.text or "") if e.tag == f"{_W}t" else "\t" if e.tag == f"{_W}tab" else "\n" if e.tag in (f"{_W}br", f"{_W}cr") else ""
    return out


def docx_blobs(data: bytes) -> list[str]:
    """A text for each paragraph and table of the body, in order; tables as rows of cells between bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            out.append(_paragraph(e))
        elif e.tag == f"{_W}tbl":
            rows = [[" ".join(_paragraph(p) for p in c.findall(f"{_W}p")) for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            width = max(map(len, rows), default=0)
            out.append("\n".join(["| " + " | ".join([" :----:"] * width) + " |", *lines]))
    return out


def read_office(files: DataFrame) -> DataFrame:
    """lintel.model.BODIES of files with `content` whose path ends in .xlsx or .docx; a file that cannot be read gives one row with `error`."""
    ship(files.sparkSession)

    names = [c.split(" ")[0] for c in BODIES.split(", ")]
    kinds = [*[pa.string()] * 4, pa.int32(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                head = (r["path"], r["name"], r["display_name"], r["archive_name"])
                try:
                    blobs = (xlsx_blobs if r["path"].endswith(".xlsx") else docx_blobs)(r["content"] or b"")
                    rows = [(*head, k, x, None) for k, x in enumerate(blobs)]
                except Exception as e:  # noqa: BLE001
                    rows = [(*head, -1, None, f"Error reading '{r['path']}': {e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    office = F.endswith("path", F.lit(".xlsx")) | F.endswith("path", F.lit(".docx"))
    return files.where(office).select("path", "name", "display_name", "archive_name", "content").mapInArrow(run, BODIES)
