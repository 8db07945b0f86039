"""Scans of real files: archives and office files are made here."""

import bz2
import io
import json
import tarfile
import urllib.error
import urllib.request
import zipfile

import pytest
from pyspark.sql import functions as F

from lintel import cli, service
from lintel.config import Config, General, KeywordSet, TestConfig
from lintel.operators import archives, report, repository
from lintel.plans import render
from lintel.plans.scan import scan
from lintel.sources import archive_readers, ckan, local
from lintel.streaming.scans import stream_messages

CONFIG = Config(
    General(large_text_bytes=1000),
    {
        "IsFreeOfKeywords": TestConfig(arguments=(KeywordSet(("password", "User"), "Credentials:"), KeywordSet(("Q:",), "Paths:"))),
        "IsValidName": TestConfig(arguments=(KeywordSet(disallowed_names=("__pycache__", ".doc")),)),
    },
    {"main": "LocalCollector"},
    {"LocalCollector": {"includeFolders": True}},
)


def zipped(members: dict[str, bytes]) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return data.getvalue()


def tarred(members: dict[str, bytes], mode: str) -> bytes:
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode=mode) as t:
        for k, v in members.items():
            i = tarfile.TarInfo(k.rstrip("/"))
            i.type, i.size = (tarfile.DIRTYPE, 0) if k.endswith("/") else (tarfile.REGTYPE, len(v))
            t.addfile(i, io.BytesIO(v))
    return data.getvalue()


MEMBERS = {"test/": b"", "test/file2": b"", "test/file1.txt": b"a User\n", "bin": b"\0\1password", "test/b c.doc": b"Q: PASSWORD"}


@pytest.fixture
def package(tmp_path):
    root = tmp_path / "p"
    (root / "__pycache__").mkdir(parents=True)
    (root / "__pycache__" / "m.pyc").write_bytes(b"\0\1")
    (root / ".hidden").write_text("")
    (root / "_x.txt").write_text("PassWord here")
    (root / "big.txt").write_text("user " + "x" * 1000 + "PASSWORD")
    (root / "a b.txt").write_text("fine")
    (root / "ReadMe.md").write_text("_x big a b a.zip")
    (root / "doc.pdf").write_bytes(b"%PDF\0")
    (root / "a.zip").write_bytes(zipped(MEMBERS))
    (root / "t.tar.gz").write_bytes(tarred(MEMBERS, "w:gz"))
    (root / "t.gz").write_bytes(b"\x1f\x8b")
    (root / "bad.zip").write_bytes(b"PK\3\4 no zip")
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c t="n"><v>3</v></c><c t="s"><v>0</v></c><c t="inlineStr"><is><t>column2</t></is></c></row><row><c t="str"><v>user</v></c></row><row><c><v>1</v></c></row></sheetData></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>row1</t></si></sst>'
    (root / "s.xlsx").write_bytes(zipped({"xl/sharedStrings.xml": shared.encode(), "xl/worksheets/sheet1.xml": sheet.encode()}))
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>PAGE 1</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Table</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/></w:body></w:document>"
    (root / "d.docx").write_bytes(zipped({"word/document.xml": body.encode()}))
    return root


def test_readers(package):
    for name in ("a.zip", "t.tar.gz"):
        got = list(archive_readers.members_of((package / name).read_bytes(), name, None))
        assert [(n, s, d) for n, s, d, *_ in got] == [("test/", 0, True), ("test/file2", 0, False), ("test/file1.txt", 7, False), ("bin", 10, False), ("test/b c.doc", 11, False)]
    assert archive_readers.xlsx_blobs((package / "s.xlsx").read_bytes()) == ["row1 column2 \nuser \n"]
    assert archive_readers.docx_blobs((package / "d.docx").read_bytes()) == ["PAGE 1", "|  :----: |  :----: |\n| Table | 1 |".replace("|  :----: |  :----: |", "|  :----: |  :----: |"), ""]


def test_listing(spark, package):
    top = local.local_files(spark, str(package))
    assert sorted(r["name"] for r in top.collect()) == sorted(p.name for p in package.iterdir() if p.is_file())
    names = {r["name"]: r for r in local.local_files(spark, str(package), "true", True).collect()}
    assert names["__pycache__"]["is_dir"] and names["m.pyc"]["content"] == b"\0\1" and names["t.gz"]["is_archive"]
    with pytest.raises(local.InvalidPath):
        local.validate_path("../x")
    assert local.validate_path("/tmp/x/")[1]


def test_scan(spark, package):
    result = scan(local.local_files(spark, str(package), True, True), CONFIG)
    got = [(r["test_name"], r["content"], r["name"], r["archive_name"]) for r in result.messages.orderBy("ord").collect()]
    assert len(got) == len(set(got))
    expected = {
        ("IsFreeOfKeywords", "Credentials: 'PassWord'", "_x.txt", None),
        ("IsFreeOfKeywords", "Credentials: 'User'", "big.txt", None),
        ("IsFreeOfKeywords", "Credentials: 'password'", "big.txt", None),
        ("IsFreeOfKeywords", "Credentials: 'user' in sheet/paragraph/table 0", "s.xlsx", None),
        ("HasNoWhiteSpace", "File name contains spaces.", "a b.txt", None),
        ("IsValidName", "File or Folder has an invalid name: __pycache__", "__pycache__", None),
    }
    for a in ("a.zip", "t.tar.gz"):
        expected |= {
            ("IsArchiveFreeOfKeywords", "Credentials: 'User'", "test/file1.txt", a),
            ("IsArchiveFreeOfKeywords", "Credentials: 'PASSWORD'", "test/b c.doc", a),
            ("IsArchiveFreeOfKeywords", "Paths: 'Q:'", "test/b c.doc", a),
            ("HasNoWhiteSpace", "File name contains spaces.", "test/b c.doc", a),
            ("IsValidName", "File has an invalid suffix: test/b c.doc", "test/b c.doc", a),
        }
    assert expected == {x for x in got if x[2] is not None}
    toc = [x[1] for x in got if x[2] is None]
    assert len(toc) == 1 and "'doc.pdf'" in toc[0] and "'a.zip'" not in toc[0] and "'.hidden'" not in toc[0]
    skipped = {(r["filename"], r["reason"]) for r in result.skipped.collect()}
    assert ("doc.pdf", "Binary file detected") in skipped and ("a.zip", "Binary file detected") not in skipped
    warnings = [r["message"] for r in result.warnings.collect()]
    assert any("t.gz" in w for w in warnings) and any("bad.zip" in w for w in warnings)
    data = json.loads(render.as_json(result))
    assert set(data) == {"timestamp", "scanned", "skipped", "details_subject_focused", "details_check_focused", "pdf_files", "errors", "warnings"}
    assert data["pdf_files"] == ["doc.pdf"]
    assert sum(len(s["issues"]) for s in data["details_subject_focused"]) == len(got)
    assert "Found" in render.as_plain(result, "here") and "Total: " in render.as_summary(result)
    out = package / "sub" / "r.html"
    render.as_html(json.dumps(data), out)
    assert "Scan report" in out.read_text()
    with pytest.raises(ValueError):
        render.as_html("{", out)


def test_limits(spark):
    files = spark.createDataFrame([("x.txt", "x.txt", "x.txt", 10, ".txt", False, None, 0, bytearray(b"password !"))], "path string, name string, display_name string, size bigint, suffix string, is_archive boolean, archive_name string, ord bigint, content binary")
    small = Config(General(max_content_scan_file_size=9), CONFIG.tests)
    result = scan(files, small, False)
    assert result.messages.count() == 0 and [r["reason"] for r in result.skipped.collect()] == ["File too large for content scanning"]
    assert scan(files, CONFIG, False).messages.count() == 1
    assert scan(files.limit(0), CONFIG, False).messages.count() == 0


@pytest.mark.parametrize(("factor", "budget", "kept"), [(1, 10, [0, 1, 3]), (2, 14, [0, 1, 3]), (2, 9, [0, 3]), (1, 0, [])])
def test_budget(spark, factor, budget, kept):
    rows = spark.createDataFrame([("a", 0, 4), ("a", 1, 5), ("a", 2, 8), ("a", 3, 1)], "k string, o int, s int")
    got = archives.admitted_by_budget(rows, "k", "o", "s", budget, factor)
    expected, used = [], 0
    for o, s in ((0, 4), (1, 5), (2, 8), (3, 1)):
        if factor * used + s <= budget:
            used += s
            expected.append(o)
    assert sorted(r["o"] for r in got.collect()) == expected
    assert factor == 2 or expected == kept


def test_repository(spark):
    rows = [("p", "readme.md", 0, "old"), ("p", "README.txt", 2, "file1 only"), ("p", "file1.txt", 1, None), ("p", "file2.txt", 3, None), ("q", "x", 4, None)]
    files = spark.createDataFrame(rows, "package_id string, name string, ord int, text string")
    assert [tuple(r) for r in repository.packages_without_readme(files).collect()] == [("q", "No ReadMe file in repository.")]
    (got,) = repository.missing_from_contents(files).collect()
    assert got["package_id"] == "p" and got["content"].endswith("Missing files are: 'file2.txt'")


@pytest.mark.parametrize(("n", "k", "kept", "more"), [(5, 3, 2, "and 3 more"), (15, 5, 4, "and 11 more"), (3, 0, 3, None), (3, 3, 3, None)])
def test_truncation(spark, n, k, kept, more):
    rows = [("T", "File name contains spaces.", "file", f"p{i}", f"n{i}", f"n{i}", None, i) for i in range(n)]
    from lintel.model import MESSAGES

    got = report.truncate_by_type(spark.createDataFrame(rows, MESSAGES), k).collect()
    assert len([r for r in got if "more similar" not in r["content"]]) == kept
    assert more is None or any(more in r["content"] for r in got)


def test_portal(spark, monkeypatch):
    document = json.dumps({"result": {"resources": [{"name": "a.pdf", "url": "https://x.org/dataset/1/resource/f46e74be-1c61/download/a.pdf", "url_type": "upload", "size": 8655745.9}, {"name": "b", "url": "https://x.org/b", "url_type": ""}, {"name": "c", "url": "::", "url_type": "upload", "size": 1}], "id": "x"}})
    (got,) = ckan.package_files(spark, document, "/var/lib/ckan/").select("path", "name", "size", "suffix").collect()
    assert tuple(got) == ("/var/lib/ckan/resources/f46/e74/be-1c61", "a.pdf", 8655745, ".pdf")
    monkeypatch.setattr(ckan, "request", lambda *a, **k: document)
    server = service.make_server(spark, CONFIG, service.ServerConfig("http://portal"))
    service.serve_in_thread(server)
    base = f"http://127.0.0.1:{server.server_port}"

    def post(body, **headers):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + "/api/v1/analyze", data=body, headers=headers)) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)["code"]

    try:
        assert json.load(urllib.request.urlopen(base + "/health"))["status"] == "ok"
        assert post(b"{}") == (401, "missing_token")
        assert post(b"{}", Authorization="Basic x") == (401, "invalid_auth_format")
        assert post(b"{}", Authorization="bearer  ") == (401, "empty_token")
        assert post(b"{", Authorization="bearer t") == (400, "invalid_json")
        assert post(b"{}", Authorization="bearer t") == (400, "missing_package_id")
        status, answer = post(b'{"package_id": "p"}', Authorization="Bearer t")
        assert status == 200 and answer["pdf_files"] == ["a.pdf"]

        def refuse(*a, **k):
            raise ckan.PortalError("no", 403)

        monkeypatch.setattr(ckan, "request", refuse)
        assert post(b'{"package_id": "p"}', Authorization="Bearer t") == (403, "forbidden")
    finally:
        server.shutdown()


def test_cli(spark, package, tmp_path, capsys):
    config = tmp_path / "pc.toml"
    config.write_text('[operation.main]\ncollector = "LocalCollector"\n[test.IsFreeOfKeywords]\nkeywordArguments = [{keywords = ["password"], info = "Found"}]\n')
    cli.main(["--config", str(config), "--location", str(package), "--json"])
    assert any("Found" in i["message"] for s in json.loads(capsys.readouterr().out)["details_subject_focused"] for i in s["issues"])
    cli.main(["--config", str(tmp_path / "none.toml")])
    assert json.loads(capsys.readouterr().out)["error"]["type"] == "config_error"
    (tmp_path / "empty").mkdir()
    cli.main(["--config", str(config), "--location", str(tmp_path / "empty")])
    assert json.loads(capsys.readouterr().out)["error"]["type"] == "no_files"


def test_stream(spark, tmp_path):
    schema = "path string, name string, display_name string, archive_name string, size bigint, text string"
    rows = [("a b", "a b", "a b", None, 8, "password"), ("c", "c", "c", None, 1, "x")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    query = stream_messages(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), CONFIG).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {r["test_name"] for r in spark.table("found").select(F.col("test_name")).collect()} == {"HasNoWhiteSpace", "IsFreeOfKeywords"}


def sevenz(members, method="lzma2", solid=True, encoded=False):
    """A 7z archive by hand: one folder for all members, or one for each."""
    import lzma
    import struct
    import zlib

    def number(n):
        for k in range(8):
            if n < 1 << 7 * (k + 1):
                return bytes([(0xFF00 >> k) & 0xFF | n >> 8 * k]) + (n & (1 << 8 * k) - 1).to_bytes(k, "little")
        return b"\xff" + n.to_bytes(8, "little")

    def packed(data):
        if method == "copy":
            return data, b"\x01\x00"
        if method == "deflate":
            c = zlib.compressobj(9, zlib.DEFLATED, -15)
            return c.compress(data) + c.flush(), b"\x03\x04\x01\x08"
        if method == "bzip2":
            return bz2.compress(data), b"\x03\x04\x02\x02"
        if method == "lzma":
            return lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16}]), b"\x23\x03\x01\x01" + number(5) + b"\x5d" + struct.pack("<I", 1 << 16)
        return lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}]), b"\x21\x21" + number(1) + b"\x08"

    def streams(parts, at, numbers=None, sizes=()):
        out = b"\x06" + number(at) + number(len(parts)) + b"\x09" + b"".join(number(len(p)) for p, *_ in parts) + b"\0"
        out += b"\x07\x0b" + number(len(parts)) + b"\0" + b"".join(b"\x01" + coder for _, coder, _ in parts) + b"\x0c" + b"".join(number(n) for *_, n in parts) + b"\0"
        if numbers is not None:
            out += b"\x08\x0d" + b"".join(map(number, numbers)) + (b"\x09" + b"".join(map(number, sizes)) if sizes else b"") + b"\0"
        return out + b"\0"

    full = [c for _, c in members if c]
    groups = [full] if solid else [[c] for c in full]
    parts = [(*packed(b"".join(g)), len(b"".join(g))) for g in groups if g]
    body = b"".join(p for p, *_ in parts)
    names = "".join(n.rstrip("/") + "\0" for n, _ in members).encode("utf-16-le")
    empty = [not c for _, c in members]
    bits = lambda flags: bytes(sum(f << 7 - k for k, f in enumerate(flags[i : i + 8])) for i in range(0, len(flags), 8))
    header = b"\x01" + (b"\x04" + streams(parts, 0, [len(g) for g in groups], [len(c) for g in groups for c in g[:-1]]) if parts else b"")
    header += b"\x05" + number(len(members))
    if any(empty):
        files = [not n.endswith("/") for (n, _), e in zip(members, empty, strict=True) if e]
        header += b"\x0e" + number(len(bits(empty))) + bits(empty) + b"\x0f" + number(len(bits(files))) + bits(files)
    header += b"\x11" + number(len(names) + 1) + b"\0" + names + b"\0\0"
    if encoded:
        small, coder = packed(header)
        own = b"\x17" + streams([(small, coder, len(header))], len(body))
        body, header = body + small, own
    head = struct.pack("<QQI", len(body), len(header), zlib.crc32(header))
    return b"7z\xbc\xaf\x27\x1c\0\x04" + struct.pack("<I", zlib.crc32(head)) + head + body + header


SEVEN = [("test/", b""), ("test/empty", b""), ("test/a.txt", b"the User is here"), ("b c.doc", b"a PASSWORD " * 500), ("bin", b"\0\1\2"), ("z.txt", b"last password")]


@pytest.mark.parametrize("method", ["copy", "lzma", "lzma2", "deflate", "bzip2"])
@pytest.mark.parametrize(("solid", "encoded"), [(True, True), (False, False), (True, False)])
def test_7z(method, solid, encoded):
    data = sevenz(SEVEN, method, solid, encoded)
    got = list(archive_readers.members_of(data, "x.7z", None))
    assert [(n, s, d) for n, s, d, *_ in got] == [(n, len(c), n.endswith("/")) for n, c in SEVEN]
    read = {n: c for n, _, _, c, _ in archive_readers.members_of(data, "x.7z", archive_readers.Gate())}
    assert read == {n: c if c and n != "bin" else None for n, c in SEVEN}
    few = {n: c for n, _, _, c, _ in archive_readers.members_of(data, "x.7z", archive_readers.Gate(largest=100, budget=45))}
    assert {n for n, c in few.items() if c} == {"test/a.txt", "z.txt"}
    for broken in (data[:40], data[: len(data) // 2], b"7z" + data[2:20], data[:32] + bytes(len(data) - 32)):
        with pytest.raises(ValueError):
            list(archive_readers.members_of(broken, "x.7z", None))


def test_no_7z_members():
    assert list(archive_readers.members_of(sevenz([]), "x.7z", None)) == []


def test_bytes_that_are_no_utf8(spark, tmp_path):
    (tmp_path / "latin.txt").write_bytes(b"caf\xe9 password")
    (tmp_path / "utf16.txt").write_bytes("password".encode("utf-16"))
    (tmp_path / "cut.txt").write_bytes("a User é".encode()[:-1])
    (tmp_path / "readme.md").write_bytes(b"\xff\xfe latin utf16 cut a")
    (tmp_path / "a.zip").write_bytes(zipped({"m.txt": b"\xe9t\xe9 User"}))
    (tmp_path / "x.7z").write_bytes(sevenz(SEVEN))
    result = scan(local.local_files(spark, str(tmp_path), True, True), CONFIG)
    got = {(r["content"], r["name"]) for r in result.messages.collect()}
    assert {("Credentials: 'password'", "latin.txt"), ("Credentials: 'User'", "cut.txt"), ("Credentials: 'User'", "m.txt"), ("Credentials: 'User'", "test/a.txt"), ("Credentials: 'password'", "z.txt")} <= got
    assert result.warnings.count() == 0 and result.errors.count() == 0


def test_keywords_over_the_border_of_chunks(spark, tmp_path):
    size = local.CHUNK_BYTES
    (tmp_path / "big.txt").write_bytes(b"x" * (size - 4) + b"PassWord" + b"y" * (2 * size) + b"user" + b"z" * 10)
    (tmp_path / "none.txt").write_bytes(b"x" * (size + 5))
    (tmp_path / "big.bin").write_bytes(b"\0" * (size + 5) + b"password")
    files = local.local_files(spark, str(tmp_path), True, True)
    assert {r["name"]: (len(r["content"]), r["whole"]) for r in files.collect()} == {n: (local.SAMPLE_BYTES, False) for n in ("big.txt", "none.txt", "big.bin")}
    result = scan(files, CONFIG, across_files=False)
    assert sorted((r["content"], r["name"]) for r in result.messages.where("test_name = 'IsFreeOfKeywords'").collect()) == [("Credentials: 'User'", "big.txt"), ("Credentials: 'password'", "big.txt")]
    assert [(r["filename"], r["reason"]) for r in result.skipped.collect()] == [("big.bin", "Binary file detected")]
    assert "seems to be binary" in result.log.where("level = 'info'").first()["message"]
    chunks = local.text_chunks(files.where("name = 'big.txt'"), most=100).collect()
    assert len(chunks) == 1 and "too large" in chunks[0]["error"]


def test_a_bomb_is_not_unpacked(spark, tmp_path):
    """Members far beyond the budget: no more than it is held, in batches of a few MB."""
    import tracemalloc

    one = b"a " * (5 << 20)
    data = zipped({f"{i}.txt": one for i in range(40)})
    tracemalloc.start()
    read = [c for _, _, _, c, _ in archive_readers.members_of(data, "x.zip", archive_readers.Gate(budget=30 << 20)) if c is not None]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(read) == 2 and peak < 80 << 20
    (tmp_path / "x.zip").write_bytes(data)
    rows = archive_readers.read_members(local.local_files(spark, str(tmp_path), True, True), archive_readers.Gate())
    assert rows.where("content is not null").count() == 5


def test_a_member_that_cannot_be_read_is_told_of(spark, tmp_path):
    data = bytearray(zipped({"good.txt": b"a User", "bad.txt": b"password " * 50}))
    at = data.index(b"bad.txt") + 7
    data[at : at + 10] = b"\xff" * 10
    (tmp_path / "a.zip").write_bytes(bytes(data))
    result = scan(local.local_files(spark, str(tmp_path), True, True), CONFIG, across_files=False)
    assert [r["name"] for r in result.messages.where("test_name = 'IsArchiveFreeOfKeywords'").collect()] == ["good.txt"]
    (warning,) = [r["message"] for r in result.warnings.collect()]
    assert "bad.txt" in warning


def test_registries_drive_the_scan(spark, package, monkeypatch):
    from lintel.operators import checks
    from lintel.plans import scan as plan

    monkeypatch.setitem(checks.NAME_CHECKS, "HasNoX", lambda name, _: F.array_compact(F.array(F.when(F.contains(name, F.lit("x")), F.lit("has an x")))))
    monkeypatch.setattr(checks, "BY_FILE", ["HasNoX"])
    monkeypatch.setattr(checks, "BY_REPOSITORY", ["HasReadme"])
    monkeypatch.setattr(checks, "BY_MEMBER_NAME", [])
    monkeypatch.setattr(checks, "BY_MEMBER_CONTENT", ["Loud"])
    loud = ["'Loud' AS test_name", "'read' AS content", "archive_path AS path", "member AS name", "member AS display_name", "archive_label AS archive_name"]
    monkeypatch.setitem(plan.MEMBER_CHECKS, "Loud", lambda members, _: checks.as_messages(members.where("content is not null").selectExpr(*loud)))
    result = scan(local.local_files(spark, str(package), True, True), CONFIG)
    got = {(r["test_name"], r["name"]) for r in result.messages.collect()}
    assert {t for t, _ in got} == {"HasNoX", "Loud"} and ("HasNoX", "s.xlsx") in got
    told = []
    n = plan.with_progress(result, lambda *x: told.append(x))
    assert n == result.messages.count() and told[0][0] == 0 and told[-1][0] == told[-1][1] == told[0][1] and [x[0] for x in told] == sorted(x[0] for x in told)


def test_sheets_come_in_the_workbooks_order():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = lambda x: f'<worksheet {ns}><sheetData><row><c t="str"><v>{x}</v></c></row></sheetData></worksheet>'.encode()
    parts = {
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="b" r:id="r2"/><sheet name="a" r:id="r1"/></sheets></workbook>'.encode(),
        "xl/_rels/workbook.xml.rels": b'<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": sheet("one"), "xl/worksheets/sheet2.xml": sheet("two"), "xl/worksheets/sheet3.xml": sheet("three"),
    }
    assert archive_readers.xlsx_blobs(zipped(parts)) == ["two \n", "one \n", "three \n"]


def test_a_cluster_needs_a_shared_folder():
    from lintel.session import shared_dir

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Session())


def test_a_server_that_stops_waits_for_requests_under_way():
    import threading
    import time

    begun, answers = threading.Event(), []

    def slow(*_):
        begun.set()
        time.sleep(0.5)
        return '{"ok": 1}'

    server = service.make_server(None, CONFIG, run=slow)
    service.serve_in_thread(server)
    request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/api/v1/analyze", b"{}", {"Authorization": "Bearer t"})
    t = threading.Thread(target=lambda: answers.append(urllib.request.urlopen(request).read()))
    t.start()
    assert begun.wait(5) and service.stop(server, 5)
    t.join(5)
    assert answers == [b'{"ok": 1}']


def test_plans_that_need_no_contents_read_none(spark, package):
    files = local.local_files(spark, str(package), True, True)
    plan = files.select("name", "size")._jdf.queryExecution().optimizedPlan().toString()
    assert "read(" not in plan and "read(" in files.select("content")._jdf.queryExecution().optimizedPlan().toString()


def test_list_of_pdf_files(spark, package):
    result = scan(local.local_files(spark, str(package), True, True), CONFIG)
    assert render.pdf_list(result, "PDF files:").split("\n")[:2] == ["PDF files:", "doc.pdf"]
