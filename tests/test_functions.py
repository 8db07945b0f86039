"""The literal cases of checks: input, and the finding's text."""

import pytest
from pyspark.sql import functions as F

from lintel.config import Config, ConfigError, KeywordSet, TestConfig, parse, validate
from lintel.functions import messages as m
from lintel.functions import names, text
from lintel.operators import filters


def values(spark, inputs, column, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_ascii(spark):
    p = "File name contains non-ASCII character: "
    got = values(spark, ["testfile.txt", "test file.txt", "f_ñ_ñ.txt", "f_abc_ñ_123.txt", "", None], names.non_ascii)
    assert got == [None, None, p + "ññ", p + "ñ", None, None]


def test_spaces(spark):
    assert values(spark, ["a.txt", "a b.txt", "", "a\tb"], names.white_space) == [None, "File name contains spaces.", None, None]


def test_length_is_in_bytes(spark):
    got = values(spark, ["a" * 64, "b" * 65, "é" * 32, "é" * 33, " " * 64, " " * 65, "👍" * 17], names.too_long)
    assert [x is not None for x in got] == [False, True, False, True, False, True, True]


def test_special_characters(spark):
    p = "File name contains invalid character: "
    got = values(spark, ["!Attention.xlsx", "`script.sh", "myfile#v2.doc", "file[name]{ok}.txt", "report}.pdf", "café.txt", "a'b", "a\tb", "a\x01b", "a/b\\c:d|e=f+g\x7f"], names.special_characters)
    assert got == [p + "'!'", p + "'`'", p + "'#'", p + "'['", p + "'}'", None, p + "'\\''", p + "'\\t'", p + "'\\x01'", None]


def test_invalid_names(spark):
    got = values(spark, ["__pycache__/invalidfile.txt", "abc.doc", "ABC.DOC", ".RHISTORY", "VENV/.venv/x", "venv/", "venv\\x"], lambda c: names.invalid_names(c, [".doc", ".Rhistory", "venv", "__pycache__"]))
    assert [len(x) for x in got] == [1, 1, 0, 1, 1, 1, 0]
    assert got[1] == ["File has an invalid suffix: abc.doc"]
    assert got[3] == ["File or Folder has an invalid name: .RHISTORY"]


def test_stem_and_readme(spark):
    assert values(spark, ["a.b.txt", ".gitignore", "x"], names.stem) == ["a.b", "", "x"]
    assert values(spark, ["README.md", "ReadMe.TXT", "readme.rst"], names.is_readme) == [True, True, False]
    assert values(spark, ["a.zip", "a.tar.gz", "a.gz", "a.ZIP", "a.7z", "tar"], names.is_supported_archive) == [True, True, False, False, True, False]


def test_is_text(spark):
    data = [b"plain sentence", bytes([0, 1, 2, 3, 4]), b"", b"%PDF-1.4\n\x01\x02\x03", b"\xff\xfe\x01\x02", b"<html>\x01", b"abc\x01" + b"d" * 100]
    assert values(spark, [bytearray(x) for x in data], lambda c: text.is_text(F.lit("f"), c), "binary") == [True, False, True, False, True, True, True]
    assert values(spark, [bytearray(b"\0\1")], lambda c: text.is_text(F.lit("A.LOG"), c), "binary") == [True]


def test_keywords_as_spelled(spark):
    got = values(spark, ["PASSWORD and Secret, password", "nothing", "", None], lambda c: text.matched(c, ["password", "secret", "", "Password"]))
    assert got[:3] == [["PASSWORD", "Secret"], [], []]
    assert values(spark, ["PASSWORD secret"], lambda c: text.matched_configured(c, ["Password", "password", "x"])) == [["password"]]


def test_member_filter(spark):
    got = values(spark, ["a/Test.LOG", "b.txt", ""], lambda c: text.member_wanted(c, (), ("test.log",)))
    assert got == [False, True, False]
    assert values(spark, ["a/Test.LOG", "b.txt"], lambda c: text.member_wanted(c, (".txt",), ())) == [False, True]


@pytest.mark.parametrize(
    ("white", "black", "expected"),
    [((), (), True), (("test",), (), True), (("other",), (), False), ((), ("test",), False), ((), ("other",), True), (("te.t", "x"), ("test",), True), (("[",), (), False), ((), ("[",), True)],
)
@pytest.mark.filterwarnings("ignore")
def test_lists(spark, white, black, expected):
    config = Config(tests={"C": TestConfig(black, white)})
    assert values(spark, ["my test.txt"], lambda c: filters.wanted(config, "C", c)) == [expected]
    assert values(spark, ["my test.txt"], lambda c: filters.wanted(config, "D", c)) == [True]


def test_patterns():
    assert filters.java_pattern(["(?P<a>x)", "[[:alpha:]]+"]) == r"(?<a>x)|\p{Alpha}+"
    with pytest.warns(UserWarning):
        assert filters.java_pattern(["a(?=b)"]) is None


def test_message_types(spark):
    got = values(spark, ["File name contains non-ASCII character: ñ", "File name contains spaces.", "Sensitive data in File? Found suspicious keyword(s): x", "Do you have Some internal information here", "x" * 60, "é" * 30, "short"], m.message_type)
    assert got == ["non-ascii-filename", "filename-spaces", "sensitive-data", "some-internal", "x" * 50, "é" * 25, "short"]


def test_message_keys(spark):
    assert values(spark, ["Found 'a', 'b'", 'Found "a"', "Found"], m.message_key) == ["Found", "Found", "Found"]
    assert values(spark, ["a/b/c.txt", "c.txt"], m.parent_path) == ["a/b", ""]
    assert values(spark, ["x" * 80, "y" * 81], m.shortened) == ["x" * 80, "y" * 77 + "..."]


def test_config():
    c = parse('[general]\nmaxArchiveFileSize = 5\nmaxTotalArchiveMemory = "x"\n[test.A]\nblacklist = ["a", 1]\nkeywordArguments = [{keywords = ["k"], info = "i"}, 3]\n[collector.L]\nattrs = {includeFolders = true, n = 1}\n[operation.main]\ncollector = "L"\n')
    assert c.general.max_archive_file_size == 5 and c.general.max_total_archive_memory == 100 << 20
    assert c.test("A") == TestConfig(("a",), (), (KeywordSet(("k",), "i"),))
    assert c.collector("L") == {"includeFolders": True} and c.operations["main"] == "L"
    with pytest.raises(ConfigError):
        validate(parse('[test.A]\nblacklist=["a"]\nwhitelist=["b"]'))
