"""Every operator as a query over the test tables, which stand for files, packages and archives; and the same rows by SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.config import Config, General, KeywordSet, TestConfig
from lintel.functions import messages as m
from lintel.functions import names, text
from lintel.model import is_archive, suffix_of, with_derived
from lintel.operators import archives, checks, filters, report, repository
from lintel.sources import ckan
from lintel.sources.archive_readers import Gate, read_members

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_SETS = (KeywordSet(("token", "bearer", "secret"), "Security credentials detected"), KeywordSet(("license", "Apache", "MIT"), "License text detected"))
_DISALLOWED = (".doc", "SRC1", "de")
_CONFIG = Config(tests={"IsFreeOfKeywords": TestConfig(arguments=_SETS), "IsValidName": TestConfig(arguments=(KeywordSet(disallowed_names=_DISALLOWED),))})
_MEMBER_CONFIG = Config(General(max_total_archive_memory=400), {"IsFreeOfKeywords": TestConfig(arguments=(KeywordSet(("tion", "ER"), "Syllables detected"),))})


def _register(sql: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(df: DataFrame, path: Column, name: Column, **more: Column) -> DataFrame:
    return with_derived(df.select(path.alias("path"), name.alias("name"), *[c.alias(k) for k, c in more.items()]))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as text files: the path is the id, the size the text's bytes."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return docs.select(path.alias("path"), path.alias("name"), path.alias("display_name"), F.lit(None).cast("string").alias("archive_name"), F.octet_length("text").alias("size"), "text")


_K2 = """CASE WHEN len({k}) > 0 THEN '{info} ''' || array_to_string({k}, ''', ''') || '''' END"""


def _k2(words: tuple[str, ...], column: str) -> str:
    hit = ", ".join(f"CASE WHEN contains(lower({column}), '{w.lower()}') THEN substr({column}, instr(lower({column}), '{w.lower()}'), {len(w)}) END" for w in words)
    return f"list_sort(list_distinct(list_filter([{hit}], lambda x: x IS NOT NULL)))"


def _small(column: str) -> str:
    return " UNION ALL ".join(f"SELECT path, {_K2.format(k=_k2(s.keywords, column), info=s.info)} AS content FROM t" for s in _SETS)


@_register(f"WITH t AS (SELECT 'doc' || doc_id AS path, text FROM documents WHERE strlen(text) <= 1048576), r AS ({_small('text')}) SELECT 'IsFreeOfKeywords' AS test_name, path, content FROM r WHERE content IS NOT NULL")
def keyword_text_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords in texts, a finding for each set, as the text spells them. All test texts are under 1 MiB."""
    return checks.keyword_messages(_texts(spark, sf_dir), _CONFIG).select("test_name", "path", "content")


_LARGE = " UNION ALL ".join(f"SELECT path, '{s.info} ''{w}''' AS content FROM l WHERE contains(lower(text), '{w.lower()}')" for s in _SETS for w in s.keywords)


@_register(f"""WITH d AS (SELECT 'doc' || doc_id AS path, text FROM documents), t AS (SELECT * FROM d WHERE strlen(text) <= 4096), l AS (SELECT * FROM d WHERE strlen(text) > 4096),
r AS ({_small('text')} UNION ALL {_LARGE}) SELECT 'IsFreeOfKeywords' AS test_name, path, content FROM r WHERE content IS NOT NULL""")
def keyword_text_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with texts over 4 KiB taken as large: a finding for each keyword, as configured."""
    return checks.keyword_messages(_texts(spark, sf_dir), Config(General(large_text_bytes=4096), _CONFIG.tests)).select("test_name", "path", "content")


_BLOBS = " UNION ALL ".join(f"SELECT path, idx, {_K2.format(k=_k2(s.keywords, 'line'), info=s.info)} AS c FROM t" for s in _SETS)


@_register(f"""WITH a AS (SELECT 'doc' || doc_id AS path, string_split(text, chr(10)) AS l FROM documents), t AS (SELECT path, unnest(l) AS line, unnest(range(len(l))) AS idx FROM a),
r AS ({_BLOBS}) SELECT path, c || ' in sheet/paragraph/table ' || idx AS content FROM r WHERE c IS NOT NULL""")
def keyword_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as an office file's blobs."""
    rows = _texts(spark, sf_dir).select("path", "name", "display_name", "archive_name", F.posexplode(F.split("text", "\n")).alias("idx", "content"))
    return checks.blob_messages(rows, _CONFIG).select("path", "content")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as tar archives, turns as members."""
    conv = _table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(".tar"))
    return conv.select(
        name.alias("archive_path"), name.alias("archive_name"), name.alias("archive_label"), F.col("turn").cast("int").alias("ord"), F.concat(F.col("role"), F.lit("/"), F.col("turn").cast("string"), F.lit(".txt")).alias("member"),
        F.octet_length("text").cast("bigint").alias("size"), F.lit(False).alias("is_dir"), F.encode("text", "UTF-8").alias("content"), F.lit(None).cast("string").alias("error"),
    )


def _budget(factor: int) -> str:
    return f"""s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, strlen(text) AS n FROM conversations WHERE strlen(text) > 0),
b AS (SELECT conv_id, k, turn, n <= 400 AS ok, CASE WHEN n <= 400 THEN n ELSE 0 END AS u FROM s WHERE k = 1
UNION ALL SELECT s.conv_id, s.k, s.turn, {factor} * b.u + s.n <= 400, b.u + CASE WHEN {factor} * b.u + s.n <= 400 THEN s.n ELSE 0 END FROM b JOIN s ON s.conv_id = b.conv_id AND s.k = b.k + 1)"""


@_register(f"""WITH RECURSIVE {_budget(1)}, t AS (SELECT 'conv' || c.conv_id || '.tar' AS path, c.role || '/' || c.turn || '.txt' AS name, c.text FROM b JOIN conversations c ON b.conv_id = c.conv_id AND b.turn = c.turn WHERE ok),
r AS (SELECT path, name, {_K2.format(k=_k2(('tion', 'ER'), 'text'), info='Syllables detected')} AS content FROM t) SELECT path, name, content FROM r WHERE content IS NOT NULL""")
def keyword_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords in the members that fit a budget of 400 bytes an archive."""
    return archives.member_messages(_members(spark, sf_dir), _MEMBER_CONFIG).select("path", "name", "content")


def _admitted(factor: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").alias("n"))
        return archives.admitted_by_budget(rows, "conv_id", "turn", "n", 400, factor, F.col("n") > 0).select("conv_id", "turn")

    return run


for _kind, _factor in (("tar", 1), ("zip", 2)):
    QUERIES[f"archive_budget_{_kind}"] = _admitted(_factor)
    SQL[f"archive_budget_{_kind}"] = f"WITH RECURSIVE {_budget(_factor)} SELECT conv_id, turn FROM b WHERE ok"

_FIRST_LINE = "split_part(text, chr(10), 1)"


@_register(rf"""WITH f AS (SELECT doc_id, regexp_replace({_FIRST_LINE}, '[\x00-\x7F]', '', 'g') AS c FROM documents) SELECT doc_id, 'File name contains non-ASCII character: ' || c AS content FROM f WHERE c <> ''""")
def name_only_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", names.non_ascii(F.substring_index("text", "\n", 1)).alias("content"))
    return rows.where("content is not null")


@_register("SELECT p_partkey, 'File name contains spaces.' AS content FROM part WHERE contains(p_name, ' ')")
def name_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", names.white_space(F.col("p_name")).alias("content")).where("content is not null")


_RE2_SPECIAL = names.SPECIAL_CLASS.replace("'", "''")


@_register(f"""WITH n AS (SELECT c_name AS name FROM customer UNION ALL SELECT string_split(url, '/')[-1] FROM pages), f AS (SELECT name, regexp_extract(name, '{_RE2_SPECIAL}') AS c FROM n)
SELECT name, 'File name contains invalid character: ''' || c || '''' AS content FROM f WHERE c <> ''""")
def name_special_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names and the last parts of URLs."""
    all_names = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).unionByName(_table(spark, sf_dir, "pages").select(F.element_at(F.split("url", "/"), -1).alias("name")))
    return all_names.select("name", names.special_characters(F.col("name")).alias("content")).where("content is not null")


@_register(f"SELECT doc_id, 'File name is too long.' AS content FROM documents WHERE strlen({_FIRST_LINE}) > 64")
def name_too_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", names.too_long(F.substring_index("text", "\n", 1)).alias("content")).where("content is not null")


_PATH = "source || '/' || lang || '/' || doc_id || '.doc'"


@_register(f"""WITH n AS (SELECT doc_id, {_PATH} AS name FROM documents), p AS (SELECT doc_id, name, string_split(name, '/') AS s FROM n), d AS (SELECT unnest({list(_DISALLOWED)}) AS d),
a AS (SELECT doc_id, CASE WHEN lower(s[-1]) = lower(d) THEN 'File or Folder has an invalid name: ' || name WHEN ends_with(s[-1], d) THEN 'File has an invalid suffix: ' || name END AS content FROM p, d
UNION ALL SELECT doc_id, 'File or Folder has an invalid name: ' || name FROM (SELECT doc_id, name, unnest(s[:-2]) AS folder FROM p), d WHERE lower(folder) = lower(d))
SELECT doc_id, content FROM a WHERE content IS NOT NULL""")
def name_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    name = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".doc")))
    return docs.select("doc_id", F.explode(names.invalid_names(name, _DISALLOWED)).alias("content"))


def _filtered(test: TestConfig) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = _table(spark, sf_dir, "pages")
        return filters.for_check(_files(pages, F.col("url"), F.col("url"), size=F.col("page_id")), Config(tests={"HasOnlyASCII": test}), "HasOnlyASCII").select(F.col("size").alias("page_id"), "name")

    return run


QUERIES["filter_whitelist"] = _filtered(TestConfig(whitelist=(r"^https://blog\.", r"\.html$")))
SQL["filter_whitelist"] = r"SELECT page_id, url AS name FROM pages WHERE regexp_matches(url, '^https://blog\.|\.html$')"
QUERIES["filter_blacklist"] = _filtered(TestConfig(blacklist=(r"\.html$", r"(?P<s>#top)")))
SQL["filter_blacklist"] = r"SELECT page_id, url AS name FROM pages WHERE NOT regexp_matches(url, '\.html$|(?P<s>#top)')"
QUERIES["filter_none"] = _filtered(TestConfig())
SQL["filter_none"] = "SELECT page_id, url AS name FROM pages"


@_register("SELECT page_id, url FROM pages WHERE NOT (contains(lower(url), 'm.') OR contains(lower(url), '#top')) AND (contains(lower(url), '/en/') OR contains(lower(url), '.org'))")
def member_filter_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").where(text.member_wanted(F.col("url"), ("/EN/", ".org"), ("M.", "#Top"))).select("page_id", "url")


@_register("SELECT doc_id, (contains(lower(text), 'token') OR contains(lower(text), 'license')) AS found FROM documents")
def keyword_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.any_match(F.col("text"), ("Token", "", "LICENSE")).alias("found"))


_CONTROL = r"[\x00-\x08\x0b\x0e-\x1a\x1c-\x1f]"


@_register(rf"""WITH t AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages)
SELECT kind, id, text = '' OR (NOT contains(text, chr(0)) AND (NOT regexp_matches(text[:8192], '{_CONTROL}') OR len(regexp_replace(text[:8192], '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')) >= 0.95 * len(text[:8192]))) AS is_text,
regexp_matches(text, '(?i)^[\t\n\f\r ]*<(!doctype html|html|script)[ >]') OR NOT regexp_matches(text[:512], '{_CONTROL}') AS sniffed FROM t""")
def text_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as contents without a suffix."""
    docs = _table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("c"))
    rows = docs.unionByName(_table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.encode("html", "UTF-8").alias("c")))
    return rows.select("kind", "id", text.is_text(F.lit("x"), F.col("c")).alias("is_text"), text.sniffed_text(F.col("c")).alias("sniffed"))


@_register("SELECT 'doc' || doc_id AS filename, 'doc' || doc_id AS path, 'File too large for content scanning' AS reason FROM documents WHERE strlen(text) > 8192")
def size_gate_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.skipped_by_size(_texts(spark, sf_dir), 8192)


_SUFFIXED = "'a.b/f' || doc_id || ['.zip', '.tar', '.gz', '.tar.gz', '.7z', '.ZIP', '.pdf', '.PDF', '.txt', ''][1 + doc_id % 10]"


def _suffixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document, with one of ten suffixes."""
    kinds = F.array(*[F.lit(x) for x in (".zip", ".tar", ".gz", ".tar.gz", ".7z", ".ZIP", ".pdf", ".PDF", ".txt", "")])
    path = F.concat(F.lit("a.b/f"), F.col("doc_id").cast("string"), F.get(kinds, (F.col("doc_id") % 10).cast("int")))
    archive = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("source"), F.lit(".zip")))
    return with_derived(_table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), archive.alias("archive_name")))


@_register(f"""WITH p AS (SELECT doc_id, {_SUFFIXED} AS path FROM documents), n AS (SELECT doc_id, string_split(path, '/')[-1] AS name FROM p)
SELECT doc_id, name, regexp_extract(name, '\\.[^./]*$') AS suffix, regexp_extract(name, '\\.[^./]*$') IN ('.zip', '.tar', '.gz', '.7z') AS is_archive, regexp_matches(name, '\\.(zip|7z|tar|tar\\.gz)$') AS supported FROM n""")
def archive_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is derived from a path."""
    files = _suffixed(spark, sf_dir)
    return files.select("doc_id", "name", suffix_of(F.col("name")).alias("suffix"), is_archive(F.col("name")).alias("is_archive"), names.is_supported_archive(F.col("name")).alias("supported"))


@_register(f"""WITH p AS (SELECT {_SUFFIXED} AS path, CASE WHEN doc_id % 3 = 0 THEN source || '.zip -> ' ELSE '' END AS note FROM documents)
SELECT note || string_split(path, '/')[-1] AS entry FROM p WHERE ends_with(path, '.pdf')""")
def pdf_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.pdf_files(_suffixed(spark, sf_dir))


@_register(f"""WITH p AS (SELECT {_SUFFIXED} AS path FROM documents) SELECT 6 * count(*) + 4 * count(*) FILTER (regexp_matches(path, '\\.(zip|tar|gz|7z)$')) + 2 AS total FROM p""")
def rules_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.progress_total(_suffixed(spark, sf_dir))


@_register("""WITH f AS (SELECT source, CASE WHEN doc_id % 101 = 0 THEN 'ReadMe.md' ELSE doc_id || '.txt' END AS name FROM documents)
SELECT DISTINCT source, 'No ReadMe file in repository.' AS content FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.source = f.source AND lower(g.name) IN ('readme.md', 'readme.txt'))""")
def has_readme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as packages; one document in 101 is a readme."""
    name = F.when(F.col("doc_id") % 101 == 0, "ReadMe.md").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return repository.packages_without_readme(_table(spark, sf_dir, "documents").select("source", name.alias("name")), "source")


@_register("""WITH r AS (SELECT n_regionkey AS package, string_agg(n_name, ' ' ORDER BY n_nationkey) FILTER (n_nationkey % 2 = 0) AS body FROM nation GROUP BY 1)
SELECT package, 'ReadMe file is missing a complete table of contents for this repository. Missing files are: ' || string_agg('''' || n_name || '.csv''', ', ' ORDER BY n_nationkey) AS content
FROM nation JOIN r ON package = n_regionkey WHERE NOT contains(coalesce(body, ''), n_name) GROUP BY package""")
def readme_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as packages, nations as files, and a readme that names every other nation."""
    nation = _table(spark, sf_dir, "nation")
    half = F.array_sort(F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, F.struct("n_nationkey", "n_name"))))
    body = nation.groupBy(F.col("n_regionkey").alias("package")).agg(F.array_join(F.transform(half, lambda x: x.n_name), " ").alias("text"))
    readme = body.select("package", F.lit("README.txt").alias("name"), F.lit(-1).alias("ord"), "text")
    files = nation.select(F.col("n_regionkey").alias("package"), F.concat("n_name", F.lit(".csv")).alias("name"), F.col("n_nationkey").alias("ord"), F.lit(None).cast("string").alias("text"))
    return repository.missing_from_contents(files.unionByName(readme), "package")


_CHECKS = ("HasOnlyASCII", "HasNoWhiteSpace", "HasFileNameSpecialChars", "IsFileNameTooLong")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages on the names of documents, a name being a text's first line in its source's folder, a third of them in archives, and one for each language as a package."""
    docs = _table(spark, sf_dir, "documents")
    name = F.substring_index("text", "\n", 1)
    files = docs.select(
        F.concat_ws("/", "source", "lang", "doc_id").alias("path"), name.alias("name"), F.concat_ws("/", "source", name).alias("display_name"), F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit(".zip"))).alias("archive_name")
    )
    own = checks.name_messages(files, Config(), _CHECKS)
    rank = F.array_position(F.array(*[F.lit(c) for c in _CHECKS]), F.col("test_name"))
    own = own.withColumn("ord", F.element_at(F.split("path", "/"), -1).cast("bigint") * 10 + rank)
    package = docs.select("lang").distinct().select(
        F.lit("HasReadme").alias("test_name"), F.concat(F.lit("No ReadMe file in "), "lang").alias("content"), F.lit("repository").alias("source_kind"), *[F.lit(None).cast("string").alias(c) for c in ("path", "name", "display_name", "archive_name")],
        (F.ascii("lang") - 1000).cast("bigint").alias("ord"),
    )
    return own.unionByName(package)


_M = rf"""f AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, {_FIRST_LINE} AS name, source || '/' || {_FIRST_LINE} AS shown, CASE WHEN doc_id % 3 = 0 THEN source || '.zip' END AS archive FROM documents),
msg AS (SELECT 'HasOnlyASCII' AS test, 'File name contains non-ASCII character: ' || regexp_replace(name, '[\x00-\x7F]', '', 'g') AS content, 'file' AS kind, path, shown, archive, doc_id * 10 + 1 AS ord FROM f WHERE regexp_replace(name, '[\x00-\x7F]', '', 'g') <> ''
UNION ALL SELECT 'HasNoWhiteSpace', 'File name contains spaces.', 'file', path, shown, archive, doc_id * 10 + 2 FROM f WHERE contains(name, ' ')
UNION ALL SELECT 'HasFileNameSpecialChars', 'File name contains invalid character: ''' || CASE c WHEN chr(9) THEN '\t' WHEN '''' THEN '\''' ELSE c END || '''', 'file', path, shown, archive, doc_id * 10 + 3 FROM (SELECT *, regexp_extract(name, '{_RE2_SPECIAL}') AS c FROM f) WHERE c <> ''
UNION ALL SELECT 'IsFileNameTooLong', 'File name is too long.', 'file', path, shown, archive, doc_id * 10 + 4 FROM f WHERE strlen(name) > 64
UNION ALL SELECT DISTINCT 'HasReadme', 'No ReadMe file in ' || lang, 'repository', NULL, NULL, NULL, ascii(lang) - 1000 FROM documents),
mk AS (SELECT *, CASE WHEN kind = 'file' THEN coalesce(archive || ' > ', '') || shown ELSE 'repository' END AS subject, CASE WHEN kind = 'file' THEN shown ELSE 'repository' END AS display FROM msg)"""


@_register(f"WITH {_M} SELECT CASE WHEN kind = 'file' THEN '- File issue in ''' || subject || ''': ' || content ELSE '- Repository issue: ' || content END AS line FROM mk")
def message_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select(m.formatted().alias("line"))


@_register(f"WITH {_M} SELECT subject AS filename, test AS checkname, count(*) AS issue_count FROM mk WHERE kind = 'file' GROUP BY ALL")
def report_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.scanned(_messages(spark, sf_dir))


def _joined(*fields: str) -> Column:
    return F.array_join(F.transform("issues", lambda x: F.concat_ws(" | ", *[F.coalesce(x[f], F.lit("")) for f in fields])), "\n").alias("issues")


@_register(f"""WITH {_M} SELECT max_by(display, ord) AS subject, coalesce(max_by(path, ord), '') AS path, coalesce(max_by(archive, ord), '') AS archive_name, string_agg(test || ' | ' || content, chr(10) ORDER BY ord, test, content) AS issues FROM mk GROUP BY mk.subject""")
def report_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_subject(_messages(spark, sf_dir)).select("subject", "path", F.coalesce("archive_name", F.lit("")).alias("archive_name"), _joined("checkname", "message"))


@_register(f"""WITH {_M} SELECT test AS checkname, string_agg(display || ' | ' || coalesce(path, '') || ' | ' || coalesce(archive, '') || ' | ' || content, chr(10) ORDER BY ord, display, coalesce(path, ''), coalesce(archive, ''), content) AS issues FROM mk GROUP BY test""")
def report_by_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_check(_messages(spark, sf_dir)).select("checkname", _joined("subject", "path", "archive_name", "message"))


@_register(f"WITH {_M} SELECT count(*) AS total_issues, count(DISTINCT subject) AS files_with_issues, (SELECT count(*) FROM documents) AS total_files FROM mk")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.totals(_messages(spark, sf_dir), _table(spark, sf_dir, "documents"))


@_register(f"WITH {_M} SELECT test AS checkname, count(*) AS issue_count FROM mk GROUP BY test")
def report_check_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.check_counts(_messages(spark, sf_dir))


@_register(f"WITH {_M} SELECT count(*) AS total_issues, count(DISTINCT display) AS subjects FROM mk")
def report_summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary_totals(_messages(spark, sf_dir))


_TYPE = """CASE WHEN contains(content, 'non-ASCII character:') THEN 'non-ascii-filename' WHEN contains(content, 'contains spaces') THEN 'filename-spaces' WHEN strlen(content) > 50 THEN content[:50] ELSE content END"""


@_register(f"WITH {_M} SELECT {_TYPE} AS message_type, count(*) AS n FROM mk GROUP BY 1")
def message_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).groupBy(m.message_type(F.col("content")).alias("message_type")).agg(F.count(F.lit(1)).alias("n"))


@_register(f"""WITH {_M}, w AS (SELECT *, row_number() OVER (PARTITION BY {_TYPE} ORDER BY ord) AS k, count(*) OVER (PARTITION BY {_TYPE}) AS n FROM mk)
SELECT test AS test_name, content, ord FROM w WHERE n <= 5 OR k <= 4 UNION ALL SELECT test, '... and ' || (n - 4) || ' more similar messages (truncated)', ord FROM w WHERE n > 5 AND k = 1""")
def truncate_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.truncate_by_type(_messages(spark, sf_dir), 5).select("test_name", "content", "ord")


_KEY = """CASE WHEN instr(content, ' ''') > 0 THEN trim(split_part(content, ' ''', 1)) WHEN instr(content, ' "') > 0 THEN trim(split_part(content, ' "', 1)) ELSE content END"""


@_register(f"""WITH {_M}, k AS (SELECT test, ord, content, {_KEY} AS key, regexp_extract(coalesce(archive || ' -> ', '') || display, '(?s)^(.*)/', 1) AS parent, '  - ' || coalesce(archive || ' -> ', '') || display || CASE WHEN content = display THEN '' ELSE ': ' || content END AS line FROM mk),
w AS (SELECT *, count(*) OVER (PARTITION BY test) AS everything, count(*) OVER (PARTITION BY test, parent, key) AS n, row_number() OVER (PARTITION BY test, parent, key ORDER BY ord) AS i FROM k)
SELECT test AS checkname, line FROM w WHERE everything <= 5 OR n <= 5 OR i <= 5
UNION ALL SELECT test, '  ... and ' || (n - 5) || ' more in ' || CASE WHEN parent <> '' THEN '"' || parent || '" with ' ELSE '' END || '"' || key || '"' FROM w WHERE everything > 5 AND n > 5 AND i = 1""")
def summary_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary_lines(_messages(spark, sf_dir)).select("checkname", "line")


_RID = "md5(url)"


def _portal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package document for each page, with an uploaded resource, a link, and one without a type."""
    pages = _table(spark, sf_dir, "pages")
    base = F.lit("https://portal.example.org/dataset/")
    good = F.concat(base, F.col("page_id").cast("string"), F.lit("/resource/"), F.md5("url"), F.lit("/download/data.csv"))
    url = F.when(F.col("page_id") % 5 == 0, F.lit("https://portal.example.org/short")).otherwise(good)
    each = [
        F.struct(F.concat(F.lit(n), F.col("page_id").cast("string")).alias("name"), url.alias("url"), kind.alias("url_type"), (F.col("page_id") * 1.75).alias("size"))
        for n, kind in (("up", F.lit("upload")), ("link", F.lit("link")), ("none", F.lit(None).cast("string")))
    ]
    return pages.select(F.to_json(F.struct(F.struct(F.array(*each).alias("resources")).alias("result"))).alias("document"))


_URL = f"CASE WHEN page_id % 5 = 0 THEN 'https://portal.example.org/short' ELSE 'https://portal.example.org/dataset/' || page_id || '/resource/' || {_RID} || '/download/data.csv' END"


@_register(f"""WITH d AS (SELECT json_object('resources', json_array(json_object('name', 'up' || page_id, 'url', {_URL}, 'url_type', 'upload', 'size', page_id * 1.75), json_object('name', 'link' || page_id, 'url', {_URL}, 'url_type', 'link', 'size', page_id * 1.75))) AS j FROM pages),
r AS (SELECT unnest(CAST(json_extract(j, '$.resources') AS JSON[])) AS r FROM d)
SELECT json_extract_string(r, '$.name') AS name, json_extract_string(r, '$.url') AS url, CAST(trunc(CAST(json_extract(r, '$.size') AS DOUBLE)) AS BIGINT) AS size FROM r WHERE json_extract_string(r, '$.url_type') = 'upload'""")
def ckan_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ckan.resources(_portal(spark, sf_dir))


@_register(f"""SELECT 'up' || page_id AS name, CASE WHEN page_id % 5 = 0 THEN '' ELSE '/srv/portal/resources/' || substr({_RID}, 1, 3) || '/' || substr({_RID}, 4, 3) || '/' || substr({_RID}, 7) END AS path FROM pages""")
def ckan_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ckan.resources(_portal(spark, sf_dir)).select("name", ckan.storage_path(F.col("url"), "/srv/portal/").alias("path"))


@_register(f"WITH t AS (SELECT 'doc' || doc_id AS path, text FROM documents), r AS ({_small('text')}) SELECT path, content FROM r WHERE content IS NOT NULL")
def keyword_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords in bytes that are no UTF-8: a Latin-1 letter before each text, and half a character after it."""
    rows = _texts(spark, sf_dir).withColumn("bytes", F.concat(F.unhex(F.lit("E9")), F.col("text").cast("binary"), F.unhex(F.lit("C3"))))
    found = checks.keyword_findings(text.as_text(F.col("bytes")), F.lit(0), _CONFIG)
    return rows.select("path", F.explode(found).alias("content"))


def _conversation_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a zip, tar or tar.gz archive, its turns as members.

    Turns come sorted, conversation after conversation, and archives are handed on in batches of 1 MB,
    so that a task holds a few turns, one archive and one batch, however many it packs.
    """

    def pack(batches):
        import io
        import tarfile
        import zipfile
        from itertools import groupby

        import pyarrow as pa

        def turns():
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    yield from zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True)

        def packed(kind, members):
            buffer = io.BytesIO()
            if kind == ".zip":
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, content in members:
                        z.writestr(name, content)
            else:
                with tarfile.open(fileobj=buffer, mode="w:gz" if kind == ".tar.gz" else "w:") as t:
                    for name, content in members:
                        i = tarfile.TarInfo(name)
                        i.size = len(content)
                        t.addfile(i, io.BytesIO(content))
                        t.members.clear()  # else it keeps them all
            return buffer.getvalue()

        def handed(rows):
            paths, names, data = zip(*rows, strict=True)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(names, pa.string()), pa.array(names, pa.string()), pa.array(data, pa.binary())], names=["path", "name", "display_name", "content"])

        rows, held = [], 0
        for key, own in groupby(turns(), lambda t: t[0]):
            kind = ".tar.gz" if key is None or key % 3 and key < 0 else (".zip", ".tar", ".tar.gz")[key % 3]  # SQL's remainders have the sign of what is divided
            path = None if key is None else f"conv{key}{kind}"
            rows.append((path, path or kind, packed(kind, ((f"{role}/{turn}.txt", (text or "").encode()) for _, turn, role, text in own))))
            held += len(rows[-1][-1])
            if held >= 1 << 20:
                yield handed(rows)
                held = 0
        if rows:
            yield handed(rows)

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", *[F.col(c).asc_nulls_last() for c in ("turn", "role", "text")])
    return ordered.mapInArrow(pack, "path string, name string, display_name string, content binary")


_ARCHIVES = """a AS (SELECT *, 'conv' || conv_id || CASE conv_id % 3 WHEN 0 THEN '.zip' WHEN 1 THEN '.tar' ELSE '.tar.gz' END AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS ord, strlen(text) AS size FROM conversations)"""


@_register(f"WITH {_ARCHIVES} SELECT path, CAST(ord AS INTEGER) AS ord, role || '/' || turn || '.txt' AS member, size, false AS is_dir FROM a")
def archive_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of zip, tar and tar.gz archives, from the archives' bytes."""
    return read_members(_conversation_archives(spark, sf_dir)).select(F.col("archive_path").alias("path"), "ord", "member", "size", "is_dir")


_TWICE = "CASE WHEN s.path LIKE '%.zip' THEN 2 ELSE 1 END * b.u + s.size <= 700"


@_register(f"""WITH RECURSIVE {_ARCHIVES},
s AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ord) AS k FROM a WHERE size > 0 AND size <= 300),
b AS (SELECT path, k, ord, size <= 700 AS ok, CASE WHEN size <= 700 THEN size ELSE 0 END AS u FROM s WHERE k = 1
UNION ALL SELECT s.path, s.k, s.ord, {_TWICE}, b.u + CASE WHEN {_TWICE} THEN s.size ELSE 0 END FROM b JOIN s ON s.path = b.path AND s.k = b.k + 1)
SELECT a.path, a.role || '/' || a.turn || '.txt' AS member, a.text AS content FROM a JOIN b ON a.path = b.path AND a.ord = b.ord WHERE b.ok""")
def archive_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of the members of up to 300 bytes that a budget of 700 bytes an archive admits, decided while unpacking."""
    rows = read_members(_conversation_archives(spark, sf_dir), Gate(largest=300, budget=700)).where("content is not null and archive_path is not null")
    return rows.select(F.col("archive_path").alias("path"), "member", F.col("content").cast("string").alias("content"))


@_register("""WITH t AS (SELECT unnest(['IsFreeOfKeywords', 'HasValidNameLength', 'HasReadMe', 'IsValidName', 'HasNoWhiteSpace']) AS checkname)
SELECT checkname, CASE checkname WHEN 'IsFreeOfKeywords' THEN 'Possible sensitive content detected' WHEN 'HasValidNameLength' THEN 'File name too long' WHEN 'HasReadMe' THEN 'Missing README file' ELSE checkname END AS title FROM t""")
def check_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(c,) for c in ("IsFreeOfKeywords", "HasValidNameLength", "HasReadMe", "IsValidName", "HasNoWhiteSpace")], "checkname string")
    return rows.select("checkname", m.title(F.col("checkname")).alias("title"))


@_register("SELECT p_partkey, CASE WHEN strlen(p_name) > 20 THEN p_name[:17] || '...' ELSE p_name END AS short FROM part")
def message_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, which are ASCII, as findings that are cut at 20 bytes."""
    return _table(spark, sf_dir, "part").select("p_partkey", m.shortened(F.col("p_name"), 20).alias("short"))


@_register("SELECT doc_id, contains(lower(text), 'token') OR contains(lower(text), 'bearer') OR contains(lower(text), 'mit') AS hit FROM documents")
def keyword_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords that are given as one string, with bars between them."""
    return _table(spark, sf_dir, "documents").select("doc_id", text.any_match(F.col("text"), text.keyword_list("token|Bearer|MIT")).alias("hit"))


@_register("SELECT doc_id, contains(text, lang) AS hit, true AS every FROM documents")
def byte_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain search in bytes; the empty pattern is in all."""
    return _table(spark, sf_dir, "documents").select("doc_id", text.has_bytes(F.col("text"), F.col("lang")).alias("hit"), text.has_bytes(F.col("text"), F.lit("")).alias("every"))


@_register(f"""WITH {_M}, l AS (SELECT subject, test, content, row_number() OVER (PARTITION BY subject ORDER BY ord DESC) AS k FROM mk),
s AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN source || '.zip > ' ELSE '' END || source || '/' || {_FIRST_LINE} AS subject FROM documents)
SELECT s.subject, l.test AS test_name, l.content FROM s LEFT JOIN l ON s.subject = l.subject AND l.k = 1""")
def subject_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last finding of each file says."""
    name = F.concat_ws("/", "source", F.substring_index("text", "\n", 1))
    files = _table(spark, sf_dir, "documents").select(F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit(".zip > "))).otherwise(""), name).alias("subject"))
    return report.subject_details(_messages(spark, sf_dir), files.distinct())


@_register(f"WITH l AS (SELECT 'doc' || doc_id AS path, text FROM documents) {_LARGE}")
def keyword_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords in texts that come in chunks of 700 characters with an overlap of 50: what is found in several chunks is found once."""
    rows = _texts(spark, sf_dir).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / 700).cast("int"))))
    first = F.greatest(F.lit(0), F.col("chunk") * 700 - 50)
    rows = rows.withColumn("content", F.substring(F.col("text"), first + 1, (F.col("chunk") + 1) * 700 - first).cast("binary")).withColumn("error", F.lit(None).cast("string"))
    return checks.chunk_messages(rows, _CONFIG).select("path", "content")


@_register("SELECT 'Warning for file ''doc' || doc_id || ''': slow to read' AS message FROM documents WHERE strlen(text) > 20000")
def large_file_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.large_file_warnings(_texts(spark, sf_dir), 20_000, "slow to read")


@_register(f"WITH {_M} SELECT subject FROM mk ORDER BY ord LIMIT 1")
def first_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a viewer shows first."""
    return report.first_subject(_messages(spark, sf_dir))


@_register(f"WITH {_M} SELECT test AS checkname, display AS subject, coalesce(path, '') AS path, archive AS archive_name, content AS message FROM mk")
def report_issue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.issue_rows(_messages(spark, sf_dir))
