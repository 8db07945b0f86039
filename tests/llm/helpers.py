"""Documents with what operators must bear: nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = DOCS + ", host string, line string, id bigint, bin string, size int, score double, toxic int, group_id bigint, `a.b` string"


def awkward(spark, extra=()):
    """Rows with nulls in each column, an empty and a very long text, and a row that is repeated."""
    rows = [
        (1, "one two three\nfour", "en", "s", 18),
        (1, "one two three\nfour", "en", "s", 18),
        (2, None, "en", "s", None),
        (3, "", None, None, 0),
        (None, "five six seven", "en", "s", 14),
        (4, "long " * 60_000, "en", "s", 300_000),
        (5, "x" * 200_000, None, "t", 200_000),
        (6, " \n\t ", "xx", "t", 4),
        *extra,
    ]
    return spark.createDataFrame(rows, DOCS)


def clashing(spark):
    return spark.createDataFrame([(1, "one two", "en", "s", 7, "h", "l", 9, "b", 3, 0.5, 1, 8, "dot"), (2, "three four", "en", "s", 10, None, None, None, None, None, None, None, None, None)], CLASHING)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or [f"`{c}`" for c in df.columns]).collect()), key=repr)
