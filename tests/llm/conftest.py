import pytest

SMALLEST = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def tables(spark):
    """Writes tables and gives their folder."""
    import os
    import tempfile
    import uuid

    base = tempfile.mkdtemp()

    def write(**named):
        folder = os.path.join(base, uuid.uuid4().hex)
        for name, df in named.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return folder

    return write


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, bucket int, kept string"


@pytest.fixture(scope="session")
def odd(spark, tables):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and
    columns whose names clash with those of the operators."""
    long = " ".join(f"w{k % 4000}" for k in range(60_000)) + "\nLicensed under CC BY 4.0."
    rows = [
        (1, "one two three four five six", "en", "s", 3, "x", 1, "k"), (1, "one two three four five six", "en", "s", 3, "x", 1, "k"), (2, None, None, None, None, None, None, None),
        (3, "", "en", "s", 0, "x", 1, "k"), (None, "one two three four five six", "fr", "s", 1, "x", 1, "k"), (5, " \n\t ", "de", "s", 1, "x", 1, "k"),
        (6, long, "en", "s", 1, "x", 1, "k"), (7, long, "en", "s", 1, "x", 1, "k"), (8, "Ünï <|endoftext|> don't 12.5% 日本語 \x01 ΣΑΣ İ 😀 a\xa0b", "xx", "s", 1, "x", 1, "k"),
        (9, "a a a a a a a a", "en", "s", 1, "x", 1, "k"), (10, "12 34 ... !!", "en", "s", 1, "x", 1, "k"),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (None, 1, 0), (6, 1, None), (9, None, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "w5 w6 w7 w8 w9 w10"), (1, "w5 w6 w7 w8 w9 w10"), (2, None), (3, ""), (None, "three four five six"), (4, "zz")], "item_id long, text string")
    pages = spark.createDataFrame([(1, "u", "a" * 1000), (2, "u", "a" * 1000), (2, "u", "a" * 1000), (3, "u", None), (4, None, ""), (None, "u", "zz"), (5, "http://x/ y", "é\r\n\r\n" * 300), (1, "u", "a" * 1000)], "page_id long, url string, html string")
    pages = pages.selectExpr("*", "'x' AS size", "1 AS sha1", "'n' AS number", "0 AS chunk", "'p' AS payload", "true AS revisit")
    return rows, tables(documents=docs, labels=labels, benchmark=bench, pages=pages)


@pytest.fixture(scope="session")
def nothing(spark, tables):
    empty = lambda schema: spark.createDataFrame([], schema)
    return tables(documents=empty(DOCS), labels=empty("doc_id long, quality int, toxic int"), benchmark=empty("item_id long, text string"), pages=empty("page_id long, url string, html string"))
