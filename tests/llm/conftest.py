import pytest

SF = "/root/testdata/sf0.001"
#: Nulls, empty and long texts, ties, repeated rows and other columns, some with names that operators use.
ROWS = [
    (1, "one two three four five six", "en", "s1"),
    (2, "one two three four five six", "en", "s1"),
    (2, "one two three four five six", "en", "s1"),
    (3, None, None, None),
    (4, "", "en", "s2"),
    (5, " \t\n", None, "s2"),
    (6, "word " * 30000, "en", "s3"),
    (None, "a text without an id", "fr", None),
    (7, "12 34 !! %%", "de", "é"),
    (8, "x" * 50000, "es", "s1"),
    (9, "ONE two THREE four five six", "en", "s4"),
]
EXTRA = ["n", "node", "size", "target", "score", "block", "rank", "bytes", "__text", "ids", "pass", "count", "key", "weak", "spans", "length", "bucket", "kept"]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, 0 if r[1] is None else len(r[1]), *["x"] * len(EXTRA)) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in EXTRA))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
