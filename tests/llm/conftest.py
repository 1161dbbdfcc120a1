import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and long texts, ties, repeated rows and ids."""
    prose = "The river and the stone, they say, have never met before. " * 3
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [
        (1, prose, "en", "a", len(prose)), (1, prose, "en", "a", len(prose)),
        (2, prose, "en", None, len(prose)), (3, None, None, None, None), (4, "", "en", "a", 0),
        (5, " \n\t ", "fr", "b", 4), (None, "no id here, only a few words of text in this one row", "en", "a", 52),
        (6, long, "en", "a", len(long)), (7, "!!! ??? 123", "de", "c", 11), (8, "x", None, "c", 1),
        (2, "another text under an id that is taken already, with words enough to be kept", "en", "a", 76),
        (9, "日本語 🎉 é\x00 ﬁ  two  spaces\r\n", "fr", "b", 26),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Columns with the names of outputs."""
    names = ["score", "kept", "fp", "piece", "spans", "quality", "high", "bucket", "length", "tile"]
    return odd.withColumns({n: F.lit("mine") for n in names})


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture
def folder(tmp_path, odd, none, documents):
    """Tables as a query finds them: call with a frame of documents."""

    def of(docs, labels=None, pages=None):
        path = str(tmp_path / "sf")
        docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
        if labels is not None:
            labels.write.mode("overwrite").parquet(f"{path}/labels.parquet")
        if pages is not None:
            pages.write.mode("overwrite").parquet(f"{path}/pages.parquet")
        return path

    return of
