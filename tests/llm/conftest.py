import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def pytest_configure(config):
    config.addinivalue_line("markers", "llm: the training-data subpackage")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows and ids, one long text, odd
    white space, letters beyond the basic plane."""
    long = " ".join(f"w{i % 5003}" for i in range(60_000))
    texts = [None, "", " \t\r\n\x0b\x0c ", "one", "one two three four five", "ONE two\x0bthree\x0cfour five", "a b \U0001f600 Été " * 9, "x " * 200, long, "line one is here and it is long enough to count\nline two is here and it is long enough too\n\n" * 3]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], rows[9], (None, texts[4], None, None, None), (None, None, None, None, None), (20, texts[9], None, None, 1), (21, texts[8], "de", "s1", 5)]
    return spark.createDataFrame(rows, DOCUMENTS).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER if lower else {}))


@pytest.fixture(scope="session")
def clashing():
    """Adds columns whose names the operators use inside."""

    def add(df):
        from pyspark.sql import functions as F

        names = ["marks", "firsts", "words", "kept", "n", "id", "label", "bands", "rank", "host", "__n_lines", "grams", "mark", "shard", "digest", "rep", "pivot", "hash"]
        return df.withColumns({c: F.lit("x") for c in names})

    return add
