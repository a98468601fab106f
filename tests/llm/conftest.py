import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

# Rows that every operator must survive: nulls, empty texts, repeats, odd characters.
ODD = [
    (1, "The cat sat on the mat and the dog ate the bone.", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "  \n\t ", "en", "a", 5),
    (5, "12345 !!! ---", "en", "a", 5),
    (6, "THE cat sat on the mat and the dog ate the bone.", "en", "b", 10),
    (7, "École ÉTÉ 中文 字符 \u0000 \U0001f600 ß", "fr", "b", 9),
    (7, "École ÉTÉ 中文 字符 \u0000 \U0001f600 ß", "fr", "b", 9),
    (None, "a row without identifier", "en", "c", 3),
    (9, "word " * 30_000, "en", "c", 150_000),
    (10, "x" * 50_000, "en", "c", 50_000),
]


@pytest.fixture
def odd(spark):
    """The odd rows, with further columns whose names clash with those of the operators' results."""
    from netquill.llm.common import prepare

    prepare(spark)
    d = spark.createDataFrame(ODD, SCHEMA)
    names = ("score", "n_tokens", "id", "at", "node", "labels", "keep_id", "digest", "fingerprint", "start", "predicted", "item_id", "verdict", "host", "words", "key", "payload", "n")
    from pyspark.sql import functions as F

    return d.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture
def empty(odd):
    return odd.limit(0)
