import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000
ROW = "the quick brown fox jumps over the lazy dog and runs away from every river it meets"


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, ROW, "en", "a", 1),
        (2, ROW + " today", "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "de", "b", 0),
        (5, " \t\n ", "xx", "b", 4),
        (6, LONG, "en", "c", len(LONG)),
        (None, ROW, "en", None, 1),
        (7, "short", "fr", "c", 5),
        (7, "short", "fr", "c", 5),
        (8, "Grüße aus Köln, ça va bien? Señor ¡hola! 你好 世界 привет", "de", "a", 9),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clashing = """kept n_words size n_dropped label component keep own_id text_hash row pos spread first keeper _id _th _m
    _size _pass _at _rows _source position target taken ids route bucket before set_id n_shingles measures starts""".split()
    return df.selectExpr("*", *[f"{k} AS {name}" for k, name in enumerate(clashing)])


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
