import pytest
from pyspark.sql import types as T

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table of (doc_id, text[, lang[, source]]) rows, with columns of other names besides."""
    def make(rows, schema=DOCS):
        full = [(*r, *[None] * (5 - len(r))) for r in rows]
        frame = spark.createDataFrame(full, schema)
        # names that operators might use themselves
        from pyspark.sql import functions as F
        return frame.select("*", *[F.lit(1).alias(n) for n in ("words", "n", "h", "kept", "component_id", "score", "Text2")])

    assert T
    return make


ODD = [
    (1, None), (2, ""), (3, " \t\n \r\x0b\x0c"), (4, "one"), (4, "one"), (None, "no id here"), (None, None),
    (5, "a b c a b c a b c"), (6, "x\n\nx\n x\ny"), (7, "Ünï çödé 漢字 🙂 \x1c\x85 <|endoftext|>"),
    (8, "word " * 3000), (9, "a" * 30000), (10, "tie tie tie"), (11, "tie tie tie"),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD
