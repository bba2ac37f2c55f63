import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Builds documents rows from (doc_id, text), with extra columns whose names clash."""

    def build(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        if extra:
            from pyspark.sql import functions as F

            for name in ("did", "th", "row", "h", "spans", "score", "band", "bucket", "n_lines", "source", "lang"):
                df = df.withColumn(name, F.lit(name))
            df = df.withColumn("n_chars", F.char_length("text").cast("long"))
        return df

    return build


EDGE = [
    (1, None),
    (2, ""),
    (3, "short"),
    (4, "same text here, said twice by two documents, word for word and line for line"),
    (5, "same text here, said twice by two documents, word for word and line for line"),
    (6, "é漢🎵 " * 50),
    (7, "x" * 5000),
    (8, "line one\n\n  Line Two of more than twenty letters \nlast\n"),
    (9, "line two of more than twenty letters\nother"),
    (10, "LINE TWO OF MORE THAN TWENTY LETTERS"),
    (None, "no identifier at all, but some words to read nevertheless"),
]


@pytest.fixture(scope="session")
def edge():
    return EDGE
