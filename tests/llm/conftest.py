import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents with nulls in every column, empty and very long texts, ties and repeated rows, clashing extra columns."""

    def make(rows=None):
        long = "word thing other " * 4000
        rows = rows if rows is not None else [
            (1, "one two three four five six seven eight nine ten", "en", "a", 1),
            (1, "one two three four five six seven eight nine ten", "en", "a", 1),
            (1, "another text under the same id", "en", "a", 1),
            (2, None, None, None, None),
            (3, "", "de", "b", 0),
            (4, " \n\t", "de", None, 0),
            (None, "a text without an id", None, "b", 3),
            (None, "a text without an id", "fr", "b", 3),
            (5, long, "en", "a", len(long)),
            (6, "Ünïcode 文字 \U0001f600 line\nline\nline", "fr", "c", 9),
        ]
        df = spark.createDataFrame(rows, SCHEMA)
        return df.selectExpr("*", "n_chars AS h", "source AS fp", "lang AS word", "n_chars AS size", "source AS id", "source AS unit", "n_chars AS x", "lang AS y")

    return make
