import pytest

#: Columns whose names the operators also use inside.
DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "fp long, row long, key string, size int, size_ string, label string, c0 string, `hash` string, `a.b` int"
)
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), 1, 2, "k", 3, "z", "l", "c", "h", 4)


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing extra columns."""
    words = "the quick brown fox jumps over the lazy dog and runs away from all of it"
    rows = [
        doc(1, None), doc(2, ""), doc(3, " \n\t "), doc(4, words), doc(4, words), doc(5, words + " now", "de", "t"),
        doc(6, LONG, "de", None), doc(None, "no id here at all", None, None), doc(None, None, None, None),
        doc(7, "12345 ... 999", None, "t"), doc(8, words, "en", "t"), doc(9, "ß é 日本語 😀 \u0000 x", "fr", "u"),
        (None,) * 14,
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def table(spark):
    def read(name, scale="sf0.001"):
        return spark.read.parquet(f"/root/testdata/{scale}/{name}.parquet")

    return read
