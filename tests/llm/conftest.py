import pytest

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, fp long, score double"
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it today", "en", "a", 1, 7, True, 3, 0.5),
    (1, "The quick brown fox jumps over the lazy dog and runs away from it today", "en", "a", 1, 7, True, 3, 0.5),
    (1, "same id, other text: éàü ßñ Ünï", None, None, None, None, None, None, None),
    (2, None, "en", "a", None, None, None, None, None),
    (3, "", "fr", "b", 0, 0, False, 0, 0.0),
    (4, " \t\n\r\x0b\x0c", "fr", None, 6, 0, False, 0, 0.0),
    (5, "TheQuick brown fox\njumps over the lazy dog and runs away from it today ", "en", "b", 1, 1, True, 1, 1.0),
    (6, "123 456 !!! ###", None, "b", 1, 1, True, 1, 1.0),
    (7, LONG, "en", "a", 1, 1, True, 1, 1.0),
    (8, LONG + " tail", "en", "a", 1, 1, True, 1, 1.0),
    (None, "row without an id", "en", "a", 1, 1, True, 1, 1.0),
    (9, "one", "en", "c", 1, 1, True, 1, 1.0),
    (10, "a b c 漢字 <|endoftext|> 's '’", "en", "c", 1, 1, True, 1, 1.0),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(DOCUMENTS)
