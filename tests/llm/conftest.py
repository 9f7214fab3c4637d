"""Tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""
import pytest

from spendweave.llm.common import release

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, shard int, _row long, key int, length long"


def document(doc_id, text, source="a", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), 7, "clash", 3, 9, 1, 5)


@pytest.fixture(scope="session")
def odd_rows():
    prose = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion of odd colours near the old mill"
    rows = [document(1, None), document(2, ""), document(3, " \t\r\n "), document(4, prose), document(5, prose.replace(" ", "\n")),
            document(6, prose + " today"), document(7, "Ünï – 漢字 😀 tëxt\x85with odd spaces", None), document(8, "word " * 9000, "b", None),
            document(9, "x" * 70_000, "b"), document(10, "Same line of six whole words\nother\nsame  LINE of six whole words", None, "de"),
            document(None, prose), document(None, None, None, None), document(11, "<|endoftext|> & 'quoted' 12,345.6 ### !!!", "c")]
    return rows + [document(12, "repeated row with some words in it", "c")] * 4 + [document(13, "repeated row with some words in it", "é")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 0), (8, 0, 0), (8, 1, 0), (9, 0, 0), (None, 1, 0), (11, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(autouse=True, scope="module")
def clean(spark):
    yield
    release(spark)
