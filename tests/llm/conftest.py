import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "row string, id string, fp long, words string, size long, doc string, guess string, label string")


def doc(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), "r", "i", 7, "w", 9, "d", "g", "l")


EDGE = [
    doc(1, None), doc(2, ""), doc(3, " \t\n\x0b\f\r "), doc(4, "one"), doc(5, "Two words"),
    doc(6, "The quick brown fox jumps over the lazy dog again and again. " * 3),
    doc(7, "The quick brown fox jumps over the lazy dog again and again. " * 3),
    doc(8, "the QUICK brown fox jumps over the lazy dog again and again. " * 3, None, None),
    doc(None, "a text without an id, but with words enough to count.", "fr", None),
    doc(None, None, None, None),
    doc(9, "repeated row"), doc(9, "repeated row"),
    doc(10, "very long " * 60_000, "de", "b"),
    doc(11, "İstanbul K ſ é 中文 ́ <|endoftext|>   x y", "tr", "Z"),
    doc(12, "x" * 300_000, "en", "b"),
    doc(13, "12345 !!! ... 67", "en", "c"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(EDGE, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some_docs(spark):
    """(doc_id, text, lang, source) of the small table as Python rows."""
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet")
            .select("doc_id", "text", "lang", "source").collect()]
