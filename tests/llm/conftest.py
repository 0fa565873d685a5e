import pytest

# Texts that every text operator must take: null, empty, white space, ties, repeats, other scripts.
ODD = [None, "", " \t\n", "a", "A", "the quick brown fox jumps", "The Quick brown fox jumps", "the quick brown fox jumps",
       "ünï ß 日本語 🙂", "x" * 300, "word " * 200, "\x00\x01 nul", "1 2 3 !!! ???", "Éá ÁB"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with null and repeated ids, null lang and source, and further columns with clashing names."""
    rows = [(i, t, "en" if i % 3 else None, "src1" if i % 4 else None, "extra", i) for i, t in enumerate(ODD)]
    rows += [(None, "no id", "en", "src1", "extra", 0), (5, "the quick brown fox jumps", "en", "src2", "extra", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, digest string, part int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def docs_of(spark, texts, first=0, lang="en"):
    return spark.createDataFrame([(first + i, t, lang, "src1") for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string")
