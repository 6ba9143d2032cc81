import pytest


@pytest.fixture
def docs(spark):
    """Nulls, empty and blank texts, ties, repeats, a very long text, and extra columns named like our own."""
    line = "This very line is shared by more than five documents, surely."
    long = ("Lorem ipsum dolor sit amet, consetetur sadipscing elitr. " * 4000) + "x" * 5000
    rows = [(1, None), (2, ""), (3, "  \t\n "), (4, "a b c d"), (5, "a b c d"), (6, "ab cd"), (7, " a bc d "), (8, long), (9, long + "!"), (10, "12345 67890 %%%"), (None, "no id"), (12, "é" * 300), (12, "é" * 300)]
    rows += [(20 + i, f"head {i}\n  {line.upper() if i % 2 else line}\t\ntail {i}") for i in range(7)]
    rows += [(40 + i, "the quick brown fox jumps over the lazy dog " * 3 + str(i)) for i in range(4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, run long, score double, key string, salt int"
    return spark.createDataFrame([(d, t, None, "s" if (d or 0) % 3 else None, None, 5, 5, 0.5, "k", 1) for d, t in rows], schema)


@pytest.fixture
def empty(docs):
    return docs.where("false")
