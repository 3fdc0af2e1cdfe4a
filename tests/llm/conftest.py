import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, held_out string, size string, row string, uid string, band string, entry string, word string"

LONG = "alpha beta gamma delta " * 5000


@pytest.fixture(scope="session")
def odd_texts():
    """Texts with everything that a reader of texts may trip over."""
    return [
        None, "", " ", "\n\n", "\t\x0b\x0c\r ", "a", "A", "a b", "A  B", "a b c d e f g", "one two three four five six seven eight nine ten",
        "One two three four five six seven eight nine ten", "one two three four five six seven eight nine ten eleven", LONG, LONG + "x", "é è ü ß İ Σ σς ﬁ 東京 🙂  x y \x1c z",
        "x" * 30000, "<|endoftext|> <|startoftext|>x", "don't we'll I'M 123 45.6 --- !!! #*$%&|<>", "line\nline\nline\nother\n", "\x00 ﻿ a​b",
        "é é", "a b c a b c a b c", "http://x.y/z?q=1#f", "𝒳𝒴 ẹ̇", "q" * 97 + " " + "ab" * 60,
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    """The odd texts as documents: nulls in every column, repeated rows and ids, columns with names the operators use."""
    rows = [(i, t, "en", "web", len(t or ""), "h", "s", "r", "u", "b", "e", "w") for i, t in enumerate(odd_texts)]
    rows += [rows[5], rows[5], rows[13]]  # repeated rows
    rows += [(None, "a b", None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    rows += [(7, "another text for number seven", "en", None, 3, None, None, None, None, None, None, None)]  # an id again
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
