"""Awkward documents: nulls in any column, empty and long texts, ties, repeated
rows, an empty table, and columns that clash with the operators' own."""
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, doc string, n_words string, items string"
PROSE = " ".join(f"word{i} and more{i % 7} of it" for i in range(60))
ROWS = [
    (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, PROSE + " tail end", "de", None),
    (4, None, "en", "a"), (5, "", None, "a"), (6, " \t\n ", "fr", "b"), (7, "short one", "en", "b"), (8, "x", "de", "b"),
    (None, "a document without an id " * 9, "en", None), (None, None, None, None),
    (9, "first line of it\nsecond line of it\nthird line here\n\nlast", "en", "c"),
    (10, "first line of it\nsecond line of it\nother line here\n\nlast", "en", "c"),
    (11, "same\nsame\nsame\nsame", "en", "c"), (12, "é ü " * 40 + PROSE.upper(), "de", "d"),
    (13, "long " + " ".join(f"w{i * 7919 % 100003}" for i in range(30_000)), "en", "d"),
    (15, " ".join("".join(chr(97 + (i * k + k) % 26) for k in range(1, 6)) + chr(97 + i // 26) for i in range(90)), "en", "e"),
    (14, "<|endoftext|> Don't we're 'll it's 1234 ... ''s €5 naïve\x1c\x85\xa0x <|STARTOFTEXT|>", "en", "d"),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, l, s, len(t) if t else None, "k", "d", "w", "it") for i, t, l, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
