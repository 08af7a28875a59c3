"""A small table of awkward documents: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, word string, key long"


def awkward(spark, extra=()):
    base = "the cat of the house was on a mat and it saw the dog in the garden by the old river "
    rows = [
        (1, base * 3, "en", "a", 1, "x", "y", 1), (2, base * 3, "en", "a", 1, "x", "y", 1), (3, base * 3 + "extra", None, "b", None, None, None, None),
        (4, None, "en", None, 0, "x", "y", 1), (5, "", "fr", "a", 0, "x", "y", 1), (6, "   \n\t ", "fr", "a", 0, "x", "y", 1),
        (7, "Été à la plage, l'eau était belle", "fr", "b", 0, "x", "y", 1), (8, "один два три \U0001f600 é", "ru", "b", 0, "x", "y", 1),
        (9, "word " * 20000, "en", "c", 0, "x", "y", 1), (None, "a row without id", "en", "c", 0, "x", "y", 1),
        (10, "one", "en", "c", 0, "x", "y", 1), (10, "one", "en", "c", 0, "x", "y", 1), (11, "12345 !!! 678", "en", "c", 0, "x", "y", 1),
        *extra,
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
