import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs in every column, empty and long texts, ties, repeated rows, and columns with names the operators use."""
    clean = "The river ran past the old mill and the miller sat by the door, counting sacks of flour while his daughter sang. " * 1
    words = clean.split()
    varied = " ".join(f"{w}{i % 7 if i % 5 == 0 else ''}" for i, w in enumerate(words * 6))
    rows = [
        (1, clean + varied, "en", "a", 1, "x", 0),
        (2, clean + varied, "en", "a", 1, "x", 0),
        (2, clean + varied, "en", "a", 1, "x", 0),
        (3, "", "en", "a", 0, "x", 0),
        (4, None, None, None, None, None, None),
        (None, clean, "en", "b", 1, "y", 1),
        (5, "   \n\t ", "en", "b", 5, "y", 1),
        (6, "word " * 20_000, "en", "b", 100_000, "y", 1),
        (7, "x" * 200_000, "de", "c", 200_000, "y", 1),
        (8, "one two", "de", "c", 7, "z", 2),
        (9, "One TWO", "de", "c", 7, "z", 2),
        (10, "Zoë naïve 你好 🙂 \x00 ▁ end", "fr", "c", 10, "z", 2),
        (11, clean.replace("river", "brook") + varied, "en", "a", 1, "x", 0),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long, pattern string, node long").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
