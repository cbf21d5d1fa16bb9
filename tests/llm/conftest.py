import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_words import words  # noqa: E402

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(4)
    base = words(rng, 120)
    rows = [
        (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n\t ", None, "s", 3), (4, "one", "en", None, None),
        (5, base, "en", "s", 5), (6, base, "de", "s", 5), (7, base.replace("ka", "KA", 1), "en", "s", 5), (8, base, "en", "s", 5), (8, base, "en", "s", 5),
        (9, LONG, "en", "s", 1), (10, words(rng, 80) + "\n" + base, None, None, None), (11, "mail a.b@c.example.org now 日本 ©", "fr", "s", 1),
        (None, words(rng, 60), "en", "s", 2), (None, None, None, None, None), (12, words(rng, 60), "es", "s", 2),
    ]
    extra = "id long, key string, component string, h string, w string, n string, s string, ids string, terms string, score string, rejected string, margin string, base string"
    names = "doc_id long, text string, lang string, source string, n_chars long, " + extra
    return spark.createDataFrame([(*r, 1, *["x"] * 12) for r in rows], names)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
