"""Documents with the cases that every operator must stand."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, rank int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, clashing column names."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(300)] + ["Éa", "ÑU", "ß", "日本", "🙂x"]
    text = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", ".", "\n", "\t", "  "]) for _ in range(n))
    rows = [(i, text(r.choice([0, 1, 2, 5, 30, 120])), r.choice(["en", "fr", None]), r.choice(["hot", "hot", "a", "b", None]), 1, "k", 2, 3) for i in range(60)]
    near = text(200)
    rows += [(100 + i, near.replace(" ", "  ", i) + (" tail" if i % 2 else ""), "en", "hot", None, None, None, None) for i in range(12)]
    rows += [(200, None, "en", "a", 0, None, 1, 1), (201, "", None, None, 0, "x", 1, 1), (202, " \n\t ", "en", "a", 3, "x", 1, 1), (None, text(20), "en", "a", 5, "y", 1, 1), (203, text(4000), "en", "a", 5, "y", 1, 1)]
    rows += [rows[3], rows[3], rows[70]]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
