import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, row long, fp long, score double, spans string, `key` string, `a.b` string"
WORDS = "the of and to in river stone light makes carries slowly under north seven letter paper music".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids, null, empty and long texts, repeated rows, copies, and columns whose names clash with those used inside."""
    rng = random.Random(5)
    texts = [None, "", " \t\n", "one", "one two", prose(rng, 60), prose(rng, 60), "é漢😀 " * 30, prose(rng, 9000) + " token=abcdef123"]
    texts += ["a copied text with a few words in it"] * 6 + [prose(rng, rng.randint(1, 200)) for _ in range(40)]
    rows = [(i, t, "en", f"src{i % 23}" if i % 7 else None, None, "doc", 1, 1, 0.5, "x", "k", "ab") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id", None, None, None, None, None, None, None, None, None, None), (None, None) + (None,) * 10]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
