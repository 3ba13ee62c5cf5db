import random

import pytest

WORDS = "the of and river stone light house green walk early paper north silent copper window".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def docs(spark, rng):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing names."""
    long = sentence(rng, 5000)
    body = [sentence(rng, rng.randrange(5, 200)) for _ in range(25)]
    texts = [None, "", "   \n\t ", "word", long, long, "é ü 漢字 🙂 " * 20, *body, body[3], body[3], body[4] + " x", "same line here for everyone\n" * 6 + body[5]]
    rows = [(i, t, f"s{i % 4}" if i % 7 else None, "kept", 1, "x") for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "text without an id " * 10, "s1", "a", 2, "y"), (None, None, None, None, None, None), (9, "another text under a used id", "s2", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, size int, shard string")


@pytest.fixture
def no_docs(docs):
    return docs.where("false")
