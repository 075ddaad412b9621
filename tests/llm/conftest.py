import random

import pytest

WORDS = [a + b for a in "ba de fi go ku la me no pi ru sa te vo wi xo zu".split() for b in "ber den fil gor kam lon mir nas pel rot".split()]


@pytest.fixture(scope="session")
def prose():
    def make(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def documents(spark):
    def make(texts, **extra):
        rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
