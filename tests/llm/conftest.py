import random

import pytest

#: A document of each awkward kind: null and empty texts, no letters, repeated rows, equal ids, null ids, a very long text.
WORDS = [f"{a}{b}{c}" for a in "ban cor del fin gol".split() for b in "a e i o".split() for c in "mer tan sil rop".split()]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choices(WORDS, k=n)) + "."


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34 !!", "en", "s", 8), (4, prose(40, 1), "en", "s", 1), (4, prose(40, 1), "en", "s", 1),
        (5, prose(30, 2), "de", None, 2), (5, prose(30, 3), "de", "s", 2), (None, prose(20, 4), "en", "s", 3), (None, None, None, None, None),
        (6, prose(60_000, 5), "en", "s", 4), (7, "a" * 300_000, "en", "s", 5), (8, "one", "de", "s", 3), (9, "é\U0001f600 İx", "de", "s", 4), (10, "\n\n\n", "en", "s", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # columns whose names the operators use themselves
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in ("score", "part", "key", "label", "base", "words", "size", "sid", "predicted", "t", "value")}).cache()


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, i % 3 // 2) for i in range(1, 11)] + [(None, 1, 1), (3, None, None), (4, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").cache()
