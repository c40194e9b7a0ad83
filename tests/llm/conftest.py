import random

import pytest
from pyspark.sql import functions as F

WORDS = "the of and data model train graph river stone light paper green house under over with from city night day".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture
def documents(spark):
    """Documents from texts, or from (doc_id, text) pairs, with columns whose names operators use inside."""
    def make(texts, extra=True):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            names = ("row", "node", "score", "n_words", "_id", "_mark", "key", "label", "spans", "items", "words", "source")
            frame = frame.withColumns({name: F.lit("x") for name in names})
        return frame
    return make


@pytest.fixture
def odd_texts():
    """Null, empty, blank, one word, control characters, repeated rows, a long text, a long word."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "a\x00b \x0b c"), (5, "a\x00b \x0b c"), (None, "no id here"),
            (None, None), (6, prose(1, 30_000)), (7, "x" * 200_000), (8, "É ünï 漢字 😀")]
