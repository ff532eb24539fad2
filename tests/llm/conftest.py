import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, id string, row string, uid string, rest string, score string, word string"
LONG = "alpha beta " * 30_000


def table(spark, rows, parts=3):
    """Documents with further columns whose names clash with those the operators use."""
    full = [(i, t, "en", "src0", None if t is None else len(t), 7, "x", "y", "z", None, "s", "w") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


ODD_ROWS = [
    (None, "a row without id"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, "same text here"), (6, "same text here"),
    (7, "Same\ttext  here \n\n x"), (8, "éß²Ⅷ \U0001f642 <|endoftext|> \x00 �"), (9, "x" * 5000), (10, prose(1, 300)), (11, prose(1, 300)),
]


@pytest.fixture(scope="module")
def odd(spark):
    frame = table(spark, ODD_ROWS).cache()
    yield frame
    frame.unpersist(blocking=True)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])
