import random

import pytest

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, _k bigint, c0 string, h int, node string, _spans int, keep string, size int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) + r.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


def frame(spark, rows):
    """Documents with more columns, whose names are those that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, None, 2, "x", 3, "y", 4) for i, t in rows], DDL)


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null ids, a very long text, ties and repeated rows."""
    long = prose(1, 60_000)
    return [
        (1, None), (2, ""), (None, "a text without an id, as it may come"), (None, None), (3, " \n\t"), (4, "one"), (5, long), (6, "x" * 50_000),
        (7, prose(2, 150)), (7, prose(2, 150)), (8, prose(2, 150)), (9, "日本語のテキスト 🙂 é ß"), (10, "!!! ??? ..."), (4, "one"), (11, "word " * 300),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
