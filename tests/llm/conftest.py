import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text int, score string, _row int, start string, n string, bucket int"


def rows_of(texts):
    """Documents with extra columns whose names clash with internal ones."""
    return [(i, t, "en" if i is not None and i % 2 else None, f"src{(i or 0) % 3}", None if t is None else len(t), "x", 7, "y", 1, "z", "w", 3) for i, t in texts]


@pytest.fixture(scope="session")
def nasty(spark):
    """Null, empty and blank texts, a very long one, copies, near copies, ties, repeated rows, a row without id."""
    r = random.Random(5)
    word = lambda: "".join(r.choice(["ba", "ko", "ri", "tes", "ü", "na"]) for _ in range(r.randint(1, 4)))
    base = [word() for _ in range(120)]
    near = base.copy()
    near[60] = "changed"
    texts = [(0, None), (1, ""), (2, " \n\t "), (3, " ".join(base)), (4, " ".join(base)), (5, " ".join(near)), (6, "one two"), (7, "one two"), (8, "One TWO"), (9, "word " * 300)]
    texts += [(10, " ".join(word() for _ in range(30_000)))]
    texts += [(11 + k, " ".join(word() for _ in range(r.randint(3, 40))) + "\n" + " ".join(base[20:60])) for k in range(12)]
    texts += [(3, " ".join(base)), (None, " ".join(base)), (30, 'token = "abcdef0123456789abcdef01" AKIA' + "ABCD1234EFGH5678"), (31, 'x password: "hunter2zz" y'), (32, "ſecret: abcdefgh K deadbeefdeadbeefdeadbeef00\x1cend z")]
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
