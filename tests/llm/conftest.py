import random

import pytest

WORDS = ["".join(random.Random(k).choice(["ba", "ke", "lo", "mi", "nu", "ré", "so"]) for _ in range(random.Random(k + 1000).randint(1, 3))) for k in range(400)]


def passage(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, self-repeats, benchmark text, nulls, empty and very long texts."""
    long_ = passage(1, 4000)
    near = passage(2, 200).split()
    near2 = list(near)
    near2[50] = "changed"
    shared = passage(3, 90)
    texts = [
        passage(10, 120), passage(10, 120), passage(11, 3), "", None, "   ", long_, " ".join(near), " ".join(near2), f"{passage(20, 60)} {shared} {passage(21, 30)}", f"{passage(22, 10)}\n{shared} {passage(23, 80)}",
        f"{passage(24, 150)}\n{passage(24, 150)}", "AB cd!! " * 40, passage(30, 40) + " " + passage(900, 12) + ". " + passage(31, 5), passage(901, 4), "x" * 3000, passage(33, 49), passage(34, 70),
    ]
    out = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i != 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[0], (None, passage(40, 30), "en", "src0", 9)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def bench(spark):
    return spark.createDataFrame([(1, passage(900, 12)), (2, passage(901, 4)), (3, None), (4, ""), (5, passage(902, 30)), (6, passage(900, 12))], "item_id long, text string")


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with extra columns named like what operators make."""
    from pyspark.sql import functions as F

    names = ("t", "sid", "v", "c", "g", "pos", "size", "place", "pattern", "copies", "cut", "class_id", "label", "n", "score", "held_out", "marks", "path", "key", "digest", "rank")
    return docs.withColumns({c: F.lit(c) for c in names})
