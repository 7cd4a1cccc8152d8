"""Small tables with everything odd in them."""

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # Names that the operators use themselves.
        T.StructField("id", T.StringType()), T.StructField("key", T.IntegerType()), T.StructField("row", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("size", T.LongType()), T.StructField("words", T.StringType()),
    ]
)

WORDS = [f"w{i}" for i in range(400)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_texts() -> list[tuple[int | None, str | None, str | None]]:
    """(id, text, source): copies, near copies, shared passages, short, blank, null and long."""
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 40)
    out: list[tuple[int | None, str | None, str | None]] = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "b"), (5, "one two three four", "b"), (6, "ONE two three four", "b"),
        (7, "Ünïcödé wörds \U0001f600 here and there again", None), (None, base, "a"), (None, base, None),
        (8, base, "a"), (9, base.upper(), "a"), (10, base, "c"), (10, base, "c"),
        (11, "x" * 30_000, "c"), (12, prose(rng, 8_000), "c"), (13, "same " * 3_000, "c"),
    ]
    for i in range(20, 45):  # near copies with a few words changed
        words = base.split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "edit%d" % rng.randrange(1000)
        out.append((i, " ".join(words), "hot"))
    for i in range(50, 60):  # a passage that many share
        out.append((i, f"{prose(rng, 30)}\n{passage}\t{prose(rng, rng.randint(0, 30))}", rng.choice("ab")))
    for i in range(70, 90):
        out.append((i, prose(rng, rng.randint(1, 200)), "hot"))
    return out


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", s, None, "id%s" % i, 7, "r", 0.25, 3, "w") for i, t, s in odd_texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
