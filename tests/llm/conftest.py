import random

import pytest

WORDS = ["the", "of", "and", "menteado", "cióngall", "über", "größe", "étre", "hand", "plan", "river",
         "stone", "cloud", "letter", "window", "garden", "silver", "answer", "morning", "table"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): ordinary, odd, empty, null, repeated, near and very long ones."""
    base = prose(1, 120)
    rows = [(i, prose(i + 10, 5 + 7 * i)) for i in range(12)]
    rows += [(20, None), (21, ""), (22, "   \n\t "), (23, "one"), (24, "two words"), (None, base),
             (25, base), (26, base), (27, base + " extra"), (28, base), (28, base),
             (29, "AAAA" * 3000), (30, prose(99, 4000)), (31, "日本語テキスト 🙂🙂 é  x\x85y"),
             (32, "don't we'll  stop \n\n now  "), (33, "x" * 700 + " " + "ab" * 400)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With columns whose names the operators use for their own."""
    rows = [(i, t, "s", "t", 1, "q") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, ids string, "
                                       "part int, score string").repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
