import random

import pytest

WORDS = ["the", "of", "river", "stone", "Élan", "über", "night", "small", "garden", "paper", "window", "glass", "over", "under", "seven", "word"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(n))


def make_docs():
    """Null and empty texts, a null id, ties, repeated rows, copies, near copies, a long text, shared passages and lines."""
    rng = random.Random(5)
    shared, line = prose(rng, 90), "\n".join(prose(rng, 6) for _ in range(4))
    rows = [(k, prose(rng, rng.randint(1, 120)), "en", "s") for k in range(20)]
    rows += [(20 + k, prose(rng, 20) + " " + shared + " " + prose(rng, 20), "en", "s") for k in range(4)]
    rows += [(30 + k, prose(rng, 5) + "\n" + line + "\n" + prose(rng, 5), "en", "hot") for k in range(4)]
    rows += [(40, rows[3][1], "en", "s"), (41, rows[3][1], "en", "s"), (41, rows[3][1], "en", "s")]
    rows += [(50, None, "en", "s"), (51, "", "en", "s"), (52, " \n\t ", None, "s"), (53, "%%% ***", "en", None), (None, "no id " + shared, "en", "s")]
    rows += [(60, "ab " * 4000, "en", "s"), (61, prose(rng, 9000), "en", "s"), (62, "x" * 30000, "en", "s")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, rk string").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
