import pytest

WORDS = "the river runs under an old stone bridge and carries leaves of many colours past the quiet mill where nobody has worked since last winter ended".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) * (rng.random() < 0.05) + "abcdefgh"[rng.randint(0, 7)] for _ in range(n))


@pytest.fixture
def rows():
    """doc_id, text, lang, source, n_chars and columns with clashing names: nulls, empty and long texts, ties, repeated rows."""
    base = [(k, prose(k, 40 + k), "en", f"s{k % 3}", 0, k, "x") for k in range(30)]
    odd = [(100, None, "en", "s0", None, 1, None), (101, "", None, None, 0, None, "y"), (102, prose(7, 30_000), "de", "s1", 0, 2, "z"), (103, " \n\t ", "en", "s2", 4, 3, "z"), (None, "a text without an id that is here", "fr", "s2", 0, 4, "w")]
    return base + odd + [base[3], base[3], (104, base[5][1], "en", "s9", 0, 5, "v")]


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, length bigint, node string").repartition(3)


@pytest.fixture
def none(docs):
    return docs.where("1 = 0")
