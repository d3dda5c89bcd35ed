import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text_of(seed: int, n: int) -> str:
    """n words that hardly repeat, the same for the same seed."""
    return " ".join(f"{WORDS[(seed * 7 + i * 3) % 20]}{(seed * 131 + i * i * 17 + i) % 9973}" for i in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, words string, spans string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeats, ties, and columns whose names clash with outputs."""
    long = text_of(5, 30_000)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two three four"), (5, text_of(1, 120)), (6, text_of(1, 120)),
            (7, text_of(1, 120) + " " + text_of(2, 3)), (8, text_of(3, 200)), (9, text_of(3, 60) + " " + text_of(4, 90)), (10, long),
            (11, long), (12, "x" * 50_000), (13, "to " * 4000), (14, "Ünï çödé ñ 😀 \x1c \x85 词 " * 30), (15, "one two three four")]
    rows = [(i, t, [None, "en", "de"][i % 3], None, None, 0.5, "w", "s") for i, t in rows]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
