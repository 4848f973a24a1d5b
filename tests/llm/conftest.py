import random

import pytest

CLASH = "doc_id long, text string, source string, n_chars long, size string, SCORE double, shard string, kept string, h1 long, node long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeghilmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    rng = random.Random(5)
    long_text = "\n".join(prose(rng, 60) for _ in range(300))
    base = [prose(rng, 40) + "\n" + prose(rng, 15) for _ in range(12)]
    rows = [(i, t, f"s{i % 3}", len(t), "x", 0.5, "y", "z", 1, 2) for i, t in enumerate(base)]
    rows += [(20, base[0], "s0", None, None, None, None, None, None, None)] * 3
    rows += [(21, base[0] + " more", None, 3, None, None, None, None, None, None)]
    rows += [(22, None, "s1", None, None, None, None, None, None, None), (23, "", "s1", 0, None, None, None, None, None, None)]
    rows += [(24, " \n\t\n", None, 4, None, None, None, None, None, None), (25, long_text, "s2", len(long_text), None, None, None, None, None, None)]
    rows += [(None, base[1], "s2", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    rows += [(26, "one two", "s0", 7, None, None, None, None, None, None), (26, "three", "s0", 5, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, CLASH).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], CLASH)
