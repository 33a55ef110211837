import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, digest string, size string, _row string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def cases():
    """(doc_id, text, source): nulls, empty and long texts, copies, near copies, repeated rows, odd characters."""
    rng = random.Random(7)
    base = [words(rng, 12) + ".\n" + words(rng, 15) + ". " + words(rng, 14) + "." for _ in range(6)]
    long = ". ".join(words(rng, 9) for _ in range(900)) + "."
    near = words(rng, 120).split(" ")
    other = near[:60] + ["changed"] + near[61:]
    rows = [(i, text, f"src{i % 2}") for i, text in enumerate(base)]
    rows += [
        (10, base[0], "src0"), (11, base[0], "src1"), (11, base[0], "src1"), (12, None, "src0"), (13, "", None),
        (14, "  \n\t ", "src0"), (15, long, "src0"), (16, " ".join(near), "src1"), (17, " ".join(other), None),
        (18, "One Two Three", "src1"), (19, "one two three", "src1"), (20, "Größe 日本 😀 it's <x> $5\r\n#", "src2"),
        (None, "a row without an id", "src2"), (22, base[1] + "\n" + base[2], "src0"), (23, "x", None), (24, "x y", "src2"),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, cases):
    rows = [(i, t, None if i == 3 else "en", s, None if t is None else len(t), "k", "d", "s", "r") for i, t, s in cases]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
