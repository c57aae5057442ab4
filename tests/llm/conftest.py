"""A small corpus with nulls, empty and very long texts, ties, repeated rows and clashing column names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _pk_id long, shard string, src string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows():
    rng = random.Random(3)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [(1, base), (2, base.upper()), (3, " ".join(near)), (4, base), (5, ""), (6, None), (7, "one"), (8, "ONE"), (9, " \n\t "),
            (10, words(rng, 30)), (10, words(rng, 30)), (11, "same text here"), (11, "same text here"), (None, words(rng, 40)), (None, "x y z"),
            (12, words(rng, 6000)), (13, "you idiot moron scum " + words(rng, 20)), (14, "mail a.b@c-d.org or +1 (234) 567-8901, 10.0.0.1"),
            (15, "card 4111 1111 1111 1111 and 4111-1111-1111-1112 é ß 日本 end"), (16, "tie"), (17, "tie"), (18, "w " * 400)]
    out = []
    for i, (d, t) in enumerate(rows):
        src = None if i % 5 == 0 else f"s{i % 3}"
        out.append((d, t, "en", src, None, 7, 8, "x", "y"))
    return out


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(i, int(i not in (18, 7)), int(i == 13), "junk") for i in range(1, 19)] + [(13, 1, 1, "junk"), (None, 1, 1, "junk"), (99, 1, None, "junk")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
