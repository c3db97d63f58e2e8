import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that clash with names used inside the operators.
CLASHING = ["id", "n", "set", "row", "score", "word", "words", "k0", "x0", "c0", "y", "copy", "raw", "unit", "gram", "label", "spans"]


def sentence(draw: random.Random, n: int) -> str:
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and clashing column names."""
    draw = random.Random(5)
    plain = sentence(draw, 60)
    rows = [
        (1, plain, "en", "a", len(plain)),
        (1, plain, "en", "a", len(plain)),
        (2, plain, "en", "b", len(plain)),
        (3, plain + " " + sentence(draw, 3), None, None, None),
        (4, None, "en", "a", 0),
        (5, "", "en", "a", 0),
        (6, " \n\t ", "en", "a", 4),
        (None, sentence(draw, 40), None, None, None),
        (None, None, None, None, None),
        (7, sentence(draw, 60_000), "en", "a", 300_000),
        (8, "x" * 50_000, "en", "a", 50_000),
        (9, "one", "en", "c", 3),
        (10, "one two", "en", "c", 7),
        (11, "ONE two", "en", "c", 7),
        (12, "naïve Ünïcode  text\nwith ſ and K signs", "en", "c", 40),
        (13, "\n".join([sentence(draw, 12)] * 8), "en", "c", 400),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for i, name in enumerate(CLASHING):
        df = df.selectExpr("*", f"{i} AS {name}")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (7, 0, 0), (8, 0, 1), (None, 1, 0), (13, None, 0), (1, 0, 0), (99, 1, 0)],
        "doc_id bigint, quality int, toxic int",
    )


@pytest.fixture(scope="session")
def near_docs(spark):
    """Families of edited copies of all sizes, with pairs on both sides of the limit."""
    draw = random.Random(9)
    rows, i = [], 0
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 33, 47, 64, 90, 150, 300]:
        for _ in range(3):
            base = sentence(draw, size).split()
            for _ in range(6):
                words = list(base)
                for _ in range(draw.randint(0, max(1, size // 20))):
                    what, at = draw.random(), draw.randrange(len(words))
                    if what < 0.4:
                        words[at] = sentence(draw, 1)
                    elif what < 0.7:
                        words.insert(at, sentence(draw, 1))
                    elif len(words) > 1:
                        del words[at]
                if draw.random() < 0.3:
                    words = words[: max(1, int(len(words) * draw.uniform(0.7, 1)))]
                rows.append((i, " ".join(words), "en", "a", 0))
                i += 1
    draw.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)
