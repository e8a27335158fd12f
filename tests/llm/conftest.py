import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, kind int, size string, `set` string, data string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def corpus():
    """(doc_id, text, source): copies, near copies, shared passages, nulls, empty and short texts, a repeated row, one long text."""
    rng = random.Random(7)
    passage, base = words(rng, 60), words(rng, 200)
    texts = [base, base, base.upper(), None, "", "  \t\n", "One two", "one  TWO", "é ß 漢字 \U0001f600 ok fine", "a" * 400]
    for k in range(12):  # near copies: a few words differ
        w = base.split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(99))
        texts.append(" ".join(w))
    texts += [words(rng, rng.randint(5, 120)) + " " + passage + " " + words(rng, rng.randint(0, 40)) for _ in range(8)]
    texts += [words(rng, 12_000) + " " + passage]
    rows = [(i, t, None if i % 11 == 0 else f"s{i % 4}") for i, t in enumerate(texts)]
    return rows + [rows[0]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "b", 0, "z", "q", "d") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
