import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "ou", "é", "ß"]


def sentence(rng, n):
    return " ".join("".join(rng.choice(PROSE) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def prose(rng, n):
    return " ".join(sentence(rng, rng.randint(4, 14)) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Texts of every odd kind: nulls, empty, white space, short, very long, repeated, tied, copies."""
    rng = random.Random(4)
    base = prose(rng, 12)
    near = base.replace(base.split()[40], "changed", 1)
    out = [(1, base), (2, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, "One."), (8, "a b c d"), (9, "a b c d"), (None, base + " tail"), (None, None), (10, prose(rng, 2000)), (11, "x" * 50_000), (12, "A$$$ b### " * 60), (13, "word " * 200), (14, prose(rng, 5)), (14, prose(rng, 5))]
    return [(i, t, rng.choice(["en", None]), rng.choice(["a", "b", None]), None if t is None else len(t)) for i, t in out]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def many_rows():
    """Documents with groups of exact and near copies, shared passages and a hot source."""
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(1, 15)) for _ in range(120)]
    shared = prose(rng, 5)
    for i in range(0, 60):
        t = texts[i % 6].split()
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(PROSE) * 2
        texts.append(" ".join(t))
    texts += [texts[3]] * 25
    texts += [prose(rng, 2) + "\n" + shared + "\n" + prose(rng, 2) for _ in range(30)]
    return [(i, t, "en", "hot" if i % 3 == 0 else f"s{i % 5}", len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def many_docs(spark, many_rows):
    return spark.createDataFrame(many_rows, DOCS)
