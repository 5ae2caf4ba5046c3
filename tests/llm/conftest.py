from __future__ import annotations

import random

import pytest

WORDS = "river stone paper cloud light garden winter summer engine signal window market letter harbor planet silver forest bridge candle mirror".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, block string, score double, shard string"


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "ing"]) for _ in range(n))


def changed(r: random.Random, text: str, share: float) -> str:
    words = text.split(" ")
    for i in range(len(words)):
        if r.random() < share:
            words[i] = r.choice(WORDS) + "x"
    return " ".join(words)


@pytest.fixture(scope="session")
def texts():
    """Ids and texts: prose, near and exact copies, and every awkward case."""
    r = random.Random(11)
    out = [prose(r, r.randrange(3, 120)) for _ in range(60)]
    out += [changed(r, out[i % 60], s) for i, s in enumerate([0.01, 0.03, 0.05, 0.08, 0.1, 0.2] * 12)]
    out += [out[5]] * 20 + [out[7].upper(), "  ".join(out[7].split(" ")), out[7] + "\n"]
    out += ["", " \n\t", "one", "one", "one two", "One  Two", "é ß ñ", "é  ß\x0bñ", " x", prose(r, 6000), "\n\n\n"]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts, with null texts and ids, repeated rows and columns of clashing names."""
    r = random.Random(12)
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", None]), len(t), "x", "y", 0.5, "z") for i, t in texts]
    rows += [(9001, None, None, None, None, None, None, None, None), (9002, None, "en", "b", 0, None, None, None, None), (None, "lost and found", "en", "b", 3, None, None, None, None)]
    rows += [rows[3], rows[3], (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
