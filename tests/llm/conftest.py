from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, rare=3000):
    return [f"w{rng.randrange(rare)}" if rng.random() < 0.5 else rng.choice(["the", "of", "and", "Is", "thé"]) for _ in range(n)]


def made(seed=1):
    """Documents with copies, near copies, shared passages and lines, and odd texts."""
    rng = random.Random(seed)
    passage, line = " ".join(words(rng, 150)), "Licensed  Under the same terms "
    out = []
    base = words(rng, 300)
    for i in range(120):
        kind = i % 8
        if kind == 0:
            text = " ".join(base) + " " * (i % 3)
        elif kind == 1:
            w = list(base)
            for _ in range(rng.randrange(0, 14)):
                w[rng.randrange(len(w))] = "edit"
            text = " ".join(w)
        elif kind == 2:
            text = " ".join(words(rng, 40)) + "\n" + passage + "\n" + " ".join(words(rng, 60))
        elif kind == 3:
            text = "\n".join([" ".join(words(rng, 20)), line.upper() if i % 2 else line, " ".join(words(rng, 20)), ""])
        else:
            text = " ".join(words(rng, rng.randrange(1, 250)))
        out.append(text)
    out += [None, "", " \n\t", "é" * 900, "ab" * 700, "a", "a b c", "\n\n\n", "x" * 401, "Shti " * 300, "word joined　here"]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def rows():
    return made()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows, a null id, and columns whose names the operators use themselves."""
    text = " ".join(f"t{i}" for i in range(120))
    return spark.createDataFrame([(7, text, 1, "a", 0), (7, text, 1, "a", 0), (None, text, 2, "b", 1), (9, None, 3, "c", 2)], "doc_id long, text string, own long, key string, score int"), text
