from __future__ import annotations

import random

import pytest

SYLLABLES = ["ka", "lo", "mi", "ren", "tas", "vo", "shu", "él", "wo", "zan", "pe", "dri"]


def words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n)]


def texts(seed: int = 1, n: int = 150) -> list[tuple]:
    """(doc_id, text): prose, exact and near copies, shared passages, and the edge cases."""
    r = random.Random(seed)
    passage = " ".join(words(r, 60))
    out: list[tuple] = []
    for k in range(n):
        z = r.random()
        if z < 0.2 and out:
            base = r.choice(out)[1]
        elif z < 0.5 and out:
            w = r.choice(out)[1].split(" ")
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = words(r, 1)[0]
            base = " ".join(w)
        else:
            base = " ".join(words(r, r.randint(1, 120)))
            if z > 0.8:
                base = f"{base} {passage}"
        out.append((k, base))
    out += [(1000, None), (1001, ""), (1002, "   \t\n "), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, " !?\U0001f600"), (1007, " ".join(words(r, 6000))), (1008, "x" * 5000)]
    return out


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, one of them twice, with columns whose names clash with those inside the operators."""
    twice = [*rows, rows[0]]
    data = [(d, t, i, "v", 2.0, [1]) for i, (d, t) in enumerate(twice)]
    return spark.createDataFrame(data, "doc_id long, text string, id int, v string, n double, h array<int>").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
