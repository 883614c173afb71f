from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

# Columns beside those of documents clash with names that operators use inside.
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _words string, hash int, size int, key int"


def corpus(seed: int, n: int = 40) -> list[tuple[int, str, str]]:
    """Texts of few words with shared passages, copies, runs and short and long ones."""
    r = random.Random(seed)
    known = ["The", "of", "a", "été", "word", *(f"w{i}" for i in range(30))]
    passages = [" ".join(r.choices(known, k=r.randint(30, 90))) for _ in range(4)]
    texts = []
    for i in range(n):
        kind = r.random()
        if kind < 0.1:
            text = r.choice(["", " ", "one", "a b c", "x\n\ny"])
        elif kind < 0.2:
            text = r.choice(["a ", "ab ", "a b "]) * r.randint(1, 150)
        elif kind < 0.4 and texts:
            old = r.choice(texts).split(" ")
            old[r.randrange(len(old))] = "edit"
            text = " ".join(old)
        elif kind < 0.5 and texts:
            text = r.choice(texts)
        else:
            text = "\n".join(
                " ".join([*r.choices(known, k=r.randint(0, 60)), r.choice(passages)[r.randint(0, 40) :]]) for _ in range(r.randint(1, 3))
            )
        texts.append(text)
    return [(i, t, r.choice(["src1", "src2", "src2", "src2", "src10"])) for i, t in enumerate(texts)]


@pytest.fixture
def frame(spark):
    def build(rows):
        full = [(d, t, "en", s, None if t is None else len(t), "x", 1, 2, 3) for d, t, s in rows]
        return spark.createDataFrame(full, COLUMNS).repartition(3)

    return build


@pytest.fixture
def odd(frame):
    """Nulls, empty texts, a very long text, repeated rows, and rows that share an id."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return frame(
        [
            (5, None, "b"), (4, "", None), (3, long, "b"), (2, "x " * 60, "a"), (2, "x " * 60, "a"),
            (1, "shared id " * 30, "a"), (1, "other text of the same id " * 10, None), (None, "no id " * 40, "b"), (None, None, None),
        ]
    )


@pytest.fixture
def empty(frame, spark):
    return spark.createDataFrame([], COLUMNS)
